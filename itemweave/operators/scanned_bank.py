"""A bank from the lines of scanned pages: cleaning, answers, option sets, layouts, and explanations of groups."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from itemweave.functions.text import scanned_number
from itemweave.operators.fusion import align_sequences
from itemweave.schema import LETTERS

# The formats of answer lines, options, ranges, printed labels, member numbers, sentence ends, and empty entries.
ANSWER_LINE = r"(?i)^(?:(?:[0-9IL&]{1,3})[.．、,，·一—-]?|[&·一—-])?[〖【\[(（]*[答荅][案秦]"
ANSWER = r"(?i)[答荅][案秦].*?([A-E])(?:\b|$)"
OPTION = re.compile(r"([A-Fa-f])[.．、,，:：]\s*(.*)")
RANGE = r"[（(〈]?([1-9]\d{0,2})\s*[、～~至-]\s*([1-9]\d{0,2})[^0-9]{0,8}共用(题干|[各备]选答(?:案|秦)?)"
HEADING = re.compile(r"第\s*[一二三四]\s*单元|型题|[〈<]第?\d+页[〉>]|" + RANGE)
SHARED = re.compile(r"^.*共用题干[：:]?")
LEADING = re.compile(r"[（(]?([0-9ILil&]{1,3})[.．、,，·]?\s*(.*)", re.DOTALL)
LABEL = r"[【〖]?解析[】〗]?"
MEMBER = r"[【〖]?\s*[1-4]\s*[】〗]"
SENTENCE = r"(?:(?!解析)[^。；;【】〖〗])+[。；;]?"
ENTRY = r"(?<!\d)[oOdD]?\d{1,3}[.．、]\s*(?:[【〖]|[\x{3400}-\x{9FFF}])"
OWN_ENTRY = r"^\s*[oOdD]?\d{1,3}[.．、]\s*" + LABEL
EMPTY_ENTRIES = ("", "略", "实记题", "原文件未提供解析")
# Misread words of the scanned books, their watermarks, and what begins a page's footer.
REPLACEMENTS = {
    "女于": "女子", "灭瞒": "灭螨", "艾灶灸": "艾炷灸", "疲痕灸": "瘢痕灸", "面色胱白": "面色㿠白", "濂疮": "臁疮", "湿锣音": "湿啰音", "瘢疮(硬下疳)": "疳疮（硬下疳）", "常发:生于": "常发生于",
    "疗是指发生在肌肤浅表": "疔是指发生在肌肤浅表", "红丝疗": "红丝疔", "mmo1": "mmol", "mmoI": "mmol", "μmo1": "μmol", "μmI": "μmol", "Pa02": "PaO2", "PaC02": "PaCO2", "C02": "CO2", "62G/L": "62g/L",
    "脉搏短点细": "脉搏短绌", "收缩庄": "收缩压", "肢体活功": "肢体活动", "阵发性刀割样疼痈": "阵发性刀割样疼痛", "颧膠": "颧髎", "瓜萎": "瓜蒌", "洗条法": "洗涤法", "廉疮": "臁疮",
}
WATERMARKS = (r"www[-.]?vi(?:c)?", r"www\.?[a-z]{2,12}", r"(?:yidi|anbiji)\.com", "anbiji", r"nbiji\.com", "一点(?:笔记)?", "万题(?:宝|之考真)?", "何必", "笔记】|毛址】|网址】")
CUT_AT = (
    r"A1/A2型选择题\s*$", r"[【〖]?\s*第[一二三四]单元\s*$", r"[<〈,，]?第[^>〉,，。]{0,8}页[>〉冫)]?", "三更眠五更起", "日曝十日寒", "荀有悵", "苟有恒", "秃到秃头", "最兄羔", "最无益[，,]莫过一", "英过一", "万宝",
    "真20(?:18|19|20|21|22)", "·20(?:18|19|20|21|22|2|精|全)", r"(?:[A-Za-z0-9íÍ]{0,16}\.)?com\b", r"w{1,3}\.?yid", r"nDILcon|nbilLcom|JIjL\.com",
)


def rewritten(text: Column, replacements: dict[str, str] = REPLACEMENTS, watermarks: Sequence[str] = WATERMARKS, cut_at: Sequence[str] = CUT_AT) -> Column:
    """Ordered cleaning of source text: literal replacements, watermarks with the number before them, everything from the first cut pattern on."""
    out = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), replacements.items(), F.coalesce(text, F.lit("")))
    for mark in watermarks:
        out = F.regexp_replace(out, rf"(?i)(?:[。；;，,：:]?\d{{1,3}}[.．、·])?\s*(?:{mark})", "")
    for pattern in cut_at:
        out = F.regexp_replace(out, rf"(?is)(?:{pattern}).*$", "")
    return F.regexp_replace(F.regexp_replace(out, r"^[\s.．、,，;；:：·—<〈>〉-]+|[\s.．、,，;；:：·—<〈>〉-]+$", ""), r"(?<=[。！？])\s*\d{1,3}[.．、·]?\s*$", "")


def restored_stops(text: Column) -> Column:
    """A full stop where a scanner read the letter O after an answer letter; I) before it is a misread D."""
    stopped = F.regexp_replace(text, r"(I\)|[A-E])[Oo](?![A-Za-z])", "$1。")
    return F.replace(stopped, F.lit("I)。"), F.lit("D。"))


def without_anchor(text: Column, current: Column, following: Column) -> Column:
    """The text without its own number and label, up to the entry of this or the next question that runs on inside it.

    The text is cut before every number that looks like the start of an entry; what the piece's number is decides.
    """
    pieces = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), OWN_ENTRY, ""), f"(?={ENTRY})")
    number = lambda piece: F.regexp_extract(piece, r"\d{1,3}", 0).try_cast("int")
    foreign = lambda piece, i: F.coalesce((i > 0) & number(piece).isin(current, following), F.lit(False))
    at = F.array_position(F.transform(pieces, foreign), True)
    return F.array_join(F.when(at > 0, F.slice(pieces, 1, F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(pieces), "")


def sentences(text: Column) -> Column:
    """An explanation as an array of (member, sentence), read once from left to right.

    A label with its closing bracket starts the explanation anew, one without is dropped; a member number holds for the sentences after it and takes the place of an
    earlier part with the same number, member 0 is what stands before any number. Brackets and white space are dropped.
    """
    kind = "struct<member:int,said:array<struct<member:int,sentence:string>>>"
    start = F.from_json(F.lit('{"member": 0, "said": []}'), kind)

    def step(state: Column, token: Column) -> Column:
        bare = F.regexp_replace(token, r"[【】〖〗\s]+", "")
        label, numbered = token.rlike("^[【〖]?解析[】〗]$"), token.rlike(f"^{MEMBER}$")
        member = F.when(label, F.lit(0)).when(numbered, bare.try_cast("int")).otherwise(state["member"])
        others = F.filter(state["said"], lambda x: ~numbered | (x["member"] != member))
        kept = F.when(label, F.slice(state["said"], 1, 0)).otherwise(others)
        new = F.array(F.struct(member.alias("member"), bare.alias("sentence")))
        return F.struct(member.alias("member"), F.when(label | numbered | bare.isin("", "解析"), kept).otherwise(F.concat(kept, new)).alias("said")).cast(kind)

    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{LABEL}|{MEMBER}|{SENTENCE}|[。；;]"), F.lit(0))
    return F.aggregate(tokens, start, step)["said"]


def _spoken(said: Column) -> Column:
    """Sentences as one text without marks at its ends."""
    return F.regexp_replace(F.array_join(F.transform(said, lambda x: x["sentence"]), ""), r"^[。；;，,：:]+|[。；;，,：:]+$", "")


def plain_explanation(text: Column) -> Column:
    """What an explanation says after its last label, without member numbers, brackets and white space."""
    return _spoken(sentences(text))


def is_missing(text: Column) -> Column:
    """Whether nothing but an empty entry or a number is left."""
    letters = F.regexp_replace(plain_explanation(text), r"[^\p{L}\p{N}]+", "")
    return letters.isin(*EMPTY_ENTRIES) | letters.rlike(r"^\d{1,3}$")


def group_parts(text: Column) -> Column:
    """Member number -> what a combined explanation says about that member; numbers without a word have no part."""
    said = sentences(text)
    numbers = F.filter(F.array_distinct(F.transform(said, lambda x: x["member"])), lambda k: k > 0)
    parts = F.transform(numbers, lambda k: F.struct(k.alias("key"), _spoken(F.filter(said, lambda x: x["member"] == k)).alias("value")))
    return F.map_from_entries(F.filter(parts, lambda p: p["value"] != ""))


def focused(text: Column, answer_text: Column) -> Column:
    """The sentences that hold the answer's text, or the whole explanation where none does or the answer is blank."""
    said = sentences(text)
    about = _spoken(F.filter(said, lambda x: x["sentence"].contains(answer_text)))
    return F.coalesce(F.when(answer_text != "", F.nullif(about, F.lit(""))), _spoken(said))


def distributed_explanations(items: DataFrame, placeholder: str = "原文件未提供解析。") -> DataFrame:
    """(id, explanation) of group members whose combined explanation was dealt out to them.

    A group is dealt out if all its explanations are one text, or if one of them has a part for every member; the longest one
    is the source, of equal ones that of the first member. A member gets the part of its number, else the sentences about its answer.
    Groups are a few items, so a window over one is bounded.
    """
    place = F.row_number().over(W.partitionBy("group_id").orderBy("number", "id"))
    given = F.nullif(F.col("explanation"), F.lit(placeholder))
    members = items.filter("group_id <> ''").select("id", "group_id", place.alias("k"), F.try_element_at("options", "answer").alias("right"), given.alias("given"))
    said = members.filter("given is not null").withColumn("parts", group_parts(F.col("given")))
    best = said.groupBy("group_id").agg(
        F.max_by(F.struct("given", "parts"), F.struct(F.length("given"), -F.col("k"))).alias("best"), F.count_distinct("given").alias("texts"), F.max(F.size("parts")).alias("most")
    )
    dealt = best.join(members.groupBy("group_id").agg(F.count("*").alias("n")), "group_id").filter("texts = 1 or most >= n").select("group_id", "best")
    text = F.coalesce(F.try_element_at("best.parts", "k"), focused(F.col("best.given"), F.col("right")))
    rows = members.join(dealt, "group_id").select("id", F.regexp_replace(text, "。+$", "").alias("explanation"))
    return rows.filter("explanation <> ''").withColumn("explanation", F.concat("explanation", F.lit("。")))


def answer_entries(lines: DataFrame, paper: list[str]) -> DataFrame:
    """(*paper, entry, number, answer, explanation): one row per answer line; lines up to the next one are its explanation.

    lines: (*paper, page, column, row, line, text). The number is read from the line itself or from a line with nothing else just
    before it. One paper is one window.
    """
    w = W.partitionBy(*paper).orderBy("page", "column", "row", "line")
    rows = lines.withColumn("hit", F.upper("text").rlike(ANSWER_LINE))
    rows = rows.withColumns({"entry": F.sum(F.col("hit").cast("int")).over(w), "before": F.lag("text").over(w), "ahead": F.lead("hit").over(w), "next": F.lead("text").over(w)})
    alone = lambda c: scanned_number(c).isNotNull() & F.regexp_replace(c, r"^[（(]?[0-9ILil&]{1,3}[.．、,，·]?\s*|[〖〗【】()（）]", "").eqNullSafe(F.lit(""))
    number = F.coalesce(scanned_number(F.col("text")), F.when(alone(F.col("before")), scanned_number(F.col("before"))))
    heads = rows.filter("hit").select(*paper, "entry", number.alias("number"), F.nullif(F.regexp_extract(F.upper("text"), ANSWER, 1), F.lit("")).alias("answer"))
    anchor = F.coalesce("ahead", F.lit(False)) & alone(F.col("text")) & scanned_number(F.col("next")).isNull()
    body = rows.filter(~F.col("hit") & (F.col("entry") > 0) & ~anchor)
    texts = body.groupBy(*paper, "entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "column", "row", "line", "text"))), lambda x: x["text"]), "").alias("explanation"))
    return heads.join(texts, [*paper, "entry"], "left").withColumn("explanation", F.regexp_replace(F.coalesce("explanation", F.lit("")), r"^[〖〗【】解析:：]+|[〖〗【】解析:：]+$", ""))


def option_runs(texts: list[str]) -> list[dict]:
    """Option sets of a paper's lines: letters in order, lines after a letter belong to it, F is read as E.

    A set that starts after A takes the line before it as A; letters skipped take back the last line of the letter before.
    """
    sets: list[dict] = []
    held: list[str] = []
    now: dict | None = None

    def begin() -> dict:
        first = held.pop() if held else ""
        made = {"context": list(held), "options": {"A": [first]}, "letter": "A"}
        held.clear()
        return made

    def end() -> None:
        nonlocal now
        sets.append(now)
        now = None
        held.clear()

    for text in texts:
        m = OPTION.fullmatch(text)
        if not m:
            (now["options"][now["letter"]] if now else held).append(text)
            continue
        letter = {"F": "E"}.get(m[1].upper(), m[1].upper())
        if now and LETTERS.index(letter) <= LETTERS.index(now["letter"]):
            end()
        if letter == "A":
            now = {"context": list(held), "options": {"A": []}, "letter": "A"}
            held.clear()
        elif now is None:
            now = begin()
        if letter != "A":
            for missing in LETTERS[LETTERS.index(now["letter"]) + 1 : LETTERS.index(letter)]:
                back = now["options"][now["letter"]]
                now["options"][missing] = [back.pop()] if len(back) > 1 else []
        now["options"][letter] = [m[2]]
        now["letter"] = letter
        if letter == "E":
            end()
    if now:
        sets.append(now)
    after = [s["context"] for s in sets[1:]] + [list(held)]  # what follows a set stands before the next one
    return [{"context": s["context"], "after": a, "options": {k: "".join(s["options"].get(k, [])).strip() for k in LETTERS}} for s, a in zip(sets, after)]


def leading(text: str) -> tuple[int, str] | None:
    """(number of 1 to 600 at the start of a line, with I and L read as 1 and & as 8; the rest of the line)."""
    m = LEADING.match(text)
    if not m or not re.search(r"\d", m[1]):
        return None
    number = int(m[1].upper().translate(str.maketrans("IL&", "118")))
    return (number, m[2]) if 1 <= number <= 600 else None


def _joined(lines: list[str], noise: tuple[str, ...]) -> str:
    """The lines as one text, without headings, ranges and lines that hold a noise word, and without marks at its ends."""
    said = (t for t in lines if not HEADING.search(t) and not any(x.lower() in t.lower() for x in noise))
    return "".join(said).strip(".．、,，:：")


def prompt_of(context: list[str], number: int, noise: tuple[str, ...] = ()) -> str:
    """The question before an option set: from the last line with its number on, or the last three lines where no line has it."""
    at = max((i for i, t in enumerate(context) if (leading(t) or (0,))[0] == number), default=None)
    if at is None:
        kept = [t for t in context if _joined([t], noise)]
        return _joined(kept[-3:], noise)
    return _joined([leading(context[at])[1], *context[at + 1 :]], noise)


def shared_stem_of(context: list[str], number: int, noise: tuple[str, ...] = ()) -> str:
    """The stem that the questions of a group share: from the last mark of such a stem to the first line with the number; '' without either."""
    plain = [i for i, t in enumerate(context) if not re.search(RANGE, t) and "共用题干" not in t and (leading(t) or (0,))[0] == number]
    marks = [i for i, t in enumerate(context[: plain[0]]) if "共用题干" in t] if plain else []
    if not marks:
        return ""
    return _joined([SHARED.sub("", context[marks[-1]]), *context[marks[-1] + 1 : plain[0]]], noise).lstrip(")）")


def member_prompts(after: list[str], numbers: list[int], noise: tuple[str, ...] = ()) -> dict[int, str]:
    """The questions below shared options by number; one ends where another number, a range or an option begins."""
    starts = {i: leading(t) for i, t in enumerate(after)}
    ends = [i for i, t in enumerate(after) if starts[i] or re.search(RANGE, t) or OPTION.fullmatch(t)] + [len(after)]
    out: dict[int, str] = {}
    for i, found in starts.items():
        if found and found[0] in numbers and found[0] not in out:
            out[found[0]] = _joined([found[1], *after[i + 1 : next(e for e in ends if e > i)]], noise)
    return out


def read_sets(lines: DataFrame, layout: DataFrame, paper: list[str], noise: tuple[str, ...] = ()) -> DataFrame:
    """(*paper, set_first, set_no, type, number, prompt, shared_stem, options) of the expected numbers of each paper.

    layout: (*paper, type, number, set_first), as layout() gives them. The option sets found among the lines are aligned with the
    expected sets by the number before them; numbers of a set that wasn't found have no text. B1 questions are below their set.
    """
    seen = option_sets(lines, paper)
    known = F.filter(F.transform("context", scanned_number), lambda n: n.isNotNull())
    observed = seen.select(*paper, F.col("set_no").alias("pos"), F.try_element_at(known, F.lit(-1)).alias("number"))
    wanted = layout.select(*paper, F.col("set_first").alias("ord"), F.col("set_first").alias("number")).distinct()
    placed = align_sequences(observed, wanted, paper).select(*paper, F.col("number").alias("set_first"), F.col("pos").alias("set_no"))
    rows = layout.select(*paper, "type", "number", "set_first").join(placed, [*paper, "set_first"]).join(seen, [*paper, "set_no"], "left")

    @F.pandas_udf("prompt string, shared_stem string")
    def texts(kind: pd.Series, number: pd.Series, context: pd.Series, after: pd.Series) -> pd.DataFrame:
        out = []
        for k, n, c, a in zip(kind, number, context, after):
            before, behind = list(c) if c is not None else [], list(a) if a is not None else []
            own = member_prompts(behind, [n], noise).get(n, "") if k == "B1" else prompt_of(before, n, noise)
            out.append((own, shared_stem_of(before, n, noise) if k == "A3" else ""))
        return pd.DataFrame(out, columns=["prompt", "shared_stem"])

    return rows.withColumn("x", texts("type", "number", "context", "after")).select(*paper, "set_first", "set_no", "type", "number", "x.prompt", "x.shared_stem", "options")


#: Two readings that agree less than this are reported: options, and all other texts.
LEAST_OPTIONS, LEAST_TEXTS = 0.72, 0.65


def build_papers(readings: list[DataFrame], layout: DataFrame, answers: DataFrame, paper: list[str], noise: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, excluded, disagreements) of papers that were read several times, the first reading preferred.

    readings: lines as for read_sets(); layout: (*paper, type, number, set_first); answers: (*paper, number, answer).
    items: (*paper, number, type, prompt, shared_stem, options, answer); the shared stem of a group is that of its first number
    with one. excluded: (*paper, number, reason), 'field' where an option or the question is missing, 'stem' where a group's stem
    is, else 'answer'. disagreements: (*paper, number, field, ratio). One excluded item doesn't take its group with it.
    """
    from itemweave.operators.validate import fuse_readings

    name = F.concat_ws("|", *paper, "number")
    place = layout.withColumn("ord", name)

    def long(lines: DataFrame) -> DataFrame:
        rows = read_sets(lines, layout, paper, noise).withColumn("ord", name)
        cells = [("prompt", F.col("prompt")), ("shared_stem", F.col("shared_stem")), *((f"option-{k}", F.try_element_at("options", F.lit(k))) for k in LETTERS)]
        every = F.array(*(F.struct(F.lit(n).alias("field"), c.alias("text")) for n, c in cells))
        return rows.select("ord", F.explode(every).alias("x")).select("ord", "x.field", "x.text")

    least = {"prompt": LEAST_TEXTS, "shared_stem": LEAST_TEXTS} | {f"option-{k}": LEAST_OPTIONS for k in LETTERS}
    fused, apart = fuse_readings(place, [long(x) for x in readings], least)
    texts = fused.groupBy("ord").agg(F.map_from_entries(F.collect_list(F.struct("field", "text"))).alias("t"))
    rows = place.join(texts, "ord", "left").join(answers.select(*paper, "number", "answer"), [*paper, "number"], "left")
    get = lambda k: F.try_element_at("t", F.lit(k))
    group = W.partitionBy(*paper, "group_")
    grouped = F.when(F.col("type") == "A3", F.col("group_id") if "group_id" in layout.columns else F.col("set_first"))
    rows = rows.withColumn("group_", grouped).withColumn("shared_stem", F.when(F.col("group_").isNotNull(), F.min_by(get("shared_stem"), F.when(get("shared_stem").isNotNull(), F.col("number"))).over(group)))
    missing = F.exists(F.array(*(F.lit(f"option-{k}") for k in LETTERS), F.lit("prompt")), lambda k: F.try_element_at("t", k).isNull())
    reason = F.when(F.coalesce(missing, F.lit(True)), "field").when((F.col("type") == "A3") & F.col("shared_stem").isNull(), "stem").when(~F.coalesce(F.col("answer").isin(*LETTERS), F.lit(False)), "answer")
    judged = rows.withColumn("reason", reason)
    options = F.map_from_arrays(F.array(*(F.lit(k) for k in LETTERS)), F.array(*(get(f"option-{k}") for k in LETTERS)))
    items = judged.filter("reason is null").select(*paper, "number", "type", get("prompt").alias("prompt"), "shared_stem", options.alias("options"), "answer")
    return items, judged.filter("reason is not null").select(*paper, "number", "reason"), apart.join(place.select("ord", *paper, "number"), "ord").select(*paper, "number", "field", "ratio")


def option_sets(lines: DataFrame, paper: list[str]) -> DataFrame:
    """(*paper, set_no, context, after, options, missing) of each paper's lines in page order; one paper is one task, a few thousand lines."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = {k: pdf[k].iloc[0] for k in paper}
        ordered = pdf.sort_values(["page", "column", "row", "line"])["text"].tolist()
        return pd.DataFrame(
            [{**keys, "set_no": n, "context": s["context"], "after": s["after"], "options": s["options"], "missing": [k for k in LETTERS if not s["options"][k]]} for n, s in enumerate(option_runs(ordered), 1)],
            columns=[*paper, "set_no", "context", "after", "options", "missing"],
        )

    kinds = dict(lines.dtypes)
    return lines.groupBy(*paper).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in paper) + ", set_no int, context array<string>, after array<string>, options map<string,string>, missing array<string>")


def layout(ranges: DataFrame) -> DataFrame:
    """(year, unit, type, number, set_first, group_id): expected numbers of ranges (year, unit, type, first, last, size).

    A range is cut into sets of `size` numbers, the last maybe smaller; sets of A3 and B1 are groups.
    """
    rows = ranges.withColumn("number", F.explode(F.sequence("first", "last")))
    at = (F.col("first") + F.floor((F.col("number") - F.col("first")) / F.col("size")) * F.col("size")).cast("int")
    last = F.least(at + F.col("size") - 1, F.col("last"))
    pad = lambda c: F.lpad(c.cast("string"), 3, "0")
    name = F.concat_ws("-", "year", F.concat(F.lit("U"), F.coalesce("unit", F.lit(0)).cast("string")), "type", pad(at), pad(last))
    return rows.select("year", "unit", "type", "number", at.alias("set_first"), F.when(F.col("type").isin("A3", "B1"), name).alias("group_id"))


def range_members(lines: DataFrame) -> DataFrame:
    """(first, last, kind, number): the numbers that each group heading among the lines declares."""
    found = lambda n: F.regexp_extract("text", RANGE, n)
    rows = lines.filter(F.col("text").rlike(RANGE)).select(found(1).cast("int").alias("first"), found(2).cast("int").alias("last"), F.when(found(3) == "题干", "A3").otherwise("B1").alias("kind"))
    return rows.filter("first <= last").withColumn("number", F.explode(F.sequence("first", "last")))


def carried(rows: DataFrame, paper: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The rows with nulls of the columns filled from the last value above them in the paper."""
    w = W.partitionBy(*paper).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def segments(rows: DataFrame, paper: list[str], order: list[str], heading: Column) -> DataFrame:
    """The rows with segment, the number of headings up to them in the paper (0 before the first)."""
    w = W.partitionBy(*paper).orderBy(*order)
    return rows.withColumn("segment", F.sum(F.coalesce(heading, F.lit(False)).cast("int")).over(w))
