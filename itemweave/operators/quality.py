"""Rule engines over the bank: structural issues, scan candidates, and answer consistency.

All text rules run in one pass over the long form of the fields: one literal pattern per rule, so that the compiled patterns
stay in generated code, and one array of the rules that hit, so that the fields are read once whatever the number of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemweave.functions.text import content_key, nfkc, source_number, trimmed, unbalanced, year_of
from itemweave.operators.bank import text_fields
from itemweave.operators.skew import lookup_join
from itemweave.schema import GROUPED_TYPES, HISTORY_YEARS, LETTERS, TYPES

# Patterns of the scan, by issue type, with their confidence.
SCAN_RULES = (
    ("watermark-or-source-noise", "high", r"(?i)(?:yidianbiji|anbiji|(?:一\s*)?点\s*笔\s*记|万\s*题|历\s*年\s*考\s*题\s*卷|202[0-4]\s*中\s*医\s*医\s*考|何\s*必\s*三\s*更|苟\s*有\s*恒|www\s*[.．]|[A-Za-z0-9-]+\s*[.．]\s*(?:com|cn)\b)"),
    ("header-footer-or-ocr-tool-noise", "high", r"(?i)(?:OCR\s*工具|扫描全能王|第\s*[一二三四]\s*单元\s*$|第\s*\d+\s*页\s*$)"),
    ("replacement-or-mojibake-character", "high", r"[\x{FFFD}□]|(?:锟斤拷|烫烫烫|屯屯屯)"),
    ("suspicious-ocr-symbol", "medium", r"[丿訂〖〗@&•●▪]|解析[】〗]|(?:^|[^A-Za-z0-9])O(?:$|[^A-Za-z0-9])"),
    ("internal-cjk-whitespace", "medium", r"[\x{3400}-\x{9FFF}]\s+[\x{3400}-\x{9FFF}]"),
    ("repeated-whitespace", "medium", r"\s{2,}"),
    ("embedded-latin-letter-confusion", "high", r"[\x{3400}-\x{9FFF}][lOo][\x{3400}-\x{9FFF}]"),
    ("trailing-ocr-garbage", "medium", r"(?:\b(?:EOoH|ar|di)\b|(?:^|[。；;，,）])\s*[dmX]\s*[。．.]?$)"),
    ("possible-bian-character-confusion", "medium", r"(?:辩证|辩病|辨病辩证)"),
    ("possible-feiwei-character-confusion", "medium", r"肺瘘"),
)
TYPE_LABEL = (
    r"(?i)(?:^|[。；;：:\s])(?:A1|A2|A3|A4|A3\s*/\s*A4|B1|AE|A三|A四|A二)(?:型)?(?:题|选择题)?(?:$|[。；;：:\s])",
    r"(?i)(?:AI|Al|A三|A四|A二|AE)型题",
)
HIGH_RISK = r"(?i)(?:不包括|不属于|错误的是|不正确|除外|剂量|\d+(?:\.\d+)?\s*(?:mg|g|ml|mL|毫克|克|毫升|寸|度)|首选|最佳|禁忌)"
MISSING_EXPLANATION = r"^(?:略[。．.]?|无[。．.]?|暂无[。．.]?|未提供[。．.]?|原文件未提供(?:解析)?[。．.]?|待补充[。．.]?|占位(?:符)?[。．.]?)$"
UNUSABLE_EXPLANATION = r"(?i)^(?:[A-E]\s*)?(?:略|无|暂无|未提供|原文件未提供(?:解析)?|待补充)?\s*[。．.]?\s*(?:[【〖][^】〗]*[】〗]\s*[。．.]?)?$"
# Patterns of the structural audit.
AUDIT_RULES = (
    ("watermark", r"(?i)(?:yidianbiji|anbiji|一\s*点\s*笔\s*记|万题|何必|历年考题卷|202[0-4]中医医考|www[.-]|[A-Za-z0-9-]+\.(?:com|cn)\b)"),
    ("ocr-symbol", r"[丿訂〖〗【】@&•●▪]|解析[】〗]|(?:^|[^A-Za-z0-9])O(?:$|[^A-Za-z0-9])"),
    ("replacement-character", r"[\x{FFFD}□]"),
    ("unit-footer", r"[【〖]?\s*第[一二三四]单元\s*$"),
    ("source-placeholder", r"待补充"),
)
HISTORY_OCR = r"原文件未提供解析|[•●▪〖〗【】]|·209|原7|訂|www\.|\.com|anbiji|yidianbiji|苟有恒|最无益|丿L|待补充|A1/A2型选择题"
ANSWER_MARKER = r"答案[：:]|解析[：:]|型题"
AUDIT_PLACEHOLDER = r"^(?:原文件未提供解析。?|略。?|实记题。?|\d{1,3})$"
AUDIT_UNUSABLE = r"(?i)^[A-E]?\s*略\s*[。．.]?(?:\s*[【〖][^】〗]*[】〗]\s*[。．.]?)?$"
# Numbers that may be a question's inside another text (after a bullet, before what a question begins with), at its end, and before an entry.
ANCHORS = (
    r"[·•]\s*(\d+)(?=\s*[（(]|$)",
    r"(?:^|[^\d])(\d+)[.．、]\s*(?=(?:[【〖]\s*)?(?:解析|一\s*点\s*笔\s*记)|患者|患儿|下列|上述|治疗|诊断|某|女性|男性)",
)
TRAILING = r"(?i)(?:^|[·。；;，,\s])(\d+)(?:[IL])?[.．、]?\s*$"
FOLLOWING = r"(?i)(?:^|[。；;，,\s])(\d+)(?:[IL])?[.．、](?=\s|$|[【〖\x{3400}-\x{9FFF}])"
STATED_ANSWER = r"(?i)(?:正确答案|答案|故|本题)(?:应|当|为|是|选|选择|选用|应该选择)*[：:，,。；; ]*([A-E])(?=[^A-Za-z]|$)"
# White space and marks that loosely equal texts may differ in, once they are compatibility-folded.
LOOSE = r"(?U)[\s\x{FEFF}，。；：、（）()《》\"“”‘’？?！!]+"
PLACEHOLDER_STEM = r"^(?:[【\[]?\s*配伍题\s*[】\]]?|A[1234](?:\s*/\s*A4)?型题|B1型题)[（(]?\s*[)）]?$"


def _hits(text: Column, rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(test, name) for name, test in rules)))


def scan_candidates(items: DataFrame) -> DataFrame:
    """(id, field, field_group, issue_type, confidence): text rules on every field; null and blank fields have none."""
    number = source_number(F.col("id"), F.col("unit"), F.col("number")) + 1
    rows = text_fields(items.withColumn("next", number), "next").withColumn("text", trimmed(F.col("text"))).filter("text <> ''")
    t = F.col("text")
    tests = [(name, t.rlike(pattern)) for name, _, pattern in SCAN_RULES]
    tests += [
        ("embedded-question-type-label", t.rlike(TYPE_LABEL[0]) | F.regexp_replace(t, r"\s+", "").rlike(TYPE_LABEL[1])),
        ("unbalanced-brackets", t.rlike(r"[（()）【】〖〗\[\]]") & unbalanced(t)),
        # one pattern for all rows takes the numbers out, the row's own number is looked up among them
        ("possible-next-question-number", F.coalesce(t.contains(F.col("next").cast("string")) & F.array_contains(F.regexp_extract_all(t, F.lit(FOLLOWING), F.lit(1)), F.col("next").cast("string")), F.lit(False))),
    ]
    levels = {name: level for name, level, _ in SCAN_RULES} | {"possible-next-question-number": "high"}
    found = rows.select("id", "field", "field_group", F.explode(F.array_distinct(_hits(t, tests))).alias("issue_type"))
    high = F.col("issue_type").isin(*(k for k, v in levels.items() if v == "high"))
    return found.withColumn("confidence", F.when(high, "high").otherwise("medium")).distinct()


def missing_explanations(items: DataFrame) -> DataFrame:
    """(id, issue_type): explanations that are empty, a placeholder, or unusable."""
    e = trimmed(F.col("explanation"))
    kind = F.when(e == "", "missing-explanation-empty").when(e.rlike(MISSING_EXPLANATION), "missing-explanation-placeholder").when(e.rlike(UNUSABLE_EXPLANATION), "missing-explanation-unusable")
    return items.select("id", kind.alias("issue_type")).filter("issue_type is not null")


def high_risk_wording(items: DataFrame) -> DataFrame:
    """(id, field): stems, prompts, shared stems and explanations with negations, doses, numbers or first choices."""
    rows = text_fields(items).filter(F.col("field").isin("stem", "prompt", "shared_stem", "explanation"))
    return rows.filter(trimmed(F.col("text")).rlike(HIGH_RISK)).select("id", "field").distinct()


def answer_conflicts(items: DataFrame) -> DataFrame:
    """(first_id, members, answers): items with equal stem and option set but several correct answer texts.

    Keys are folded (NFKC, letters only, lower case); options are compared as a set, without their letters.
    """
    options = [content_key(F.try_element_at("options", F.lit(k))) for k in LETTERS]
    keyed = items.select("id", "answer", content_key(F.col("stem")).alias("s"), *(c.alias(k) for c, k in zip(options, LETTERS)))
    right = F.coalesce(*(F.when(F.trim("answer") == k, F.col(k)) for k in LETTERS), F.lit(""))
    keyed = keyed.select("id", F.sha2(F.concat_ws("\x1f", "s", F.array_sort(F.array(*LETTERS))), 256).alias("key"), right.alias("right"))
    groups = keyed.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("members"), F.count_distinct("right").alias("answers"))
    return groups.filter("members > 1 and answers > 1").select("first_id", "members", "answers")


def structural_issues(items: DataFrame, order: str = "bank_ord", exceptions: DataFrame | None = None) -> DataFrame:
    """(id, severity, kind, field): the structural audit of every item. Kinds of one item and field are distinct.

    Items of the history years turn warnings into errors. Group kinds have the group as id. `exceptions` (id, field, label) are
    labels that are right where they stand: they are taken out of the field before it is audited for symbols.
    """
    from itemweave.operators import sequence

    year = year_of(F.col("id"))
    items = items.withColumns({"year_": year, "e": trimmed(F.col("explanation")), "kind_": F.coalesce(F.nullif(trimmed(F.col("type")), F.lit("")), F.lit("(missing)"))})
    strict = F.coalesce(F.col("year_").isin(*HISTORY_YEARS), F.lit(False))
    blank = lambda c: trimmed(c) == ""
    letters = F.array(*(F.lit(k) for k in LETTERS))
    option = lambda k: F.try_element_at("options", F.lit(k))
    shared = lambda k: F.try_element_at("shared_options", F.lit(k))
    grouped, gid = F.col("kind_").isin(*GROUPED_TYPES), trimmed(F.col("group_id"))
    answer_text = F.coalesce(*(F.when(trimmed(F.col("answer")) == k, trimmed(option(k))) for k in LETTERS), F.lit(""))
    issue = lambda test, kind, field, severity=F.lit("error"): F.when(
        test, F.struct(severity.alias("severity"), F.lit(kind).alias("kind"), F.lit(field).alias("field"))
    )
    by_history = F.when(strict, "error").otherwise("warning")
    keys = F.array_sort(F.coalesce(F.map_keys("options"), F.array().cast("array<string>")))
    shared_keys = F.array_sort(F.coalesce(F.map_keys("shared_options"), F.array().cast("array<string>")))
    tests = [
        issue(blank(F.col("id")), "missing-id", "id"), issue(blank(F.col("stem")), "missing-stem", "stem"),
        issue(keys != letters, "invalid-option-keys", "options"), *(issue(blank(option(k)), "missing-option", f"option-{k}") for k in LETTERS),
        issue(answer_text == "", "invalid-answer", "answer"), issue(F.col("e") == "", "empty-explanation", "explanation"),
        issue(~F.col("kind_").isin(*TYPES), "invalid-type", "type"),
        issue(grouped & (gid == ""), "missing-group-id", "group_id"), issue(grouped & blank(F.col("prompt")), "missing-group-prompt", "prompt"),
        issue((F.col("kind_") == "A3") & blank(F.col("shared_stem")), "missing-shared-stem", "shared_stem"),
        issue((F.col("kind_") == "B1") & ((shared_keys != letters) | F.array_contains(F.array(*(trimmed(shared(k)) for k in LETTERS)), "")), "invalid-shared-options", "shared_options"),
        issue(~grouped & (gid != ""), "unexpected-group-id", "group_id"),
        issue(trimmed(F.col("stem")).rlike(ANSWER_MARKER), "embedded-answer-marker", "stem"),
        *(issue(trimmed(option(k)).rlike(ANSWER_MARKER), "embedded-answer-marker", f"option-{k}") for k in LETTERS),
        issue(F.col("e").rlike(AUDIT_PLACEHOLDER), "placeholder-explanation", "explanation", by_history),
        issue(F.col("e").rlike(AUDIT_UNUSABLE) & ~F.col("e").rlike(AUDIT_PLACEHOLDER), "unusable-explanation", "explanation", F.lit("warning")),
    ]
    records = items.select("id", F.explode(F.array_compact(F.array(*tests))).alias("x")).select("id", "x.*")

    # text rules on stem, explanation and options
    follows = sequence.next_number(items.select("id", "unit", "number")).filter("next_exists").select("id").distinct().withColumn("has_next", F.lit(True))
    number, unit, y = F.col("number"), F.col("unit"), F.col("year_")
    current = F.when(strict, F.when(y == 2018, number).otherwise((unit - 1) * 150 + number))
    last = F.when(unit == 4, 126).otherwise(150)
    after_2021 = F.when(unit.between(1, 4), F.when(number < last, number + 1).when(unit < 4, 1))
    following = F.when(strict, F.when(y == 2021, after_2021).when(current < F.when(y == 2018, 162).otherwise(600), current + 1))
    local = F.when(F.col("has_next"), number + 1)
    rows = items.join(follows, "id", "left").withColumns({"strict": strict, "anchors": F.array_distinct(F.array_compact(F.array(number, local, current, following))), "nexts": F.array_distinct(F.array_compact(F.array(local, following)))})
    cells = text_fields(rows, "strict", "anchors", "nexts").filter(F.col("field").isin("stem", "explanation", *(f"option-{k}" for k in LETTERS)))
    cells = cells.withColumn("raw", trimmed(F.col("text"))).filter("raw <> ''")
    if exceptions is None:
        cells = cells.withColumn("audited", F.col("raw"))
    else:
        labels = exceptions.groupBy("id", "field").agg(F.collect_set("label").alias("labels"))
        left = F.aggregate(F.coalesce("labels", F.array().cast("array<string>")), F.col("raw"), lambda t, x: F.replace(t, x, F.lit("")))
        cells = cells.join(labels, ["id", "field"], "left").withColumn("audited", left).drop("labels")
    plain = lambda c: F.transform(c, lambda n: n.cast("string"))
    numbers = F.concat(*(F.regexp_extract_all("raw", F.lit(x), F.lit(1)) for x in ANCHORS))
    has_digit = F.col("raw").rlike(r"\d")
    text_tests = [(kind, F.col("audited").rlike(pattern)) for kind, pattern in AUDIT_RULES]
    text_tests += [
        ("history-source-ocr", F.col("strict") & F.col("audited").rlike(HISTORY_OCR)),
        ("merged-question-anchor", has_digit & F.arrays_overlap(numbers, plain(F.col("anchors")))),
        ("trailing-next-question-anchor", has_digit & F.array_contains(plain(F.col("nexts")), F.regexp_extract("raw", TRAILING, 1))),
    ]
    texts = cells.select("id", "field", "strict", F.explode(_hits(F.col("raw"), text_tests)).alias("kind"))
    texts = texts.select("id", F.when(F.col("strict") | (F.col("kind") == "history-source-ocr"), "error").otherwise("warning").alias("severity"), "kind", "field")

    # repeated ids and contents
    signature = F.sha2(content_key(F.concat_ws("", trimmed(F.col("stem")), *(trimmed(option(k)) for k in LETTERS))), 256)
    empty = F.sha2(F.lit(""), 256)
    repeated = []
    for kind, key, field in (("duplicate-id", trimmed(F.col("id")), "id"), ("duplicate-question-content", F.nullif(signature, empty), None)):
        keyed = items.select("id", F.col(order).alias("ord"), key.alias("key")).filter("key <> ''")
        firsts = keyed.groupBy("key").agg(F.min("ord").alias("first"), F.count("*").alias("n")).filter("n > 1")
        later = lookup_join(keyed, firsts, "key", "n").filter("ord > first")
        repeated.append(later.select("id", F.lit("error").alias("severity"), F.lit(kind).alias("kind"), F.lit(field).cast("string").alias("field")))

    # groups
    ranges = sequence.group_ranges(items)
    declared = items.filter("group_id is not null and group_id <> ''").groupBy("group_id").agg(
        ((F.count_distinct("group_start") != 1) | (F.count_distinct("group_end") != 1) | (F.count("group_start") < F.count("*")) | (F.count("group_end") < F.count("*"))).alias("conflict")
    )
    ranges = ranges.join(declared, "group_id").select("group_id", F.when(F.col("conflict"), "group-range-conflict").when(~F.col("complete"), "incomplete-group-members").alias("kind")).filter("kind is not null")
    groups = sequence.group_conflicts(items).unionByName(ranges).select(
        F.col("group_id").alias("id"), F.lit("error").alias("severity"), "kind",
        F.when(F.col("kind") == "shared-stem-conflict", "shared_stem").when(F.col("kind") == "shared-options-conflict", "shared_options")
        .when(F.col("kind").isin("group-range-conflict", "incomplete-group-members"), "group_start/group_end").otherwise("group_id").alias("field"),
    )
    return records.unionByName(texts).unionByName(repeated[0]).unionByName(repeated[1]).unionByName(groups)


def issue_counts(issues: DataFrame, *by: str) -> DataFrame:
    """(*by, issues, ids): number of rows and of distinct ids."""
    return issues.groupBy(*by).agg(F.count("*").alias("issues"), F.count_distinct("id").alias("ids"))


def stated_answer_conflicts(items: DataFrame) -> DataFrame:
    """(id, stated): explanations that name another answer than the key."""
    rows = items.select("id", "answer", F.explode(F.regexp_extract_all(trimmed(F.col("explanation")), F.lit(STATED_ANSWER), F.lit(1))).alias("stated"))
    return rows.select("id", "answer", F.upper("stated").alias("stated")).filter(~F.col("stated").eqNullSafe(F.col("answer"))).select("id", "stated").distinct()


def loose(text: Column) -> Column:
    """Trimmed, compatibility-folded, without white space and common marks; null gives ''.

    Folding turns full-width commas, colons and semicolons into ASCII ones, which stay.
    """
    return F.regexp_replace(nfkc(trimmed(text)), LOOSE, "")


#: Between texts that are folded in one pass; folding leaves it alone and no text holds it.
_APART = "\x1e"


def _folded(items: DataFrame, *texts: Column) -> DataFrame:
    """The items with t, the array of their loose texts; all of a row go through one call of the folding function."""
    one = F.concat_ws(_APART, *(trimmed(c) for c in texts))
    return items.withColumn("t", F.transform(F.split(nfkc(one), _APART), lambda x: F.regexp_replace(x, LOOSE, "")))


def answer_not_explained(items: DataFrame) -> DataFrame:
    """(id): the explanation lacks the answer's text but holds another option's (loose texts of two characters or more)."""
    rows = _folded(items.select("id", "answer", "options", "explanation"), F.col("explanation"), *(F.try_element_at("options", F.lit(k)) for k in LETTERS))
    said, options = F.col("t")[0], F.slice("t", 2, len(LETTERS))
    of = F.array_position(F.array(*(F.lit(k) for k in LETTERS)), F.col("answer")).cast("int")
    right = F.try_element_at(options, F.nullif(of, F.lit(0)))
    other = F.exists(F.transform(options, lambda x, i: (i + 1 != F.coalesce(of, F.lit(0))) & (F.length(x) >= 2) & said.contains(x)), lambda x: x)
    return rows.filter((F.length(right) >= 2) & ~said.contains(right) & other).select("id").distinct()


def duplicate_answer_conflicts(items: DataFrame) -> DataFrame:
    """(first_id, members, answers): items whose loose stem and loose options, in letter order, are equal but whose answers' texts differ."""
    rows = _folded(items.select("id", "answer", "stem", "options"), F.col("stem"), *(F.try_element_at("options", F.lit(k)) for k in LETTERS))
    of = F.array_position(F.array(*(F.lit(k) for k in LETTERS)), F.col("answer")).cast("int")
    right = F.coalesce(F.try_element_at(F.slice("t", 2, len(LETTERS)), F.nullif(of, F.lit(0))), F.lit(""))
    keyed = rows.select("id", F.sha2(F.concat_ws(_APART, "t"), 256).alias("key"), right.alias("right"))
    groups = keyed.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("members"), F.count_distinct("right").alias("answers"))
    return groups.filter("members > 1 and answers > 1").select("first_id", "members", "answers")


def repeated_explanations(items: DataFrame) -> DataFrame:
    """(first_id, members, groups): one explanation, loosely equal, in several groups or single items. Blank ones are equal too."""
    key = F.coalesce(F.nullif(F.col("group_id"), F.lit("")), F.col("id"))
    rows = items.select("id", key.alias("block"), F.md5(loose(F.col("explanation"))).alias("e"))
    groups = rows.groupBy("e").agg(F.min("id").alias("first_id"), F.count("*").alias("members"), F.count_distinct("block").alias("groups"))
    return groups.filter("members > 1 and groups > 1").select("first_id", "members", "groups")


def explanation_policy(items: DataFrame) -> DataFrame:
    """(group_id, policy, texts): for B1 groups none, merged (some lack one), shared (one text) or individual."""
    e = F.nullif(trimmed(F.col("explanation")), F.lit(""))
    given = F.when(e != "原文件未提供解析。", e)
    rows = items.filter("type = 'B1' and group_id <> ''").groupBy("group_id").agg(
        F.count("*").alias("members"), F.count(given).alias("given"), F.count_distinct(given).alias("texts")
    )
    policy = F.when(F.col("given") == 0, "none").when(F.col("given") < F.col("members"), "merged").when(F.col("texts") == 1, "shared").otherwise("individual")
    return rows.select("group_id", policy.alias("policy"), "texts")


def placeholder_stems(items: DataFrame) -> DataFrame:
    """(id): stems that hold nothing but a type label."""
    return items.filter(trimmed(F.col("stem")).rlike(PLACEHOLDER_STEM)).select("id")


def group_member_issues(items: DataFrame) -> DataFrame:
    """(group_id, kind): what is wrong with a group, whose type is that of its first member by number and id.

    'single': fewer than two members. 'blank-prompt': a prompt of a B1 or A3 group is blank, or, in B1, a type label only.
    'options': loose options, in letter order, of a B1 group differ among members or from the shared ones. 'child-numbers': the
    numbers inside the source's group (source_sub_question_number, where the items have it and it is not null) aren't 1 to n in order.
    """
    letters = [F.lit(k) for k in LETTERS]
    child = F.col("source_sub_question_number") if "source_sub_question_number" in items.columns else F.lit(None).cast("int")
    rows = items.filter("group_id <> ''").select("group_id", "type", "number", "id", "prompt", "options", "shared_options", child.alias("child"))
    rows = _folded(rows, *(F.try_element_at(c, k) for c in ("options", "shared_options") for k in letters))
    side = lambda at: F.concat_ws("|", F.slice("t", at, len(LETTERS)))
    rows = rows.select("group_id", "type", "number", "id", "child", trimmed(F.col("prompt")).alias("p"), side(1).alias("own"), side(1 + len(LETTERS)).alias("shared"))
    order = F.struct("number", "id")
    g = rows.groupBy("group_id").agg(
        F.count("*").alias("n"), F.max(F.col("p") == "").alias("blank"), F.max(F.col("p").rlike(PLACEHOLDER_STEM)).alias("label"), F.min_by("type", order).alias("type"),
        F.count_distinct("own").alias("owns"), F.max(F.col("own") != F.col("shared")).alias("differs"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("child").isNotNull(), F.struct("number", "id", "child")))), lambda x: x["child"]).alias("children"),
    )
    b1 = F.col("type") == "B1"
    kinds = F.array(
        F.when(F.col("n") < 2, "single"), F.when((b1 & (F.col("blank") | F.col("label"))) | ((F.col("type") == "A3") & F.col("blank")), "blank-prompt"),
        F.when(b1 & ((F.col("owns") != 1) | F.col("differs")), "options"),
        F.when(b1 & (F.size("children") > 0) & (F.col("children") != F.sequence(F.lit(1), F.col("n").cast("int"))), "child-numbers"),
    )
    return g.select("group_id", F.explode(F.array_compact(kinds)).alias("kind"))
