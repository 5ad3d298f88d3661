"""Noise in text from scanned pages: edge lines, broken lines and words, gaps, misread characters.

Structure first: page numbers and running headers are lines of their own; a line end inside a running sentence joins, with
hyphen evidence for Latin words. Misreadings second: words (pairs of ideographs, Latin tokens) get an anagram hash, the sum of
the values of their characters, so replacing a by b changes it by value(b) - value(a). Joining rare words with frequent ones
on that difference, in SQL, gives the corrections; they are ranked by how much likelier the frequent variant is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemweave.llm import edges
from itemweave.llm import kernel as K
from itemweave.llm.site_lines import SPACE, excessive_lines
from itemweave.operators.skew import lookup_join
from itemweave.session import written

# What a reader of scans takes for what, as misread:meant.
CONFUSED_IDEOGRAPHS = (
    "冶治 咏脉 乞气 古舌 台苔 牌脾 臂肾 皿血 腺腹 犬大 敬散 都郁 场汤 虑虚 自白 弘弦 纽细 簿薄 肿脾 肿肺 通痛 "
    "末未 未末 己已 已己 人入 入人 日曰 目日 土士 士土 干千 千干 夫天 天夫 太大 王玉 玉王 乌鸟 鸟乌 刀力 力刀 牛午 午牛 "
    "戊戌 侯候 候侯 拔拨 拨拔 辩辨 辨辩 析折 折析 持待 待持 沮疽 洒酒 酒洒 昧味 味昧 眼腿 胶咬 问间 间问 困因 因困 园圆 壮状 "
    "汁计 苦若 若苦 苓芩 芩苓 桔枯 枯桔 徽微 微徽 喘端 端喘 渴竭 泄泻 胀账 肤扶 骨滑 湿温 温湿 熟热 热熟 寒塞 塞寒"
)
CONFUSED_LETTERS = ("c:e", "!:i", "1:l", "0:o", "5:s", "rn:m", "li:h", "cl:d", "vv:w", "|:l", "ii:n", "|:i", "1:i", "8:b", "6:b", "9:g", "ri:n", "nn:m")
#: A correction needs a variant so many times as frequent as the word read.
RATIO, LEAST = 8.0, 5
LATIN_RATIO = 4.0
STRONG = 0.8  # share of a character's occurrences that are misreadings, from which on it always counts as one beside others
JOINT = "\x1d"  # between two Latin lines: a space, or nothing if both ends make a word the bank knows
BROADCAST_SOURCES = 20_000  # sources whose lists of lines may be broadcast

_HAN = "\u4e00-\u9fff\u3400-\u4dbf"
_STOP = re.compile(r"[。！？!?：:；;…】」』”\"|]\s*$|[.)）]\s*$")
_GAP = re.compile(f"(?<=[{_HAN}]) (?=[{_HAN}])")  # wider gaps are layout
_SITE = re.compile(r"[|｜▼►▲]")
_HYPHEN = re.compile(r"(?<=[A-Za-z])[-¬‐­]\s*$")
_STRAY_O = re.compile(f"(?<=[{_HAN}）)])[oｏ](?![A-Za-z])")
_DIGIT = re.compile(r"(?<=\d)[lO](?![A-Za-z])|(?<![A-Za-z0-9])l(?=\d)|(?<=\d)[lO](?=[lO]\b)")
_MIXED = re.compile(r"[a-z][!|0156]+[a-z]|(?<![A-Za-z0-9.])[!|0156][a-z]{4,}|[a-z]{4,}[|0156](?![A-Za-z0-9.])")
_MEANT = str.maketrans("!|0156", "ilolsb")
_ANSWER = re.compile(r"(?:选|答案[为是:：]?|swer\s*(?:is|:)?|choice\s*(?:is|:)?|[Hh]ence|[Tt]herefore)\s*[^\W\d_一-鿿]\s*$")
_NOTE = re.compile(r"\s*[（(][^（）()。]{1,6}[）)]\s*")


def pairs() -> list[tuple[str, str]]:
    return [(x[0], x[1]) for x in CONFUSED_IDEOGRAPHS.split()]


def fields(questions: DataFrame) -> DataFrame:
    """(id, source, field, text) of stem, explanation and options A to E; null and empty texts give no row."""
    cells = [("stem", F.col("stem")), ("explanation", F.col("explanation"))]
    cells += [(f"option-{k}", F.try_element_at("options", F.lit(k))) for k in "ABCDE"]
    every = F.array(*(F.struct(F.lit(n).alias("field"), c.alias("text")) for n, c in cells))
    return questions.select("id", "source", F.explode(every).alias("x")).select("id", "source", "x.field", "x.text").filter("text <> ''")


def _site_texts(questions: DataFrame) -> DataFrame:
    """(source, site, total): the excessive lines of each source, as texts."""
    lists = excessive_lines(questions)
    rows = lookup_join(questions.select("source", "stem", "explanation"), lists, "source", "total")
    both = F.concat(*(F.coalesce(F.split(c, "\n"), F.array().cast("array<string>")) for c in ("stem", "explanation")))
    normal = rows.select("source", "total", "keys", F.explode(both).alias("x")).withColumn("x", F.trim(F.regexp_replace("x", SPACE, " ")))
    kept = normal.filter(F.array_contains("keys", F.xxhash64("source", "x")))
    return kept.groupBy("source").agg(F.collect_set("x").alias("site"), F.first("total").alias("total"))


def _fold(line: str) -> str:
    from itemweave.llm import truncation

    return re.sub(r"\W+", "", truncation.unicodedata.normalize("NFKC", truncation._HIDDEN.sub("", line))).lower()


def _is_site(line: str, site: set[str]) -> bool:
    """A line of the source, also with a few changed characters."""
    folded = _fold(line)
    if folded in site:
        return True
    return any(abs(len(s) - len(folded)) <= 1 and len(s) >= 6 and sum(a != b for a, b in zip(s, folded)) <= max(1, len(s) // 5) for s in site)


def _ends_only(before: str, line: str) -> bool:
    """A line of marks alone, unless it closes a bracket that the line before it left open."""
    if re.search(r"\w", line):
        return False
    return not any(c in line and before.count(o) > before.count(c) for o, c in ("（）", "()"))


def structure(text: str, site: set[str], formulas: frozenset[int]) -> tuple[bool, str]:
    """(has traces of page and line, the text with edge lines removed, broken lines joined and gaps closed).

    Latin lines without a hyphen are joined by JOINT, for the bank's words to decide.
    A line end stays where a sentence, heading or listed point ends, and around lines of the source.
    """
    from itemweave.llm import residue, truncation

    lines, traces, out, running = text.split("\n"), False, [], False
    several = len(lines) > 1
    for line in lines:
        body = line.strip()
        if not body:
            continue
        if several and (_is_site(body, site) or truncation.line_key(body) in formulas):
            out.append(("site", line))
            running = False
            continue
        if several and edges.is_edge(body) and not residue._WEAK.search(body):
            traces = True
            continue
        closed = _GAP.sub("", body) if not _SITE.search(body) else body
        if closed != body and not residue._WEAK.search(body):
            traces, line = True, closed
        if running and not _ends_only(out[-1][1], body) and not edges.is_bullet(line) and not _NOTE.fullmatch(line) and not residue._WEAK.search(out[-1][1]) and not residue._WEAK.search(line):
            traces = True
            before = out[-1][1]
            if _HYPHEN.search(before) and re.match(r"\s*[a-z]", line):
                out[-1] = ("body", _HYPHEN.sub("", before) + line.strip())
            else:
                glue = " " if re.search(r"[\w,;.]$", before, re.A) and re.match(r"\s*\w", line, re.A) else ""
                if re.search(r"[A-Za-z]$", before.rstrip()) and re.match(r"[a-z]", line.strip()):
                    glue = JOINT
                out[-1] = ("body", before.rstrip() + glue + line.strip())
        else:
            out.append(("body", line))
        last = truncation._HIDDEN.sub("", out[-1][1]).rstrip()
        running = not _STOP.search(last) and not _ANSWER.search(last)
    return traces, "\n".join(x for _, x in out)


def signs(text: str) -> tuple[bool, str]:
    """(has misread signs, text): digits read as letters, a full stop read as o, digits or marks inside Latin words."""
    new = _STRAY_O.sub("。", text)
    new = _DIGIT.sub(lambda m: {"l": "1", "O": "0"}[m.group(0)], new)
    new = _MIXED.sub(lambda m: m.group(0).translate(_MEANT), new)
    return new != text, new


def _pair_counts(texts: DataFrame) -> DataFrame:
    """(left, right, n): pairs of neighbouring characters that hold a confusable one; right is empty for single counts.

    Its size is bounded by the confusable characters times the characters of the script, whatever the number of texts.
    """
    chars = np.array(sorted({ord(c) for p in pairs() for c in p}), np.uint32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0x110000, bool)
        known[chars] = True
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in K.bounded(batches, "text", 10_000):
            flat, _ = K.codepoints(["^" + t + "$" for t in batch.column(0).to_pylist()])
            flat = flat[(flat != 10) & (flat != 32)].astype(np.int64)
            at = np.flatnonzero(known[flat])
            packed = np.concatenate([(flat[at - 1] << 21) | flat[at], (flat[at] << 21) | flat[np.minimum(at + 1, len(flat) - 1)], flat[at] << 21])
            # a pair of two confusable characters is met twice, as left and as right
            both = known[flat[at - 1]]
            some, n = np.unique(packed, return_counts=True)
            twice, m = np.unique(packed[: len(at)][both], return_counts=True)
            n[np.searchsorted(some, twice)] -= m
            keys, inv = np.unique(np.concatenate([keys, some]), return_inverse=True)
            sums = np.bincount(inv, weights=np.concatenate([sums, n]), minlength=len(keys)).astype(np.int64)
        left = [chr(k >> 21) for k in keys.tolist()]
        right = [chr(k & 0x1FFFFF) if k & 0x1FFFFF else "" for k in keys.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(sums)], ["left", "right", "n"])

    return texts.select("text").mapInArrow(count, "left string, right string, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))


def _value(c: Column) -> Column:
    """The value of a character in anagram hashes: 44 bits, so sums of a long word don't overflow."""
    return F.xxhash64(c).bitwiseAND(F.lit((1 << 44) - 1))


def _anagram(word: Column) -> Column:
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda h, c: h + F.when(c != "", _value(c)).otherwise(F.lit(0)))


def _ideograph_corrections(counts: DataFrame) -> DataFrame:
    """(read, meant, other, side, ratio) of two-character words: log of how much likelier the variant is than the word read.

    The words read are joined with their variants on the difference of anagram hashes of the confusable pair.
    """
    spark = counts.sparkSession
    confusable = spark.createDataFrame(pairs(), "a string, b string").withColumn("delta", _anagram(F.col("b")) - _anagram(F.col("a")))
    single = counts.filter("right = ''").select(F.col("left").alias("c"), F.col("n").alias("total"))
    words = counts.filter("right <> ''").withColumn("h", _value(F.col("left")) + _value(F.col("right")))
    sides = []
    for side, mine, other in (("right", "left", "right"), ("left", "right", "left")):  # the side on which the neighbour stands
        read = words.join(F.broadcast(confusable), F.col(mine) == F.col("a")).select("a", "b", F.col(other).alias("other"), "n", (F.col("h") + F.col("delta")).alias("h"))
        meant = words.select("h", F.col(mine).alias("b2"), F.col(other).alias("other2"), F.col("n").alias("m"))
        joined = read.join(meant, "h", "left").filter("b2 is null or (b2 = b and other2 = other)")
        best = read.select("a", "b", "other", "n").join(joined.filter("b2 is not null").select("a", "b", "other", "m"), ["a", "b", "other"], "left")
        sides.append(best.withColumn("side", F.lit(side)))
    rows = sides[0].unionByName(sides[1])
    rows = rows.join(F.broadcast(single.withColumnRenamed("c", "a").withColumnRenamed("total", "na")), "a").join(
        F.broadcast(single.withColumnRenamed("c", "b").withColumnRenamed("total", "nb")), "b"
    )
    # half of log((pair of b)² / total of b) for each side: both sides together give the trigram's log ratio
    ratio = F.log((F.coalesce("m", F.lit(0)) + 0.1) / (F.col("n") + 0.1)) - 0.5 * F.log(F.col("nb") / F.col("na"))
    return rows.select("a", "b", "other", "side", "n", ratio.alias("ratio"))


def _latin_corrections(words: DataFrame) -> DataFrame:
    """(token, meant): rare Latin tokens with their best frequent variant, joined on anagram hash differences.

    `words` has token and n. A token with several places of one confusion counts with one and with all of them replaced.
    """
    confusable = [x.split(":") for x in CONFUSED_LETTERS]
    every = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (_anagram(F.lit(b)) - _anagram(F.lit(a))).alias("delta")) for a, b in confusable))
    rare = words.withColumn("c", F.explode(every)).select("token", "n", "c.*").filter(F.col("token").contains(F.col("a")))
    times = ((F.length("token") - F.length(F.replace("token", F.col("a"), F.lit("")))) / F.length("a")).cast("int")
    rare = rare.withColumn("k", F.explode(F.array_distinct(F.array(F.lit(1), times))))
    rare = rare.select("token", "n", "a", "b", "k", (_anagram(F.col("token")) + F.col("k") * F.col("delta")).alias("h"))
    often = words.filter((F.col("n") >= LEAST) & F.col("token").rlike("^[a-z]+$")).select(F.col("token").alias("meant"), F.col("n").alias("m"), _anagram(F.col("token")).alias("h"))
    joined = rare.join(often, "h").filter((F.col("m") >= LATIN_RATIO * F.col("n")) & (F.levenshtein("token", "meant") <= F.length("a") * F.col("k")))
    return joined.groupBy("token").agg(F.max_by("meant", "m").alias("meant"))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z!|015689]{4,})"))


class _Readings:
    """Log ratios of the two-character corrections, looked up for whole batches."""

    def __init__(self, rows: list):
        keys = {(r.side, ord(r.other), r.a, r.b): r.ratio for r in rows}
        self.read = np.array(sorted({ord(a) for a, _ in pairs()}), np.int64)
        # characters that nearly always stand for another: beside them, a neighbour is also read as what they stand for
        total, wrong = {}, {}
        best: dict[tuple, tuple] = {}
        for r in rows:
            if r.side == "left":
                key = (r.a, r.other)
                best[key] = max(best.get(key, (-99.0, "", 0)), (r.ratio, r.b, r.n))
        for (a, _), (ratio, b, n) in best.items():
            total[a] = total.get(a, 0) + n
            if ratio > np.log(RATIO) / 2:
                wrong.setdefault(a, {}).setdefault(b, 0)
                wrong[a][b] += n
        self.stands_for = {ord(a): ord(max(w, key=w.get)) for a, w in wrong.items() if sum(w.values()) >= STRONG * total[a]}
        self.tables = {}
        for a, b in pairs():
            for side in ("left", "right"):
                found = sorted((o, v) for (s, o, x, y), v in keys.items() if (s, x, y) == (side, a, b)) if rows else []
                self.tables[a, b, side] = (np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found]))

    def misread(self, texts: list[str]) -> list[list[tuple[int, str]]]:
        """For each text the (place, meant character) of its misread characters, places in the text itself."""
        flat, no = K.codepoints(["^" + t + "$" for t in texts])
        start = np.searchsorted(no, np.arange(len(texts)))
        solid = np.flatnonzero((flat != 10) & (flat != 32))
        chars = flat[solid].astype(np.int64)
        best = np.full(len(chars), np.log(RATIO))
        meant = np.zeros(len(chars), np.int64)
        some = np.flatnonzero(np.isin(chars, self.read))
        order = some[np.argsort(chars[some], kind="stable")]
        low, high = (np.searchsorted(chars[order], [ord(a) for a, _ in pairs()], side=x) for x in ("left", "right"))
        for (a, b), i, j in zip(pairs(), low, high):
            at = order[i:j]
            if not len(at):
                continue
            total = np.zeros(len(at))
            for side, near in (("left", chars[at - 1]), ("right", chars[np.minimum(at + 1, len(chars) - 1)])):
                others, values = self.tables[a, b, side]
                k = np.minimum(np.searchsorted(others, near), max(len(others) - 1, 0))
                ok = others[k] == near if len(others) else np.zeros(len(at), bool)
                value = np.where(ok, values[k] if len(others) else 0.0, -9.0)
                if len(others):
                    meant_near = np.array([self.stands_for.get(int(c), -1) for c in near], np.int64)
                    k = np.minimum(np.searchsorted(others, meant_near), len(others) - 1)
                    value = np.where(others[k] == meant_near, np.maximum(value, values[k]), value)
                total += value
            better = total > best[at]
            best[at[better]] = total[better]
            meant[at[better]] = ord(b)
        out: list[list[tuple[int, str]]] = [[] for _ in texts]
        for i in np.flatnonzero(meant):
            t = int(no[solid[i]])
            out[t].append((int(solid[i] - start[t] - 1), chr(meant[i])))
        return out


def repaired_fields(questions: DataFrame) -> DataFrame:
    """(id, field, text, repaired): every field with traces of scanning, and its continuous readable text.

    Fields are read whole. Null and empty texts are no cases; repeated rows change nothing; an empty table gives no rows.
    """
    from itemweave.llm import truncation

    every = fields(questions)
    counts = written(_pair_counts(every), "p4-pairs")
    readings = _Readings(_ideograph_corrections(counts).filter("ratio is not null").collect())
    shape = F.col("text").rlike(r"\n|\p{IsHan} +\p{IsHan}|\d[lO]|l\d|\p{IsHan}[oｏ]|[A-Za-z][!|0156]|[!|0156][A-Za-z]")
    latin = F.col("text").rlike("[A-Za-z]{4}")
    lists = written(_site_texts(questions), "p4-site")
    rows = every.withColumns({"shape": shape, "latin": latin})
    if lists.count() <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(lists.select("source", "site")), "source", "left")
    else:
        with_site = lookup_join(rows, lists, "source", "total").drop("total")
        rows = with_site.unionByName(rows.join(lists.select("source"), "source", "left_anti"), allowMissingColumns=True)
    none = F.array().cast("array<string>")
    rows = rows.select("id", "field", "text", "shape", "latin", F.when(F.col("text").contains("\n"), F.coalesce("site", none)).otherwise(none).alias("site"))
    own = every.filter("field = 'explanation'").select("source", "text")
    rows, formulas = truncation.with_formulas(rows, written(truncation.formula_keys(own), "p4-formulas"))

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded: dict[tuple, set[str]] = {}
        for batch in K.bounded(batches, "text", 10_000):
            texts = batch.column("text").to_pylist()
            seen, fixed = batch.column("latin").to_numpy(zero_copy_only=False).copy(), list(texts)
            traced = np.zeros(len(texts), bool)
            for n in np.flatnonzero(batch.column("shape").to_numpy(zero_copy_only=False)):
                key = tuple(batch.column("site")[int(n)].as_py())
                if key not in folded:
                    folded[key] = {_fold(x) for x in key}
                one, new = structure(texts[n], folded[key], truncation.known(formulas, batch, int(n)))
                two, fixed[n] = signs(new)
                traced[n] = one or two
            names = batch.column("field").to_pylist()
            for n, wrong in enumerate(readings.misread(fixed)):
                if names[n] == "explanation":  # the last character of a broken-off explanation has no right neighbour to judge by
                    wrong = [x for x in wrong if x[0] + 1 < len(fixed[n].rstrip())]
                if wrong:
                    chars = list(fixed[n])
                    for at, c in wrong:
                        chars[at] = c
                    fixed[n], traced[n] = "".join(chars), True
            keep = pa.array(seen | traced)
            out = pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("field"), batch.column("text"), pa.array(fixed, pa.string()), pa.array(traced)], ["id", "field", "text", "repaired", "traced"]
            )
            yield out.filter(keep)

    done = written(rows.mapInArrow(repair, "id string, field string, text string, repaired string, traced boolean"), "p4-repaired")
    # Latin words: counts over all texts, corrections by anagram hash, and the fields that hold a word to correct
    counted = done.filter(F.col("text").rlike("[A-Za-z]{4}")).select(F.explode(_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    corrections = written(_latin_corrections(counted), "p4-latin")
    latin = done.filter(F.col("repaired").rlike("[A-Za-z]{4}"))
    held = latin.select("id", "field", F.explode(F.array_distinct(_tokens(F.col("repaired")))).alias("token")).join(corrections, "token")
    fixes = held.groupBy("id", "field").agg(F.map_from_entries(F.collect_set(F.struct("token", "meant"))).alias("fixes"))
    joints = done.filter(F.col("repaired").contains(JOINT)).select("id", "field", F.explode(F.regexp_extract_all(F.lower("repaired"), F.lit(f"([a-z]+{JOINT}[a-z]+)"))).alias("joint"))
    known = joints.withColumn("token", F.replace("joint", F.lit(JOINT), F.lit(""))).join(counted.filter(F.col("n") >= LEAST), "token")
    glued = known.groupBy("id", "field").agg(F.collect_set("joint").alias("glued"))
    both = done.join(fixes, ["id", "field"], "left").join(glued, ["id", "field"], "left").filter("traced or fixes is not null")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, fixes, glued in zip(*(batch.column(c).to_pylist() for c in ("repaired", "fixes", "glued"))):
                for joint in glued or ():
                    text = re.sub(rf"(?i)(?<![a-z]){joint}(?![a-z])", lambda m: m.group(0).replace(JOINT, ""), text)
                text = text.replace(JOINT, " ")
                for token, meant in fixes or ():
                    text = re.sub(rf"(?i)(?<![A-Za-z!|0156]){re.escape(token)}(?![A-Za-z!|0156])", lambda m: meant.capitalize() if m.group(0)[0].isupper() else meant, text)
                out.append(text)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "field", "text")), pa.array(out, pa.string())], ["id", "field", "text", "repaired"])

    return both.mapInArrow(words, "id string, field string, text string, repaired string")


def found(questions: DataFrame) -> DataFrame:
    return repaired_fields(questions).select("id", "field").distinct()
