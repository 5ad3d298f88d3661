"""Explanations cut off by a limit or a broken transfer.

An explanation that doesn't end with a closing mark is open. Near-copies of open explanations are found through min-hash
banding; where an aligned copy goes on inside the same sentence, the open one was cut, where the copy's sentence ends at the
same word, it only lacks its mark. Open explanations without such a copy are scored by closing-word terminality: a linear
model of how sentences end, fitted on whole sentences of the bank and on prefixes of them.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemweave.functions.identity import stripped
from itemweave.llm import edges, linear, near_dups, residue
from itemweave.llm import kernel as K
from itemweave.llm.site_lines import SPACE, excessive_lines
from itemweave.operators.skew import lookup_join, small
from itemweave.session import written

TRAIN_ROWS, CUTS, PENALTY, ROUNDS = 2500, 3, 1e-7, 100
#: A line that ends so many different texts, finished without it, in so many sources is a formula, not part of the explanation.
FORMULA_TEXTS, FORMULA_SOURCES, FORMULA_LETTERS = 3, 3, 4
FORMULA_LINES = 1_000_000  # formulas whose 64-bit keys may travel with a function; more are joined to their rows
BROADCAST_KEYS = 1_000_000  # texts whose keys may be broadcast
WORDS, SIMILARITY = 5, 0.8  # shingles of five letters; what a cut text and the aligned part of its copy share of theirs at least
SEEDS, BITS, MANTISSA, ROWS = 1, 6, 10, 5  # 64 registers in 12 bands
TAIL = 12  # letters that have to agree where a copy is aligned

_HIDDEN = residue._HIDDEN
_END = re.compile(r"[。！？!?）)】」』”\"]\s*$|[.．]\s*$")
_MARKER = re.compile(r"(?:\.{2,}|…+|�+|</?[A-Za-z]{0,6}\s?/?|&#?[A-Za-z0-9]{0,5}|\\u?[0-9a-fA-F]{0,3}|%[0-9A-Fa-f]?)\s*$")
_ANSWER = re.compile(r"(?:选|答案[为是:：]?|[Aa]n(?:-\s*)?swer\s*(?:is|:)?|choice\s*(?:is|:)?|[Hh]ence|[Tt]herefore)\s*[^\W\d_一-鿿]\s*$")
_LAST = re.compile(r"(?:[。！？!?]|\.(?=\s)|[.](?=[一-鿿]))[”’」』）)\"]*")
_CLAUSE = re.compile(r"[，、；：,;:（(]")
_ITEM = re.compile(r"^\s*(?:[-*•●◆■]|[(（]?\d{1,2}\s*[.、)）．])\s*")


def plain(text: str) -> str:
    """One line of text: no invisible characters, compatible forms folded, lines joined, edge lines dropped."""
    lines = [x for x in _HIDDEN.sub("", text).split("\n") if not edges.is_edge(x)]
    lines = [_ITEM.sub("", x) if n else x for n, x in enumerate(lines)]
    text = unicodedata.normalize("NFKC", "\n".join(lines).replace("…", "\x01")).replace("\x01", "…")
    text = text.translate({ord(","): "，", ord(";"): "；", ord(":"): "：", ord("("): "（", ord(")"): "）"}) if re.search(r"[一-鿿]", text) else text
    text = re.sub(r"[-¬]\s*\n\s*(?=[a-z])", "", text)
    text = re.sub(r"\s*\n\s*(?=[一-鿿])|(?<=[一-鿿，、。])\s+(?=[一-鿿])", "", text)
    return re.sub(r"\s+", " ", text).strip()


def fragment(text: str) -> tuple[str, bool]:
    """(what stands after the last finished sentence, whether a cut-off marker follows it); '' if the text is closed."""
    text = text.rstrip()
    end = text[-24:]
    marked = _MARKER.search(end)
    if marked:
        # a run of points or replacement characters can be longer than the tail, all other marks are shorter
        base = (text[: len(text) - len(end) + marked.start()] if marked.start() else text.rstrip(".…\ufffd")).rstrip()
        if not base:
            return "", False
        text = base
    elif _END.search(end) or _ANSWER.search(end):
        return "", False
    at = 0
    for m in _LAST.finditer(text):
        at = m.end()
    return text[at:].strip(), bool(marked)


def shut(text: str) -> bool:
    """A quick test that holds for most texts of one line: the last character closes a sentence and no marker ends in it.

    With more lines the last one can be a formula or page line, which has to go first.
    """
    end = text[-1:]
    return end != "" and (end in "。！？）】」』”" or (end == "." and not text.endswith("..")))


def _slots(fragments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of how each fragment ends: its last letters, its last clause's first ones, their pairs, counts."""
    slot, owner = [], []
    for n, f in enumerate(fragments):
        f = re.sub(r"\d", "0", f)
        parts = _CLAUSE.split(f)
        last = parts[-1].strip()
        words = last.split(" ")
        head, first = last[:2], f.strip()[:2]
        keys = [f"s{k}{last[-k:]}" for k in range(1, 7)] + [f"f{k}{f[-k:]}" for k in (2, 3, 4, 5)]
        keys += [f"h{head[:1]}|{last[-1:]}", f"H{head}|{last[-2:]}", f"F{first}|{last[-1:]}|{min(len(parts), 6)}", f"G{first}|{last[-2:]}", f"1{first[:1]}|{min(len(parts), 6)}"]
        keys += [f"n{head[:1]}|{min(len(last), 24)}", f"c{first}|{min(len(parts), 6)}|{min(len(last), 12)}", f"w{words[-1]}", f"W{' '.join(words[-2:])}", f"x{words[0]}|{min(len(words), 15)}"]
        keys += [f"p{parts[-2][-2:] if len(parts) > 1 else ''}|{last[-1:]}"]
        slot += [hash_text(k) for k in keys]
        owner += [n] * len(keys)
    return np.array(slot, np.int64), np.array(owner, np.int64)


def hash_text(key: str) -> int:
    """A slot of the linear model that is the same in every process."""
    h = zlib.crc32(key.encode())
    return (h ^ (h >> 15)) * 0x9E3779B1 % (1 << 32) >> (32 - linear.BITS)


def fit(texts: list[str]) -> np.ndarray:
    """Weights from whole sentences (label 1) and from prefixes of them, CUTS each at places fixed by a hash."""
    whole, cut = [], []
    for t in texts:
        t = plain(t)
        at = 0
        for m in _LAST.finditer(t + " "):
            sentence, at = t[at : m.start()].strip(), m.end()
            if 4 <= len(sentence) <= 300:
                whole.append(sentence)
                for k in range(CUTS):
                    n = 1 + hash_text(f"{k}{sentence}") * 2654435761 % (len(sentence) - 1)
                    cut.append(sentence[:n].rstrip())
    slot, owner = _slots(whole + cut)
    label = np.array([1.0] * len(whole) + [0.0] * len(cut))
    if not len(label):
        return np.zeros((1 << linear.BITS) + 1)
    return linear.fit(slot, owner, label, np.where(label > 0, CUTS, 1.0), PENALTY, ROUNDS)


def terminality(weights: np.ndarray, fragments: list[str]) -> np.ndarray:
    """Log odds that each fragment is a finished sentence."""
    if not fragments:
        return np.zeros(0)
    slot, owner = _slots(fragments)
    return linear.scores(weights, slot, owner, len(fragments))


def _own_lines(questions: DataFrame) -> DataFrame:
    """(id, source, text): explanations without the excessive lines of their source; blank ones are left out."""
    rows = questions.filter("explanation is not null and trim(explanation) <> ''").select("id", "source", "explanation")
    lists = excessive_lines(questions)
    normal = lambda x: F.trim(F.regexp_replace(x, SPACE, " "))
    matched = lookup_join(rows, lists, "source", "total")
    kept = F.filter(F.split("explanation", "\n"), lambda x: ~F.array_contains("keys", F.xxhash64(F.col("source"), normal(x))))
    matched = matched.select("id", "source", F.array_join(kept, "\n").alias("text"))
    rest = rows.join(small(lists.select("source"), BROADCAST_KEYS), "source", "left_anti").select("id", "source", F.col("explanation").alias("text"))
    return matched.unionByName(rest)


def line_key(line: str) -> int:
    """The key of a line, white space reduced, as Spark's xxhash64 gives it."""
    return xxhash.xxh64_intdigest(" ".join(line.split()).encode("utf-8", "replace"), 42)


def formula_keys(rows: DataFrame) -> DataFrame:
    """(key): the formula lines of (source, text).

    What counts is the number of different texts before the line, by their letters, that end with a closing mark, and the
    number of sources they are from: the last line of an explanation with many copies follows one text only, and the second
    half of a broken sentence follows none that is closed. Both numbers are fixed, so other rows never change a line's lot
    by their mere number. A missing source counts as one.
    """
    text = F.rtrim("text")
    last = F.element_at(F.split(text, "\n"), -1)
    line = F.trim(F.regexp_replace(last, SPACE, " "))
    head = F.rtrim(text.substr(F.lit(1), F.length(text) - F.length(last)))
    ends = rows.filter(F.col("text").contains("\n")).select(line.alias("line"), head.alias("head"), F.coalesce("source", F.lit("")).alias("source"))
    ends = ends.filter((F.length("line") >= FORMULA_LETTERS) & F.col("head").rlike(r"[。！？!?.．）)】」』”\"]\s*$"))
    ends = ends.select(F.xxhash64("line").alias("key"), F.xxhash64(stripped(F.col("head"))).alias("before"), F.xxhash64("source").alias("source"))
    often = ends.distinct().groupBy("key").agg(F.count_distinct("before").alias("texts"), F.count_distinct("source").alias("sources"))
    return often.filter((F.col("texts") >= FORMULA_TEXTS) & (F.col("sources") >= FORMULA_SOURCES)).select("key")


def with_formulas(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, frozenset[int] | None]:
    """(rows, all keys), or, where those are too many to travel, (rows with `formulas`, the keys of each text's formula lines, and None)."""
    if keys.count() <= FORMULA_LINES:
        return rows, frozenset(r.key & (1 << 64) - 1 for r in keys.collect())
    one = lambda x: F.xxhash64(F.trim(F.regexp_replace(x, SPACE, " ")))
    of = F.xxhash64("text")
    lines = rows.filter(F.col("text").contains("\n")).select(of.alias("of"), F.explode(F.array_distinct(F.transform(F.split("text", "\n"), one))).alias("key"))
    found = lines.join(keys, "key", "left_semi").groupBy("of").agg(F.collect_set("key").alias("formulas"))
    return rows.withColumn("of", of).join(found, "of", "left").drop("of"), None


def known(every: frozenset[int] | None, batch: pa.RecordBatch, n: int) -> frozenset[int]:
    """The formula keys that hold for row n of a batch of with_formulas()."""
    return every if every is not None else frozenset(k & (1 << 64) - 1 for k in batch.column("formulas")[n].as_py() or ())


def _bands(texts: DataFrame) -> DataFrame:
    """(band, content) of different texts (key, text); the lowest bit of a key says whether the text is open."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.bounded(batches, "text"):
            flat, no = K.letters(part.column("text").to_pylist())
            if len(flat) < WORDS:
                continue
            inside = no[: len(flat) - WORDS + 1] == no[WORDS - 1 :]
            h = flat[: len(inside)].astype(np.uint64)
            for k in range(1, WORDS):
                h = h * np.uint64(0x100000001B3) + flat[k : k + len(inside)]
            reg = K.hyperminhash(h[inside], no[: len(inside)][inside], part.num_rows, SEEDS, BITS, MANTISSA)
            keys = K.band_keys(reg, ROWS)
            key = part.column("key").to_numpy()
            _, first = np.unique(key, return_index=True)  # copies within the batch go once
            first = first[reg[first].any(axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[first].ravel().view(np.int64)), pa.array(np.repeat(key[first], keys.shape[1]))], ["band", "content"])

    return texts.mapInArrow(bands, "band long, content long")


def strip_formulas(text: str, formulas: frozenset[int]) -> str:
    """The text without formula lines, edge lines and blank lines at its end."""
    lines = text.split("\n")
    while lines and (not lines[-1].strip() or line_key(lines[-1]) in formulas or (len(lines) > 1 and edges.is_edge(lines[-1]))):
        lines.pop()
    return "\n".join(lines)


_NORMAL = re.compile(r"[^0-9a-z一-鿿。]+")


def _aligned(text: str) -> str:
    """Letters and sentence ends only."""
    return _NORMAL.sub("", re.sub(r"[！？!?]|\.(?=\s|$)", "。", plain(text).lower()))


def similarity(a: str, b: str) -> float:
    """The Jaccard similarity of the shingles of two aligned texts; sentence ends don't count."""
    a, b = ({t[i : i + WORDS] for i in range(len(t) - WORDS + 1)} for t in (a.replace("。", ""), b.replace("。", "")))
    return len(a & b) / max(len(a | b), 1)


def compare(cut: str, copy: str) -> int:
    """1 if the copy goes on inside the sentence where `cut` ends, -1 if its sentence ends there, 0 if they don't align.

    Only the copy up to there has to be similar, so an early cut is compared with as much of its copy as it holds.
    """
    a, b = _aligned(_MARKER.sub("", cut.rstrip())), _aligned(copy)
    tail = a[-TAIL:]
    at = b.find(tail) if len(tail) == TAIL else -1
    if at < 0 or b.find(tail, at + 1) >= 0 or similarity(a, b[: at + TAIL]) < SIMILARITY:
        return 0
    following, end = b[at + TAIL : at + TAIL + 1], plain(copy)[-24:]
    if following == "" and (_MARKER.search(end) or not _END.search(end)):
        return 0  # the copy breaks off at the same place, so it is no witness
    return -1 if following in ("", "。") else 1


def _tail_keys(texts: list[str], every: bool) -> tuple[np.ndarray, np.ndarray]:
    """(key, text number) of the runs of TAIL letters of aligned texts: of the last one, or of every one."""
    flat, no = K.codepoints([x.replace("。", "") for x in texts])
    if len(flat) < TAIL:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = len(flat) - TAIL + 1
    h = flat[:m].astype(np.uint64)
    for k in range(1, TAIL):
        h = K.mix64(h * np.uint64(31) + flat[k : k + m])
    inside = no[:m] == no[TAIL - 1 :]
    if not every:
        inside &= np.r_[no[TAIL:] != no[TAIL - 1 : -1], True]
    return h[inside].view(np.int64), no[:m][inside]


def _tails(every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.bounded(batches, "text"):
            texts = part.column("text").to_pylist()
            tail, no = _tail_keys([_aligned(t if every else _MARKER.sub("", t.rstrip())) for t in texts], every)
            yield pa.RecordBatch.from_arrays([pa.array(tail), pa.array(part.column("key").to_numpy()[no])], ["tail", "key"])

    return run


def truncated(questions: DataFrame) -> DataFrame:
    """(id, source, evidence, score): the questions whose explanation was cut; evidence is 'copy' or 'ending'.

    Null and blank explanations, records of residue, complete statements without a mark, and lines of the source after a
    complete statement are no cases. Repeated rows change nothing; an empty table gives no rows.

    Equal texts are one text for the copies, however many records hold it. Texts of a band that more than BUCKET_CAP texts
    share are joined exactly instead: an open text's last TAIL letters with the runs of the others.
    """
    rows = _own_lines(questions)
    rows = written(rows, "p1-rows")
    marked, every = with_formulas(rows, written(formula_keys(rows), "p1-formulas"))
    sample = rows.orderBy(F.xxhash64(F.lit(29), "id"), "id").limit(TRAIN_ROWS).select("text").collect()
    weights = fit(sorted(r.text for r in sample)).astype(np.float32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.astype(np.float64)
        for batch in K.bounded(batches, "text"):
            ids, sources, texts, raw, fragments = [], [], [], [], []
            for n, (i, s, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "source", "text")))):
                if "\n" not in t and shut(t):
                    continue
                whole, t = t, strip_formulas(t, known(every, batch, n))
                if not t or (_END.search(t[-24:]) and not _MARKER.search(t[-24:])):
                    continue
                f, marked = fragment(plain(t))
                if f or marked:
                    ids.append(i)
                    sources.append(s)
                    raw.append(whole)
                    texts.append(t)
                    fragments.append(f)
            value = terminality(w, fragments)
            value = np.where([f == "" for f in fragments], 9.0, value) if fragments else value
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(sources, pa.string()), pa.array(texts, pa.string()), pa.array(raw, pa.string()), pa.array(value, pa.float64())],
                ["id", "source", "text", "raw", "score"],
            )

    opened = marked.mapInArrow(score, "id string, source string, text string, raw string, score double")
    of = F.xxhash64("raw").bitwiseOR(F.lit(1)).alias("a")  # odd keys are those of open texts
    opened = written(opened.select("id", "source", "text", "score", of), "p1-open")
    # near-copies of the open ones: bands of all different texts, pairs kept where one of the two is open
    openings = written(opened.select("a").distinct(), "p1-keys")
    key = F.xxhash64("text")
    texts = rows.select("text", key.bitwiseOR(F.lit(1)).alias("a")).join(small(openings.withColumn("open", F.lit(1)), BROADCAST_KEYS), "a", "left")
    texts = texts.select(F.when(F.col("open") == 1, F.col("a")).otherwise(F.col("a") - 1).alias("key"), "text")
    bands = _bands(texts).repartition("band").sortWithinPartitions("band")
    paired = written(bands.mapInArrow(near_dups.paired, "band long, a long, b long").filter("b is null or a % 2 <> 0 or b % 2 <> 0"), "p1-paired")
    near = paired.filter("b is not null")
    near = near.filter("a % 2 <> 0").select("a", "b").unionByName(near.filter("b % 2 <> 0").select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = paired.filter("b is null").select(F.col("a").alias("key"))
    if not large.isEmpty():
        wide = texts.join(written(large.distinct(), "p1-large"), "key", "left_semi").dropDuplicates(["key"])
        wide = written(wide, "p1-wide")
        ends = wide.filter("key % 2 <> 0").mapInArrow(_tails(False), "tail long, key long").select("tail", F.col("key").alias("a"))
        runs = wide.mapInArrow(_tails(True), "tail long, key long").select("tail", F.col("key").alias("b"))
        near = near.unionByName(ends.join(runs, "tail").filter("a <> b").select("a", "b"))
    pairs = written(near.distinct(), "p1-pairs")
    needed = small(written(pairs.select("b").distinct(), "p1-needed"), BROADCAST_KEYS)
    copies = texts.withColumnRenamed("key", "b").join(needed, "b", "left_semi").dropDuplicates(["b"]).select("b", F.col("text").alias("copy"))
    both = pairs.join(opened.select("a", "text").dropDuplicates(["a"]), "a").join(copies, "b")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [compare(t, c) for t, c in zip(batch.column("text").to_pylist(), batch.column("copy").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array(out, pa.int32())], ["a", "says"])

    says = both.select("a", "text", "copy").mapInArrow(align, "a long, says int").groupBy("a").agg(F.sum("says").alias("says"))
    says = small(written(says.filter("says <> 0"), "p1-says"), BROADCAST_KEYS)
    judged = opened.select("id", "source", "score", "a").join(says, "a", "left").withColumn("says", F.coalesce("says", F.lit(0)))
    cases = judged.filter("says > 0 or (says = 0 and score < 0)")
    cases = cases.select("id", "source", F.when(F.col("says") > 0, "copy").otherwise("ending").alias("evidence"), "score")
    # records of residue, looked for among the open ones only
    model = residue.fit(residue.training_rows(questions))
    some = small(written(opened.select("id").distinct(), "p1-ids"), BROADCAST_KEYS)
    bad = residue.records_with_weights(questions.join(some, "id", "left_semi"), model)
    return cases.join(bad.select("id").distinct(), "id", "left_anti")


def found(questions: DataFrame) -> DataFrame:
    return truncated(questions).select("id").distinct()


def by_source(questions: DataFrame) -> DataFrame:
    """(source, explanations, truncated, share) of every source; explanations are those that are not null or blank."""
    cut = truncated(questions).groupBy("source").agg(F.countDistinct("id").alias("truncated"))
    totals = questions.filter("explanation is not null and trim(explanation) <> ''").groupBy("source").agg(F.count("*").alias("explanations"))
    rows = totals.join(cut, totals.source.eqNullSafe(cut.source), "left").select(totals.source, "explanations", F.coalesce("truncated", F.lit(0).cast("long")).alias("truncated"))
    return rows.withColumn("share", F.col("truncated") / F.col("explanations"))
