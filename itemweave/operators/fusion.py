"""Similarity, alignment and fusion of several readings of one source."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from itemweave.functions.text import match_ratio
from itemweave.session import written

LEAST_LENGTH, LEAST_RATIO = 12, 0.94
MOST_LOST = 20  # unmatched characters up to which a pair meets on parts of the alphabet; pairs of longer texts meet on runs
GRAM = 3  # characters of a run; longer ones are rarer, but a text may lack more of them
KEY_ROWS = 500_000  # keys made at a time

_KEY = "key long, k long, n int, bits long"
_EPS = 1e-6
_LOW, _HIGH = 2 * (1 - LEAST_RATIO) / (2 - LEAST_RATIO), 2 * (1 - LEAST_RATIO) / LEAST_RATIO  # unmatched characters of a pair for each one of a text: at its shortest and longest match


def _mix(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _alphabet_keys(batches):
    """Rows of _KEY for Arrow batches of (k, text); see near_matches."""
    for batch in batches:
        ks, texts = batch.column("k").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
        ns = np.array([len(t) for t in texts], dtype=np.int64)
        low, high = np.floor(ns * _LOW - _EPS), np.floor(ns * _HIGH + _EPS)
        for u in range(MOST_LOST + 1):
            s = 3 if u < 3 else 2
            sets = np.array(list(combinations(range(u + s), s)))
            at = np.flatnonzero((low <= u) & (u <= high) & (ns > 0))
            step = max(1, KEY_ROWS // len(sets))
            for rows in (at[i : i + step] for i in range(0, len(at), step)):
                n = ns[rows]
                chars = _mix(np.frombuffer("".join(texts[i] for i in rows).encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1))
                bits = np.bitwise_xor.reduceat(np.uint64(1) << (chars & np.uint64(63)), np.r_[0, np.cumsum(n)[:-1]])
                part = (chars >> np.uint64(6)) % np.uint64(u + s)
                parts = np.zeros((len(rows), u + s), dtype=np.uint64)
                np.add.at(parts, (np.repeat(np.arange(len(rows)), n), part.astype(np.int64)), _mix(chars))
                keys = np.tile(_mix(np.arange(len(sets), dtype=np.uint64) + np.uint64(1000 * u + 1)), (len(rows), 1))
                for j in range(s):
                    keys = _mix(keys + parts[:, sets[:, j]])
                each = lambda x: np.repeat(x, len(sets))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.ravel().view(np.int64), each(ks[rows]), each(n.astype(np.int32)), each(bits.view(np.int64)))], ["key", "k", "n", "bits"])


def _run_keys(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of _KEY for two tables of long texts (k, text, n); see near_matches."""
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - GRAM + 1), lambda i: F.xxhash64(F.substring(t, i, F.lit(GRAM))))
    grams = lambda df: df.select("k", "n", F.explode(runs(F.col("text"))).alias("g"))
    numbered = lambda df: grams(df).groupBy("k", "n", "g").agg(F.count("*").alias("m")).select("k", "n", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("j"), "g")
    ga, gb = numbered(a), numbered(b)
    rarity = ga.select("g", "j").unionByName(gb.select("g", "j")).groupBy("g", "j").agg(F.count("*").alias("df"))

    def prefix(df: DataFrame) -> DataFrame:
        loss = F.floor(F.col("n") * (2 * GRAM * (1 - LEAST_RATIO) / LEAST_RATIO) + _EPS)
        ranked = df.join(rarity, ["g", "j"]).withColumn("r", F.row_number().over(W.partitionBy("k").orderBy("df", "g", "j")))
        return ranked.filter(F.col("r") <= loss + 1).select(F.xxhash64("g", "j").alias("key"), "k", "n", F.lit(0).cast("long").alias("bits"))

    return prefix(ga), prefix(gb)


def near_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ka, kb): the pairs of texts of two tables (k, text, n) that can have a ratio of LEAST_RATIO; see near_matches."""
    keys = lambda df: df.select("k", "text").mapInArrow(_alphabet_keys, _KEY)
    left, right = keys(a), keys(b)
    long = F.floor(F.col("n") * _HIGH + _EPS) > MOST_LOST
    la, lb = a.filter(long), b.filter(long)
    if not la.isEmpty() and not lb.isEmpty():
        more = _run_keys(la, lb)
        left, right = left.unionByName(more[0]), right.unionByName(more[1])
    left = left.select("key", F.col("k").alias("ka"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = right.select("key", F.col("k").alias("kb"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    both = F.col("na") + F.col("nb")
    close = F.abs(F.col("na") - F.col("nb")) <= F.greatest(F.lit(8.0), F.col("na") * 0.2)
    lost = F.floor(both * (1 - LEAST_RATIO) + _EPS)
    alike = (F.abs(F.col("na") - F.col("nb")) <= lost) & (F.bit_count(F.col("ba").bitwiseXOR(F.col("bb"))) <= lost)
    return left.join(right.hint("merge"), "key").filter(close & alike).select("ka", "kb").distinct()


def near_matches(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, similar_to, ratio): for each text of `new` (id, text) of 12 characters or more the best match in `existing`, from a ratio of 0.94.

    Candidates differ in length by at most max(8, 20 %). With a ratio of r at most u = (1 - r)(a + b) characters of both
    texts are unmatched, and the others are the same in both. Each unmatched one changes what a text has of one part of the
    alphabet only: of u + s parts at least s hold the same characters in both. So a text is given a key for every s of
    the u + s parts, for each u that it can have with a match, and pairs are joined on keys. The parity of the characters in each
    of 64 buckets differs in u places at most, which is seen without the texts. As the number of keys grows with u, texts that can
    have more than MOST_LOST are joined on runs of GRAM characters too: u characters break at most GRAM u of them, so one more
    than that of each text's rarest runs (prefix filter) loses no match. Equal texts are one candidate. Ties: smallest id.
    """
    def texts(df: DataFrame) -> DataFrame:
        one = df.groupBy("text").agg(F.min("id").alias("owner"))
        return one.withColumns({"n": F.length("text"), "k": F.xxhash64("text")})

    rows = written(new.filter(F.length("text") >= LEAST_LENGTH), "near-rows")
    a = written(texts(rows), "near-new")
    b = written(texts(existing.filter(F.length("text") >= int(LEAST_LENGTH * LEAST_RATIO / (2 - LEAST_RATIO)))), "near-old")
    pairs = written(near_candidates(a, b), "near-pairs", free=True)
    both = pairs.join(a.select(F.col("k").alias("ka"), F.col("text").alias("ta")).hint("merge"), "ka").join(b.select(F.col("k").alias("kb"), F.col("text").alias("tb"), F.col("owner").alias("similar_to")).hint("merge"), "kb")
    scored = both.withColumn("ratio", match_ratio("ta", "tb")).filter(F.col("ratio") >= LEAST_RATIO)
    best = scored.groupBy("ta").agg(F.min(F.struct((-F.col("ratio")).alias("minus"), "similar_to")).alias("x"))
    return rows.join(best, rows.text == best.ta).select("id", "x.similar_to", F.round(-F.col("x.minus"), 4).alias("ratio"))


def align(observed: list, expected: list) -> list:
    """For each expected number the position of the observed record aligned with it, or None, by edit distance.

    A match costs 0 if the numbers agree, 1 if the observed one is unknown (None), 2 otherwise; a skip on either side 3.
    Equal costs prefer a match, then skipping the expected number.
    """
    n, m = len(observed), len(expected)
    cost = [[3 * (i + j) if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            own = 1 if observed[i - 1] is None else 0 if observed[i - 1] == expected[j - 1] else 2
            cost[i][j] = min(cost[i - 1][j - 1] + own, cost[i - 1][j] + 3, cost[i][j - 1] + 3)
    out, i, j = [None] * m, n, m
    while i or j:
        if i and j:
            own = 1 if observed[i - 1] is None else 0 if observed[i - 1] == expected[j - 1] else 2
            if cost[i][j] == cost[i - 1][j - 1] + own:
                i, j = i - 1, j - 1
                out[j] = i
                continue
        if j and cost[i][j] == cost[i][j - 1] + 3:
            j -= 1
        else:
            i -= 1
    return out


def align_sequences(observed: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """(*by, number, pos): for each expected number the position of the observed record, null if none; one task per sequence.

    observed: (*by, pos, number or null); expected: (*by, ord, number). A sequence is one paper, a few hundred numbers.
    """
    left = observed.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "number"))).alias("seen"))
    right = expected.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", "number"))).alias("wanted"))
    rows = right.join(left, by, "left")

    def run(batches):
        for pdf in batches:
            out = []
            for rec in pdf.itertuples(index=False):
                seen = list(rec.seen) if rec.seen is not None else []
                number = lambda x: None if x["number"] is None or x["number"] != x["number"] else int(x["number"])
                found = align([number(x) for x in seen], [int(x["number"]) for x in rec.wanted])
                keys = [getattr(rec, k) for k in by]
                out += [(*keys, int(w["number"]), None if f is None else int(seen[f]["pos"])) for w, f in zip(rec.wanted, found)]
            frame = pd.DataFrame(out, columns=[*by, "number", "pos"])
            frame["pos"] = frame["pos"].astype("Int64")
            yield frame

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in by) + ", number int, pos int")


def fuse_letters(first: Column, second: Column, repair: Column | None = None) -> Column:
    """A repaired letter, else the one both readings agree on or only one has; a conflict or no valid letter gives null."""
    valid = lambda c: F.when(c.isin("A", "B", "C", "D", "E"), c)
    a, b = valid(first), valid(second)
    fused = F.when(a.isNotNull() & b.isNotNull() & (a != b), F.lit(None)).otherwise(F.coalesce(a, b))
    return fused if repair is None else F.coalesce(repair, fused)


def choose_text(first: Column, second: Column) -> Column:
    """The first reading unless it is blank, then the second."""
    return F.coalesce(F.nullif(F.trim(first), F.lit("")), F.trim(second))
