"""Near-duplicate items: HyperMinHash banding, estimates inside the buckets, exact verification.

A content is the bag of three-letter runs of stem, explanation and options. Equal contents share one content key, so
copies travel as one row; bands, candidates and verification concern different contents only. Links are listed between
contents and expanded to records at the end, because the result is defined on records. A record without any run has no
content, so it is no copy of other such records.

Unrelated contents written from one template meet in a band by chance, and such meetings grow with the square of the table.
So a pair is never listed before it is judged: each entry of a bucket carries a sketch of one bit a register, and only pairs
whose sketches agree leave the task. The bands go through the shuffle in rounds, whose files are deleted one after the other.

Bands that very many contents share are found in a sample and don't travel. Their contents are joined by an exact prefix
filter instead: each content's rarest runs, as many as a pair at the threshold must have in common.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from itemweave.functions.identity import option_values, stripped
from itemweave.llm import kernel as K
from itemweave.operators.components import connected_components
from itemweave.operators.skew import lookup_join
from itemweave.session import discarded, written

SEEDS, BITS, MANTISSA = 12, 5, 10  # 384 registers in groups of 32, which even short texts fill
ROWS = 6  # registers to a band: 64 bands; of 13,558 pairs among 200,000 questions they miss one, at 0.66
SKETCH_SEEDS, SKETCH_MANTISSA = 2, 4  # registers used for the estimate
THRESHOLD = 0.6
SLACK = 0.2  # an estimate is off by less than this, 3 standard deviations of 64 registers
BANDS = (SEEDS << BITS) // ROWS
ROUNDS = 8  # shuffles one after the other, each of an equal share of the bands
MARKS = SEEDS << BITS  # one bit of each register is an entry's sketch
MARK_DEVIATIONS = 3.5  # their estimate may be off by so many standard deviations
ENTRIES = 1 << 16  # entries of buckets that one task holds at once, on average
ENTRY = np.dtype([("band", "<u4"), ("content", "<i8"), ("marks", "<u8", (MARKS // 64,)), ("limit", "<i2")])
BUCKET_CAP = 1024  # contents of a bucket compared at once; larger buckets are compared piece by piece
VERIFIED = 500_000  # pairs, or a quarter of the contents if that is more, whose texts travel at once
SAMPLE = 64  # one content in so many, by its key, counts for finding hot bands before the shuffle
HOT_BAND = 100_000  # estimated contents of a band from which on it isn't shuffled at all; there are at most bands * contents / HOT_BAND
BROADCAST_IDS = 500_000  # ids that may be broadcast to pick the texts to verify


def _flat(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, int]:
    parts = batch.column("parts")
    lengths = np.diff(parts.offsets.to_numpy())
    return parts.flatten().to_pylist(), np.repeat(np.arange(len(lengths)), lengths), len(lengths)


def _content_keys(gram: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """64 bits that depend on the bag of grams only."""
    total = np.zeros(n, np.uint64)
    if len(gram):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        total[owner[starts]] = np.add.reduceat(K.mix64(gram), starts)
    return K.mix64(total).view(np.int64)


def _marks(registers: np.ndarray) -> np.ndarray:
    """n x MARKS / 64 words: one bit that depends on the register, for each register."""
    bits = K.mix64(registers.astype(np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.uint64)


def _limits(registers: np.ndarray) -> np.ndarray:
    """The number of differing marks up to which a content's partner may reach the threshold.

    Unequal registers have equal marks half the time, so n independent marks estimate a similarity of t with a deviation of
    sqrt((1 - t * t) / n). Short texts leave registers empty, which repeat others of their seed and count for nothing.
    """
    m = 1 << BITS
    some = np.sort(registers[:, : 4 * m].reshape(len(registers), 4, m), axis=2)  # four seeds tell
    own = 4 + (some[:, :, 1:] != some[:, :, :-1]).sum(axis=(1, 2))
    slack = MARK_DEVIATIONS * np.sqrt((1 - THRESHOLD * THRESHOLD) / (MARKS * own / (4 * m)))
    return np.minimum(MARKS, (1 - THRESHOLD + slack) * MARKS / 2).astype(np.int16)


def _sample_bands(bands: np.ndarray) -> np.ndarray:
    """The number of the band above 32 bits of its registers' hash."""
    return (np.arange(bands.shape[-1], dtype=np.int64) << 32) | bands.astype(np.int64)


def _entries(first: int, hot: np.ndarray, parts: int):
    """(part, entries) of (content, bands, marks, limit): the entries of each part in one value; those of the bands in `hot` are left out.

    `first` is the number of the first of these bands. A part is a range of the bands' hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, at = np.unique(batch.column("content").to_numpy(), return_index=True)  # copies within the batch go once
            if not len(content):
                continue
            bands, marks = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(batch.num_rows, -1)[at] for c, kind in (("bands", "<u4"), ("marks", "<u8")))
            limit = batch.column("limit").to_numpy()[at]
            keep = np.ones(bands.shape, bool)
            if len(hot):
                keep = ~np.isin(((first + np.arange(bands.shape[1], dtype=np.int64)) << 32) | bands.astype(np.int64), hot)
            row, column = np.nonzero(keep)
            band = bands[row, column]
            part = (band.astype(np.uint64) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            part, row = part[order], row[order]
            entries = np.empty(len(row), ENTRY)
            entries["band"], entries["content"], entries["marks"], entries["limit"] = band[order], content[row], marks[row], limit[row]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
            ends = (np.r_[starts, len(part)] * ENTRY.itemsize).astype(np.int32)
            values = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(entries.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), values], ["part", "entries"])

    return run


def _hot_contents(hot: np.ndarray):
    """The contents that have a band in `hot`."""
    names = [f"bands{k}" for k in range(ROUNDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(batch.num_rows, BANDS // ROUNDS) for c in names]
            hit = np.isin(_sample_bands(np.concatenate(bands, axis=1)), hot).any(axis=1)
            yield batch.select(["content"]).filter(pa.array(hit))

    return run


def _bucket_pairs(entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b), a < b: the contents of each bucket whose marks differ in no more places than the limit of one allows. A content that occurs several times in a bucket counts once."""
    entries = entries[np.lexsort((entries["content"], entries["band"]))]
    band, content = entries["band"], entries["content"]
    new = np.ones(len(entries), bool)
    new[1:] = (band[1:] != band[:-1]) | (content[1:] != content[:-1])
    entries = entries[new]
    starts = np.flatnonzero(np.r_[True, entries["band"][1:] != entries["band"][:-1]]) if len(entries) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(entries)])
    content, marks, limit = (np.ascontiguousarray(entries[c]) for c in ("content", "marks", "limit"))
    few = min(16, BUCKET_CAP)
    for m in np.unique(sizes[(sizes > 1) & (sizes <= few)]):
        i, j = np.triu_indices(int(m), 1)
        at = starts[sizes == m]
        step = max(1, 200_000 // len(i))
        for k in range(0, len(at), step):
            a, b = ((at[k : k + step, None] + x).ravel() for x in (i, j))
            good = np.bitwise_count(marks[a] ^ marks[b]).sum(axis=1, dtype=np.int16) <= np.maximum(limit[a], limit[b])
            yield content[a[good]], content[b[good]]
    for at, m in zip(starts[sizes > few], sizes[sizes > few]):
        for right in range(at, at + m, BUCKET_CAP):
            end = min(right + BUCKET_CAP, at + m)
            across = [np.ascontiguousarray(marks[right:end, w]) for w in range(marks.shape[1])]
            for left in range(at, end, 64):  # so many rows that a word's differences stay in the cache
                to = min(left + 64, end)
                differing = np.zeros((to - left, end - right), np.int16)
                for w, word in enumerate(across):
                    differing += np.bitwise_count(marks[left:to, w, None] ^ word)
                a, b = np.nonzero(differing <= np.maximum(limit[left:to, None], limit[right:end]))
                a, b = a + left, b + right
                yield content[a[a < b]], content[b[a < b]]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of (part, entries) sorted by part: the alike pairs of its buckets. Holds one part at a time."""

    def finish(values: list[bytes]):
        found, n = [], 0
        for pair in _bucket_pairs(np.frombuffer(b"".join(values), ENTRY)):
            found.append(pair)
            n += len(pair[0])
            if n > 1_000_000:
                yield pairs(found)
                found, n = [], 0
        if n:
            yield pairs(found)

    def pairs(found):
        both = np.unique(np.stack([np.concatenate(x) for x in zip(*found)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], ["a", "b"])

    now, values = None, []
    for batch in batches:
        for part, value in zip(batch.column("part").to_pylist(), batch.column("entries").to_pylist()):
            if part != now and values:
                yield from finish(values)
                values = []
            now = part
            values.append(value)
    if values:
        yield from finish(values)


def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the contents of each bucket from rows sorted by band: (-1, a, b).

    Holds at most one bucket up to BUCKET_CAP contents. The members of larger buckets pass through as (band, content, null).
    A content that occurs several times in a bucket counts once.
    """
    band_left, left, large = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def rows(bands, a, b):
        mask = np.zeros(len(a), bool) if b is not None else np.ones(len(a), bool)
        return pa.RecordBatch.from_arrays([pa.array(bands), pa.array(a), pa.array(a if b is None else b, mask=mask)], ["band", "a", "b"])

    def finish(band, content):
        starts = np.flatnonzero(np.r_[True, band[1:] != band[:-1]]) if len(band) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(band)])
        out_a, out_b = [], []
        for m in np.unique(sizes[sizes > 1]):
            i, j = np.triu_indices(int(m), 1)
            at = starts[sizes == m]
            step = max(1, 2_000_000 // len(i))
            for k in range(0, len(at), step):
                out_a.append(content[(at[k : k + step, None] + i).ravel()])
                out_b.append(content[(at[k : k + step, None] + j).ravel()])
        for a, b in zip(out_a, out_b):
            yield rows(np.full(len(a), -1, np.int64), a, b)

    for batch in batches:
        band = np.concatenate([band_left, batch.column("band").to_numpy()])
        content = np.concatenate([left, batch.column("content").to_numpy()])
        order = np.lexsort((content, band))
        band, content = band[order], content[order]
        new = np.ones(len(band), bool)
        new[1:] = (band[1:] != band[:-1]) | (content[1:] != content[:-1])
        band, content = band[new], content[new]
        if large is not None:
            still = band == large
            if still.any():
                yield rows(band[still], content[still], None)
            band, content = band[~still], content[~still]
            if len(band):
                large = None
        starts = np.flatnonzero(np.r_[True, band[1:] != band[:-1]]) if len(band) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(band)])
        for at, m in zip(starts[sizes > BUCKET_CAP], sizes[sizes > BUCKET_CAP]):
            yield rows(band[at : at + m], content[at : at + m], None)
        if len(sizes) and sizes[-1] > BUCKET_CAP:
            large = band[-1]
        small = np.repeat(sizes <= BUCKET_CAP, sizes)
        last = np.zeros(len(band), bool)
        if len(starts):
            last[starts[-1] :] = True
        yield from finish(band[small & ~last], content[small & ~last])
        band_left, left = band[small & last], content[small & last]
    yield from finish(band_left, left)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, item, content, marks, limit, sample, bands0, ...): content is null without runs, sample is null but for the contents of the sample."""
    for batch in K.bounded(batches, "parts"):
        texts, owner, n = _flat(batch)
        gram, owner = K.trigrams(texts, owner)
        registers = K.hyperminhash(gram, owner, n, SEEDS, BITS, MANTISSA)
        bands = (K.band_keys(registers, ROWS) >> np.uint64(32)).astype(np.uint32)
        none = np.ones(n, bool)
        none[owner] = False
        key = _content_keys(gram, owner, n)
        sample: list = [None] * n
        for i in np.flatnonzero(~none & (key % SAMPLE == 0)):
            sample[i] = _sample_bands(bands[i]).tolist()
        binary = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
        shares = [binary(np.ascontiguousarray(x)) for x in np.split(bands, ROUNDS, axis=1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("item"), pa.array(key, mask=none), binary(_marks(registers)), pa.array(_limits(registers)), pa.array(sample, pa.list_(pa.int64())), *shares],
            ["id", "item", "content", "marks", "limit", "sample", *(f"bands{k}" for k in range(ROUNDS))],
        )


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from two n x registers arrays: the share of equal registers less what chance makes equal.

    Two unrelated registers agree with the probability of equal leading zeros times equal mantissas,
    sum over z of (2**-z)**2 * 2**-mantissa = 2**-mantissa / 3.
    """
    chance = 2.0**-SKETCH_MANTISSA / 3
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.bounded(batches, "parts_a"):
        n = batch.num_rows
        grams, owners = [], []
        for side in ("parts_a", "parts_b"):
            parts = batch.column(side)
            texts, owner = parts.flatten().to_pylist(), np.repeat(np.arange(n), np.diff(parts.offsets.to_numpy()))
            gram, owner = K.trigrams(texts, owner)
            gram, off = K.distinct(gram, owner, n)
            grams.append(gram)
            owners.append(np.repeat(np.arange(n), np.diff(off)))
        size = sum(np.bincount(o, minlength=n) for o in owners)
        either = K.distinct_sizes(np.concatenate(grams), np.concatenate(owners), n)
        jaccard = (size - either) / np.maximum(either, 1)
        good = pa.array(jaccard >= THRESHOLD)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").filter(good), batch.column("b").filter(good), pa.array(jaccard).filter(good)], ["a", "b", "jaccard"]
        )


def _items(questions: DataFrame) -> DataFrame:
    stem, opts = F.coalesce("stem", F.lit("")), option_values(F.col("options"))
    parts = F.concat(F.array(stem, F.coalesce("explanation", F.lit(""))), F.transform(opts, lambda x: F.coalesce(x, F.lit(""))))
    item = F.xxhash64(F.concat_ws("\x1f", stripped(F.col("stem")), F.array_sort(F.transform(opts, stripped))))
    return questions.select("id", item.alias("item"), parts.alias("parts"))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(content, size, gram): the distinct runs of each content."""
    for batch in K.bounded(batches, "parts"):
        texts, owner, n = _flat(batch)
        gram, off = K.distinct(*K.trigrams(texts, owner), n)
        size = np.diff(off)
        content = batch.column("content").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(content, size)), pa.array(np.repeat(size, size).astype(np.int32)), pa.array(gram.astype(np.int64))], ["content", "size", "gram"])


def prefix_pairs(texts: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of the contents (content, parts) that can reach THRESHOLD; none that does is missing.

    Two sets with a Jaccard similarity of t share at least t / (1 + t) of their sizes' sum, so they share one of the first
    size - ceil(t * size) + 1 runs of both in any order; the order is by rarity. Sizes and the places of a shared run bound
    what else they can share. What runs all contents have in common is in no prefix, unless a content holds little else.
    """
    grams = written(texts.mapInArrow(_grams, "content long, size int, gram long"), "p7-grams", free=True)
    rarity = grams.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")  # a run of one content joins nothing
    rank = F.row_number().over(W.partitionBy("content").orderBy(F.coalesce("df", F.lit(1)), "gram"))  # as many rows as one text has runs
    ranked = grams.join(rarity, "gram", "left").withColumn("r", rank).filter("df is not null")
    first = written(ranked.filter(F.col("r") <= F.col("size") - F.ceil(F.col("size") * F.lit(THRESHOLD) - 1e-9) + 1).select("gram", "content", "size", "r"), "p7-prefix", free=True)
    side = lambda n: first.select("gram", F.col("content").alias(n), F.col("size").alias(f"s{n}"), F.col("r").alias(f"r{n}"))
    least = THRESHOLD / (1 + THRESHOLD) * (F.col("sa") + F.col("sb")) - 1e-9
    reach = 1 + F.least(F.col("sa") - F.col("ra"), F.col("sb") - F.col("rb"))
    return side("a").join(side("b"), "gram").filter("a < b").filter((F.least("sa", "sb") >= least) & (reach >= least)).select("a", "b").distinct()


def content_links(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, item, content) has every question; links (a, b, jaccard), a < b, every verified pair of contents."""
    items = _items(questions)
    shares = [f"bands{k}" for k in range(ROUNDS)]
    sketches = written(
        items.select("id", "item", "parts").mapInArrow(_sketches, "id string, item long, content long, marks binary, limit short, sample array<long>, " + ", ".join(f"{c} binary" for c in shares)), "p7-sketches"
    )
    every = written(sketches.select("id", "item", "content"), "p7-members")
    sample = sketches.filter("sample is not null").select("content", "sample").dropDuplicates(["content"]).select(F.explode("sample").alias("band"))
    hot = sample.groupBy("band").agg(F.count("*").alias("n")).filter(F.col("n") * SAMPLE >= HOT_BAND).select("band").collect()
    hot = np.array(sorted(r.band for r in hot), np.int64)
    members, sketches = every.filter("content is not null"), sketches.filter("content is not null")

    def speakers(contents: DataFrame, name: str) -> DataFrame:
        """(content, parts): one record speaks for each content, so texts are picked by id and nothing is hashed again."""
        ids = written(members.join(contents, "content").groupBy("content").agg(F.min("id").alias("id")), f"p7-{name}-ids", free=True)
        picked = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        return written(items.select("id", "parts").join(picked, "id").select("content", "parts").dropDuplicates(["content"]), f"p7-{name}", free=True)

    n = members.count()
    parts = max(12, -(-n * (BANDS // ROUNDS) // ENTRIES))
    rounds = []
    for k, share in enumerate(shares):
        entries = sketches.select("content", F.col(share).alias("bands"), "marks", "limit").mapInArrow(_entries(k * BANDS // ROUNDS, hot, parts), "part int, entries binary")
        met = entries.repartition("part").sortWithinPartitions("part").mapInArrow(_met, "a long, b long")
        rounds.append(written(met, f"p7-met{k}", free=True))
    plausible = reduce(DataFrame.unionByName, rounds)
    if len(hot):
        wide = written(sketches.mapInArrow(_hot_contents(hot), "content long").distinct(), "p7-wide", free=True)
        plausible = plausible.unionByName(prefix_pairs(speakers(wide, "wide-texts")))
    plausible = written(plausible.distinct(), "p7-plausible", free=True)
    discarded(sketches, *rounds)
    rounds = -(-plausible.count() // max(VERIFIED, n // 4)) or 1
    links = []
    for k in range(rounds):
        share = plausible.filter(F.pmod(F.xxhash64("a"), F.lit(rounds)) == k) if rounds > 1 else plausible
        texts = speakers(share.select(F.explode(F.array("a", "b")).alias("content")).distinct(), "texts")
        pairs = share.join(texts.select(F.col("content").alias("a"), F.col("parts").alias("parts_a")), "a").join(
            texts.select(F.col("content").alias("b"), F.col("parts").alias("parts_b")), "b"
        )
        links.append(written(pairs.mapInArrow(_verified, "a long, b long, jaccard double"), "p7-links", free=True))
        discarded(texts)
    return every, reduce(DataFrame.unionByName, links)


def near_duplicates(questions: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of different items with at least 60 % common content.

    Null stem, explanation or options count as empty; a record without any run of three letters has no partner;
    records of one item (equal letters of stem and options) are no pair even if their explanations differ. Records with
    one content are a pair if their items differ. Repeated rows change nothing; an empty table gives no rows.
    """
    members, links = content_links(questions)
    members = members.filter("content is not null")
    nodes = links.select(F.explode(F.array("a", "b")).alias("content")).distinct()
    within = members.groupBy("content").agg(F.countDistinct("item").alias("items"), F.count("*").alias("n"))
    # contents that are linked, or that hold several items
    wanted = within.join(nodes.withColumn("linked", F.lit(True)), "content", "left").filter("linked or items > 1")
    some = lookup_join(members, wanted.select("content", "n"), "content", "n").select("content", "item", "id").distinct()
    some = written(some.withColumn("unit", F.xxhash64("content", "item")), "p7-some", free=True)
    # links between units (one item's records of one content) first, so that no two records of one item ever meet
    units = some.select("content", "item", "unit").distinct()
    side = lambda k, n: units.select(F.col("content").alias(k), F.col("item").alias(f"item{n}"), F.col("unit").alias(f"unit{n}"))
    between = links.select("a", "b").join(side("a", 1), "a").join(side("b", 2), "b").filter("item1 <> item2").select("unit1", "unit2")
    inside = side("content", 1).join(side("content", 2), "content").filter("item1 < item2").select("unit1", "unit2")
    linked = written(between.unionByName(inside).distinct(), "p7-units", free=True)
    ids = lambda n: some.select(F.col("unit").alias(f"unit{n}"), F.col("id").alias(f"id{n}"))
    pairs = linked.join(ids(1), "unit1").join(ids(2), "unit2").filter("id1 <> id2")
    return pairs.select(F.least("id1", "id2").alias("id_a"), F.greatest("id1", "id2").alias("id_b")).distinct()


def near_duplicate_groups(questions: DataFrame) -> DataFrame:
    """(id, group_id, links): every question with the smallest id of its group and its content's number of linked contents.

    A record without any run of three letters is a group of its own.
    """
    every, links = content_links(questions)
    members = every.filter("content is not null")
    alone = every.filter("content is null").select("id", F.col("id").alias("group_id"), F.lit(0).cast("long").alias("links"))
    nodes = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("content")).groupBy("content").agg(F.count("*").alias("links"))
    member = members.join(nodes.withColumnRenamed("node", "content"), "content", "left").join(degree, "content", "left")
    member = member.select("id", F.coalesce("component", "content").alias("component"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    member = written(member, "p7-groups", free=True)
    names = member.groupBy("component").agg(F.min("id").alias("group_id"), F.count("*").alias("n"))
    return lookup_join(member, names, "component", "n").select("id", "group_id", "links").unionByName(alone)
