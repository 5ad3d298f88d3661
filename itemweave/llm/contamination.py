"""Evaluation texts leaking into training text: a prefix-filtered join over letter shingles.

A document leaks an item if both hold a run of RUN letters or digits. Any such run is one of the item's windows of RUN
characters, and all shingles of that window are in the document. So it is enough to join, for every window, its rarest
shingle (the necessary prefix under the order by rarity in the documents), and to verify the runs around each hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemweave.llm import kernel as K

RUN, SHINGLE = 40, 20
BLOCK_CHARS = 1_000_000  # letters, and so shingles, of the items that travel to the executors at once; more items are taken in blocks
_CHARS = 1 << 20


def shingles(flat: np.ndarray, no: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every run of SHINGLE letters inside one text."""
    if len(flat) < SHINGLE:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, width = flat.astype(np.uint64), 1
    parts = {1: h}
    while width * 2 <= SHINGLE:
        h = K.mix64(h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:])
        width *= 2
        parts[width] = h
    n, at, out = len(flat) - SHINGLE + 1, 0, np.zeros(len(flat) - SHINGLE + 1, np.uint64)
    for width in sorted(parts, reverse=True):
        if SHINGLE & width:
            out = K.mix64(out * np.uint64(31) + parts[width][at : at + n])
            at += width
    inside = np.flatnonzero(no[: len(flat) - SHINGLE + 1] == no[SHINGLE - 1 :])
    return out[inside], inside


class Items:
    """The letters of a block of items, flat, with their shingles in hash order."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = np.array(ids, np.int64)
        self.flat, self.no = K.letters(texts)
        self.off = np.searchsorted(self.no, np.arange(len(texts) + 1))
        self.hash, self.at = shingles(self.flat, self.no)
        self.use(np.ones(len(self.hash), bool))

    def use(self, chosen: np.ndarray) -> None:
        """Join only the chosen shingles from now on."""
        order = np.argsort(self.hash[chosen], kind="stable")
        self.keys, self.places = self.hash[chosen][order], self.at[chosen][order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def prefixes(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Which shingles are the rarest of some window of RUN letters; ties go to the smaller hash, then the earlier place."""
        by = np.argsort(keys)
        keys, counts = keys[by], counts[by]
        own = self.hash.view(np.int64)
        k = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        rank = np.where(keys[k] == own, counts[k], 0) if len(keys) else np.zeros(len(own), np.int64)
        order = np.lexsort((self.at, self.hash, rank))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        w = RUN - SHINGLE + 1
        chosen = np.zeros(len(order), bool)
        if len(order) >= w:
            same = self.at[w - 1 :] - self.at[: len(order) - w + 1] == w - 1
            same &= self.no[self.at[w - 1 :]] == self.no[self.at[: len(order) - w + 1]]
            windows = np.lib.stride_tricks.sliding_window_view(place, w)[same]
            chosen[order[windows.min(axis=1)]] = True
        return chosen

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(letters, text numbers, hit places in the letters, ranks of the hit keys)."""
        flat, no = K.letters(texts)
        h, at = shingles(flat, no)
        maybe = self.bits[(h >> np.uint64(44)).astype(np.int64)]
        h, at = h[maybe], at[maybe]
        k = np.searchsorted(self.keys, h)
        ok = k < len(self.keys)
        ok[ok] = self.keys[k[ok]] == h[ok]
        return flat, no, at[ok], k[ok]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """Documents in chunks of bounded length (one document at least)."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= _CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def _leaks(documents: DataFrame, items: Items) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(items.keys), np.int64)
        for _, texts in _texts(batches):
            _, _, _, k = items.hits(texts)
            seen += np.bincount(k, minlength=len(seen))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(items.keys[some].view(np.int64)), pa.array(seen[some])], ["key", "n"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batches):
            flat, no, at, k = items.hits(texts)
            out, done = [], set()
            starts = np.searchsorted(no, np.arange(len(texts) + 1))
            for p, first in zip(at.tolist(), k.tolist()):
                same = first
                while same < len(items.keys) and items.keys[same] == items.keys[first]:
                    q = int(items.places[same])
                    item, doc = int(items.no[q]), int(no[p])
                    same += 1
                    if (doc, item) in done:
                        continue
                    # positional bounds: the run can reach as far as both texts do on this diagonal
                    left = min(p - starts[doc], q - items.off[item])
                    right = min(starts[doc + 1] - p, items.off[item + 1] - q)
                    if left + right < RUN:
                        continue
                    equal = flat[p - left : p + right] == items.flat[q - left : q + right]
                    wrong = np.flatnonzero(~equal)
                    lo = wrong[wrong < left].max() + 1 if (wrong < left).any() else 0
                    hi = wrong[wrong >= left].min() if (wrong >= left).any() else len(equal)
                    if hi - lo >= RUN:
                        done.add((doc, item))
                        out.append((ids[doc], int(items.ids[item])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["doc_id", "item_id"])

    texts = documents.filter(F.length("text") >= RUN).select("doc_id", "text")
    counts = texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rarity = counts.toArrow()  # two numbers for each shingle of the block's items, BLOCK_CHARS at most, none of the documents'
    items.use(items.prefixes(rarity.column("key").to_numpy(), rarity.column("n").to_numpy()))
    return texts.mapInArrow(join, "doc_id long, item_id long").distinct()


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): every document that shares a run of 40 letters or digits with an item.

    Texts shorter than that, null or empty, and items of that kind, match nothing. The items go to the executors in blocks of
    BLOCK_CHARS letters; each block is one pass over the documents, so their number isn't bounded. Repeated rows change nothing.
    """
    found, ids, texts, size = None, [], [], 0
    rows = items.filter(F.length("text") >= RUN).select("item_id", "text").orderBy("item_id").toLocalIterator()
    for row in rows:
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text)
        if size >= BLOCK_CHARS:
            part = _leaks(documents, Items(ids, texts))
            found = part if found is None else found.unionByName(part)
            ids, texts, size = [], [], 0
    if ids or found is None:
        part = _leaks(documents, Items(ids, texts))
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, documents): the items that leaked and how many documents hold them."""
    return leaks(documents, items).groupBy("item_id").agg(F.count("*").alias("documents"))
