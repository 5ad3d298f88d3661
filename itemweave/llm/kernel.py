"""Vectorised text kernel: whole Arrow batches as flat code-point arrays.

Every helper works on one batch (bounded by spark.sql.execution.arrow.maxRecordsPerBatch),
never on a whole table. "Letters and digits" are the Unicode categories L* and N*.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPAN = 0x32400  # last assigned ideograph block ends below; everything above is no letter here
_TABLES: dict[str, np.ndarray] = {}

ROWS, BYTES = 2000, 1 << 22

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


def tables() -> tuple[np.ndarray, np.ndarray]:
    """(keep, lower): letter-or-number flags and simple lower case by code point."""
    if not _TABLES:
        keep = np.zeros(0x110000, bool)
        lower = np.arange(0x110000, dtype=np.uint32)
        for c in range(_SPAN):
            ch = chr(c)
            if unicodedata.category(ch)[0] in "LN":
                keep[c] = True
                low = ch.lower()
                if low != ch:
                    lower[c] = ord(low[0])
        _TABLES["keep"], _TABLES["lower"] = keep, lower
    return _TABLES["keep"], _TABLES["lower"]


def bounded(batches: Iterator[pa.RecordBatch], column: str, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows and BYTES bytes of the column (one row at least), so that long texts bound memory too.

    The column holds texts or lists of texts.
    """
    for batch in batches:
        values = batch.column(column)
        if pa.types.is_list(values.type):
            flat = pc.fill_null(pc.binary_length(values.flatten()), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.r_[0, flat])[np.cumsum(pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False))]
        else:
            ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + BYTES, side="right"))))
            yield batch.slice(at, end - at)
            at = end


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat code points of all texts and the text number of each."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.repeat(np.arange(len(texts)), lens)


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As codepoints(), lower case, with everything but letters and digits dropped."""
    keep, lower = tables()
    flat, no = codepoints(texts)
    ok = keep[flat]
    return lower[flat[ok]], no[ok]


def trigrams(texts: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every run of three letters or digits inside one text, packed without loss into 63 bits, with its owner."""
    flat, no = letters(texts)
    if len(flat) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = no[:-2] == no[2:]
    c = flat.astype(np.uint64)
    gram = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    return gram[inside], owner[no[:-2][inside]]


def distinct(gram: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of each of n < 4096 owners as 52-bit values, and the n + 1 offsets of the owners."""
    packed = np.sort((owner.astype(np.uint64) << np.uint64(52)) | (mix64(gram) >> np.uint64(12)))
    if len(packed):
        packed = packed[np.r_[True, packed[1:] != packed[:-1]]]
    off = np.searchsorted(packed >> np.uint64(52), np.arange(n + 1, dtype=np.uint64))
    return packed & np.uint64(0xFFFFFFFFFFFFF), off


def distinct_sizes(gram: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The number of distinct grams (52-bit values of distinct()) of each owner."""
    packed = np.sort((owner.astype(np.uint64) << np.uint64(52)) | gram)
    if not len(packed):
        return np.zeros(n, np.int64)
    packed = packed[np.r_[True, packed[1:] != packed[:-1]]]
    return np.bincount((packed >> np.uint64(52)).astype(np.int64), minlength=n)


def hyperminhash(gram: np.ndarray, owner: np.ndarray, n: int, seeds: int, bits: int, mantissa: int) -> np.ndarray:
    """n x (seeds * 2**bits) registers of 16 bits; 0 marks an owner without grams.

    Each seed splits the hashes into 2**bits buckets by their top bits. A bucket keeps the minimum of the rest as
    (leading zeros, mantissa bits), as HyperMinHash does. Empty buckets borrow from a full one chosen by a fixed probe
    sequence (optimal densification), so a register still agrees with probability J for small sets.
    """
    m = 1 << bits
    out = np.zeros((n, seeds * m), np.uint16)
    if not len(gram):
        return out
    some = np.zeros(n, bool)
    some[owner] = True
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for s in range(seeds):
        h = mix64(gram + np.uint64(0x9E3779B97F4A7C15 * (s + 1) & 0xFFFFFFFFFFFFFFFF))
        cell = owner * m + (h >> np.uint64(64 - bits)).astype(np.int64)
        low = np.full(n * m, full, np.uint64)
        np.minimum.at(low, cell, h << np.uint64(bits))
        low = low.reshape(n, m)
        empty = (low == full) & some[:, None]
        cols, filled = np.arange(m, dtype=np.uint64), low.copy()
        rows = np.flatnonzero(empty.any(axis=1))
        for t in range(4 * m):
            if not len(rows):
                break
            src = (mix64(cols * np.uint64(0x10001) + np.uint64(977 * t + 13 * s + 1)) >> np.uint64(64 - bits)).astype(np.int64)
            offer = low[rows][:, src]
            take = empty[rows] & (offer != full)
            filled[rows] = np.where(take, offer, filled[rows])
            empty[rows] &= ~take
            rows = rows[empty[rows].any(axis=1)]
        lz = 63 - np.floor(np.log2(np.maximum(filled, np.uint64(1)).astype(np.float64))).astype(np.int64)
        lz = np.clip(lz, 0, 60)
        part = ((filled << (lz + 1).astype(np.uint64)) >> np.uint64(64 - mantissa)).astype(np.uint16)
        reg = (((lz + 1).astype(np.uint16) << np.uint16(mantissa)) | part).astype(np.uint16)
        out[:, s * m : (s + 1) * m] = np.where(some[:, None], reg, np.uint16(0))
    return out


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` registers; the band number is part of the key."""
    n, k = registers.shape
    bands = k // rows
    key = np.zeros((n, bands), np.uint64)
    for r in range(rows):
        key = mix64(key * np.uint64(31) + registers[:, r : bands * rows : rows].astype(np.uint64) + np.uint64(1))
    return mix64(key + np.arange(bands, dtype=np.uint64)[None, :])
