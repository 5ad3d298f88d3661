"""A regularised logistic model on hashed character n-grams, in numpy: fitted on a bounded sample, applied to whole batches."""

from __future__ import annotations

import numpy as np

from itemweave.llm import kernel as K

BITS = 18
_SIZE = 1 << BITS


def _slots(h: np.ndarray) -> np.ndarray:
    return (K.mix64(h) >> np.uint64(64 - BITS)).astype(np.int64)


def ngrams(texts: list[str], longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(slot, text number) of every 1..longest-gram; digits count as 0, texts are fenced by marks."""
    flat, no = K.codepoints(["\x02" + t + "\x03" for t in texts])
    flat = np.where((flat >= 48) & (flat < 58), np.uint32(48), flat).astype(np.uint64)
    slots, owners = [], []
    key = flat
    for n in range(1, longest + 1):
        if n > 1:
            key = key[:-1] * np.uint64(0x100000001B3) + flat[n - 1 :]
        inside = no[: len(key)] == no[n - 1 :]
        slots.append(_slots(key[inside] + np.uint64(n << 60)))
        owners.append(no[: len(key)][inside])
    return np.concatenate(slots), np.concatenate(owners)


def named(values: np.ndarray, kind: int) -> np.ndarray:
    """Slots of one integer feature per text."""
    return _slots(values.astype(np.uint64) + np.uint64(kind << 50))


def scores(weights: np.ndarray, slot: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    size = np.maximum(np.bincount(owner, minlength=n), 1)
    return weights[_SIZE] + np.bincount(owner, weights=weights[slot], minlength=n) / np.sqrt(size)


def fit(slot: np.ndarray, owner: np.ndarray, label: np.ndarray, weight: np.ndarray, penalty: float, rounds: int) -> np.ndarray:
    """Weights (the last is the intercept) by full-batch Adam on the weighted logistic loss with an L2 penalty."""
    n = len(label)
    used, slot = np.unique(slot, return_inverse=True)
    inv = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
    each = inv[owner]
    w, b = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    weight = weight / weight.sum()
    for t in range(1, rounds + 1):
        z = b + np.bincount(owner, weights=w[slot] * each, minlength=n)
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
        gw = np.bincount(slot, weights=g[owner] * each, minlength=len(used)) + penalty * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = 0.1 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-9)
        b -= step * mb / (np.sqrt(vb) + 1e-9)
    out = np.zeros(_SIZE + 1)
    out[used], out[_SIZE] = w, b
    return out
