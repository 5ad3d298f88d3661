"""Splitting oversized documents at natural boundaries by dynamic programming."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemweave.llm import kernel as K
from itemweave.llm.tokens import encoding, token_ends, vocabulary

#: What a cut costs by the boundary it falls on: blank line, line, sentence, clause, space, none.
PENALTIES = (0.0, 1.0, 2.0, 6.0, 12.0, 40.0)
IMBALANCE = 8.0  # weight of a piece's squared relative distance from the mean piece
_BOUNDARIES = (r"\n\s*\n", r"\n", r"[。！？!?…]+[”’」』）)\"]*\s*|\.(?=\s)\s*", r"[，；：、,;:]\s*", r"\s+")
_COMPILED = [re.compile(x) for x in _BOUNDARIES]


def boundary_penalties(text: str) -> np.ndarray:
    """The cost of a cut before each character (and at the end). White space after a mark may go to either side of the cut."""
    cost = np.full(len(text) + 1, PENALTIES[-1])
    for pattern, penalty in zip(_COMPILED[::-1], PENALTIES[-2::-1]):
        for m in pattern.finditer(text):
            found = m.group()
            for at in {m.end(), m.start() + len(found.rstrip())}:
                if at and penalty < cost[at]:
                    cost[at] = penalty
    return cost


def cuts(ends: np.ndarray, cost: np.ndarray, limit: int, overlap: int) -> list[int] | None:
    """Token positions at which pieces end (the last is the number of tokens), or None if no cut satisfies the limit.

    A piece that ends at j after one that ended at i holds the tokens i - overlap .. j. The program minimises the sum of
    cut costs and IMBALANCE * (size / mean - 1)**2 over all sequences of positions that are kept: sentence ends and stronger
    boundaries, weaker ones inside gaps wider than half a step, and 64 places of a step where there is no boundary at all.
    Over all positions the sum could be smaller by a little; tests/llm states by how much.
    """
    n = len(ends)
    step = limit - overlap
    pieces = max(1, -(-(n - overlap) // step))
    mean = (n - overlap) / pieces + overlap
    allowed = np.flatnonzero(ends >= 0) + 1  # a cut after a token that ends a character
    price = cost[ends[allowed - 1]]
    keep = (price <= PENALTIES[2]) | (allowed == n)
    for level in (*PENALTIES[3:5], None):  # weaker boundaries only inside gaps that the stronger ones leave too wide
        at = np.r_[overlap, allowed[keep]]
        wide = np.flatnonzero(np.diff(at) > step // 2)
        if not len(wide):
            break
        gap = np.searchsorted(at[wide], allowed, side="left") - 1
        inside = (gap >= 0) & (allowed < at[wide + 1][gap])
        if level is None:  # no boundary at all: every place costs the same, so a grid of places is enough
            grid = allowed // max(1, step // 64)
            keep |= inside & np.r_[True, grid[1:] != grid[:-1]]
        else:
            keep |= inside & (price <= level)
    at, c = allowed[keep], price[keep]
    at, c = np.r_[0, at[at > overlap]], np.r_[0.0, c[at > overlap]]
    best, back = np.full(len(at), np.inf), np.zeros(len(at), np.int64)
    best[0] = 0.0
    low = np.searchsorted(at, at - step)
    for j in range(1, len(at)):
        i = np.arange(low[j], j)
        if at[j] <= limit and (not len(i) or i[0] != 0):
            i = np.r_[0, i]
        if not len(i):
            continue
        size = at[j] - at[i] + np.where(at[i] > 0, overlap, 0)
        total = best[i] + IMBALANCE * (size / mean - 1) ** 2
        k = int(np.argmin(total))
        best[j], back[j] = total[k] + (c[j] if at[j] < n else 0.0), i[k]
    if at[-1] != n or not np.isfinite(best[-1]):
        return None
    out, j = [], len(at) - 1
    while j:
        out.append(int(at[j]))
        j = back[j]
    return out[::-1]


def split(enc, text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces in characters; a text within the limit is one piece.

    A piece is tokenised on its own once more, because merges differ at its edges; should one exceed the limit, the whole
    text is cut again with a limit lower by the excess.
    """
    ends = token_ends(enc, text)
    if len(ends) <= limit:
        return [(0, len(text), len(ends))]
    cost, room = boundary_penalties(text), limit
    while room > overlap + 1:
        at = cuts(ends, cost, room, overlap)
        if at is None:
            break
        pieces, start = [], 0
        for p in at:
            end = int(ends[p - 1])
            pieces.append((start, end, len(enc.encode_ordinary(text[start:end]))))
            k = p - overlap
            while k > 0 and ends[k - 1] < 0:
                k -= 1
            start = int(ends[k - 1]) if k > 0 else 0
        worst = max(x[2] for x in pieces)
        if worst <= limit:
            return pieces
        room -= worst - limit
    return _plain_cuts(enc, text, ends, limit, overlap)


def _plain_cuts(enc, text: str, ends: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces that each take as many tokens as fit, wherever they end: for texts in which no boundary leaves room.

    The overlap shrinks where a piece would otherwise not go beyond the one before.
    """
    places = [0, *dict.fromkeys(int(e) for e in ends if e > 0)]  # where a token ends a character
    size = lambda a, b: len(enc.encode_ordinary(text[places[a] : places[b]]))
    out, start, done, last = [], 0, 0, len(places) - 1
    while done < last:
        end = max(done + 1, min(last, start + limit))
        while (over := size(start, end) - limit) > 0 and (end > done + 1 or start < done):
            if end > done + 1:
                end = max(done + 1, end - max(1, over // 2))
            else:
                start += 1
        out.append((places[start], places[end], size(start, end)))
        start, done = max(start + 1, end - overlap), end
    return out


def pieces(documents: DataFrame, limits: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece_no, pieces, start, end, tokens, text): the pieces of every document over max_tokens, in order.

    Every piece but the first repeats the last overlap_tokens tokens of the one before (a few more bytes where a token ends
    inside a character). Null and empty texts, and documents within the limit, give no rows. `limits` is one row.
    """
    row = limits.orderBy("policy").first()
    if row is None:
        raise ValueError("split_limits has no row")
    limit, overlap, vocab = row.max_tokens, row.overlap_tokens, vocabulary(tokenizer)
    if limit <= overlap + 1:
        raise ValueError(f"limit {limit} and overlap {overlap} leave no room")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocab)
        for batch in K.bounded(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = split(enc, text, limit, overlap)
                if len(found) > 1:
                    n = len(found)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([doc] * n, pa.int64()), "piece_no": pa.array(range(1, n + 1), pa.int32()), "pieces": pa.array([n] * n, pa.int32()),
                            "start": pa.array([x[0] for x in found], pa.int32()), "end": pa.array([x[1] for x in found], pa.int32()),
                            "tokens": pa.array([x[2] for x in found], pa.int32()), "text": pa.array([text[x[0] : x[1]] for x in found], pa.string()),
                        }
                    )

    # a token has one byte at least, so a text of max_tokens bytes can't be over the limit
    larger = documents.filter(F.octet_length("text") > limit).select("doc_id", "text")
    return larger.mapInArrow(cut, "doc_id long, piece_no int, pieces int, start int, end int, tokens int, text string")


def oversized(documents: DataFrame, limits: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id) of the documents that had to be cut."""
    return pieces(documents, limits, tokenizer).filter("piece_no = 2").select("doc_id").distinct()
