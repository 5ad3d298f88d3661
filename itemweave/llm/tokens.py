"""Token counts with a public byte-level vocabulary; its file is a parameter and is never part of this package."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from itemweave.llm import kernel as K

DEFAULT_FILE = "byte_bpe_multi_50k.tiktoken"
_ENCODINGS: dict[str, tiktoken.Encoding] = {}
_LENGTHS: dict[int, np.ndarray] = {}


def vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """(ranks file, pre-token pattern), read by the driver and sent along with the functions that need it."""
    import public_tokenizers

    with open(path or public_tokenizers.path(DEFAULT_FILE), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def encoding(vocab: tuple[bytes, str]) -> tiktoken.Encoding:
    key = hashlib.sha1(vocab[0]).hexdigest() + vocab[1]
    if key not in _ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocab[0].splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=vocab[1], mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def _lengths(enc: tiktoken.Encoding) -> np.ndarray:
    """The bytes of each token."""
    if id(enc) not in _LENGTHS:
        _LENGTHS[id(enc)] = np.array([len(enc.decode_single_token_bytes(t)) for t in range(enc.n_vocab)])
    return _LENGTHS[id(enc)]


def token_ends(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """For each token the number of whole characters up to its end, -1 where it ends inside a character."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    chars = np.cumsum((data & 0xC0) != 0x80)
    ends = np.cumsum(_lengths(enc)[enc.encode_ordinary(text)])
    starts_char = np.r_[(data & 0xC0) != 0x80, True]
    return np.where(starts_char[ends], chars[ends - 1], -1) if len(ends) else np.zeros(0, np.int64)


def with_tokens(documents: DataFrame, path: str | None = None, text: bool = False) -> DataFrame:
    """(doc_id, source, tokens) of every document, and its text where asked for; a null text has 0 tokens."""
    vocab, more = vocabulary(path), ["text"] if text else []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocab)
        for batch in K.bounded(batches, "text", 10_000):
            n = pa.array([len(enc.encode_ordinary(x)) if x else 0 for x in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), n, *(batch.column(c) for c in more)], ["doc_id", "source", "tokens", *more])

    return documents.select("doc_id", "source", "text").mapInArrow(count, "doc_id long, source string, tokens long" + ", text string" * text)
