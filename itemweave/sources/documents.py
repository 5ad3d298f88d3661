"""Paragraphs of word-processor files: zip and XML from the standard library, one file per row."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_FALLBACK = "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _levels(archive: zipfile.ZipFile) -> dict[tuple[str, str], tuple[str, str, int]]:
    """(list, level) -> (number format, label pattern, start)."""
    if "word/numbering.xml" not in archive.namelist():
        return {}
    root = ElementTree.fromstring(archive.read("word/numbering.xml"))
    abstract = {}
    for a in root.iter(f"{_W}abstractNum"):
        for level in a.iter(f"{_W}lvl"):
            get = lambda tag, default, level=level: next((e.get(f"{_W}val") for e in level.iter(f"{_W}{tag}")), default)
            abstract[a.get(f"{_W}abstractNumId"), level.get(f"{_W}ilvl")] = (get("numFmt", "decimal"), get("lvlText", "%1."), int(get("start", "1")))
    out = {}
    for n in root.iter(f"{_W}num"):
        ref = next((e.get(f"{_W}val") for e in n.iter(f"{_W}abstractNumId")), None)
        out |= {(n.get(f"{_W}numId"), level): v for (a, level), v in abstract.items() if a == ref}
    return out


_ROMAN = ((10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def _shown(kind: str, value: int) -> str:
    """A list number in the form its level asks for; formats that are not known are decimal."""
    if kind.endswith("Letter"):
        text = chr(96 + (value - 1) % 26 + 1) * ((value - 1) // 26 + 1)
    elif kind.endswith("Roman") and value < 40:
        text, left = "", value
        for size, sign in _ROMAN:
            while left >= size:
                text, left = text + sign, left - size
    else:
        return str(value)
    return text.upper() if kind.startswith("upper") else text


def _own(node, tag: str) -> Iterator:
    """The elements of a paragraph with the tag, without those of paragraphs inside it and of fallback copies."""
    for child in node:
        if child.tag in (f"{_W}p", _FALLBACK):
            continue
        if child.tag == f"{_W}{tag}":
            yield child
        yield from _own(child, tag)


def _each(node) -> Iterator:
    """All paragraphs in document order, those of text boxes after the one that holds them; fallback copies are skipped."""
    for child in node:
        if child.tag == _FALLBACK:
            continue
        if child.tag == f"{_W}p":
            yield child
        yield from _each(child)


def paragraphs(data: bytes, noise: str | None = None) -> list[str]:
    """The non-empty paragraphs in document order, tables and text boxes included, with automatic numbers written out.

    A label may name several levels (%1.%2); a number on one level starts the deeper ones anew. Paragraphs in which the
    pattern `noise` is found are left out, after they were counted.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        levels = _levels(archive)
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    counts: dict[tuple[str, int], int] = {}
    out = []
    for p in _each(root):
        text = "".join(t.text or "" for t in _own(p, "t")).strip()
        if not text:
            continue
        num = next((e.get(f"{_W}val") for e in _own(p, "numId")), None)
        level = int(next((e.get(f"{_W}val") for e in _own(p, "ilvl")), "0"))
        if num and (num, str(level)) in levels:
            kind, label, start = levels[num, str(level)]
            counts[num, level] = counts.get((num, level), start - 1) + 1
            for deeper in [k for k in counts if k[0] == num and k[1] > level]:
                del counts[deeper]
            for n in range(level + 1):
                of, _, first = levels.get((num, str(n)), ("decimal", "", 1))
                label = label.replace(f"%{n + 1}", _shown(of, counts.get((num, n), first)))
            text = label + text
        if not (noise and re.search(noise, text)):
            out.append(text)
    return out


def read_paragraphs(spark: SparkSession, path: str, noise: str | None = None) -> DataFrame:
    """(path, pos, text) of every paragraph without `noise`; a file that isn't a word-processor file gives one row with pos -1 and its error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                try:
                    rows = [(name, i, t) for i, t in enumerate(paragraphs(bytes(data), noise))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows = [(name, -1, repr(e))]
                yield pd.DataFrame(rows, columns=["path", "pos", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, pos int, text string")
