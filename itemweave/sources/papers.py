"""Exam papers as paragraphs: units, types, numbered questions, shared stems and options, answers and explanations.

A paper is cut into segments by its headings and numbers first; each segment is then read on its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from itemweave.schema import LETTERS

# The formats of headings, numbers, options and labels.
UNIT = re.compile(r"第\s*([一二三四])\s*单元")
TYPE = re.compile(r"(A1/A2|A3/A4|A3|B1?)\s*型题")
RANGE = re.compile(r"[（(]?\s*(\d{1,3})\s*[～~、至-]\s*(\d{1,3})\s*题?\s*共用(题干|备选答案)\s*[)）]?[：:]?\s*(.*)", re.DOTALL)
STEM = re.compile(r"共用题干[：:]\s*(.*)", re.DOTALL)
NUMBER = re.compile(r"(\d{1,3})\s*[.．、]\s*(?!\d)(.*)", re.DOTALL)
OPTION = re.compile(r"(?<![A-Za-z])([A-E])\s*[.．、]\s*")
LABEL = re.compile(r"[【\[]?\s*(答\s*案|解\s*析)\s*(?:[】\]]\s*[：:]?|[：:])\s*")
KEY = re.compile(r"(?:答案(?:解析)?|案)[】\]]*[：:]?([A-E])|^[【\[]?([A-E])(?:略|[。. ]|$)")
KEY_HEAD = re.compile(r"^.*?(?:答案(?:解析)?|案)[】\]]*[：:]?[A-E]")
EXPLANATION_HEAD = re.compile(r"[【\[]*\s*解\s*析\s*[】\]]*[：:]?\s*")
NEXT_NUMBER = re.compile(r"\s*\d{1,3}\s*[.．、]\s*$")
_UNITS = {c: n for n, c in enumerate("一二三四", 1)}
_TYPES = {"A3/A4": "A3", "B": "B1"}
_GLUED = re.compile(r"(?<![\d.])(?=\d{1,3}[．、]\s*[^\d\s])")


@dataclass
class _Group:
    kind: str
    first: int | None
    last: int | None
    text: str
    serial: int


def option_chunks(text: str) -> list[dict[str, str]]:
    """The option sets in a text: a new set begins where a letter doesn't follow the one before. Text after a letter is its value."""
    out: list[dict[str, str]] = []
    marks = list(OPTION.finditer(text))
    for n, m in enumerate(marks):
        value = " ".join(text[m.end() : marks[n + 1].start() if n + 1 < len(marks) else len(text)].split())
        if not out or m[1] <= max(out[-1]):
            out.append({})
        out[-1][m[1]] = value
    return out


def _split_labels(text: str) -> dict[str, str]:
    """The text before the labels ('body'), and what stands after 答案 and 解析."""
    parts = {"body": text}
    marks = list(LABEL.finditer(text))
    if marks:
        parts["body"] = text[: marks[0].start()]
    for n, m in enumerate(marks):
        name = "answer" if m[1].startswith("答") else "explanation"
        parts.setdefault(name, text[m.end() : marks[n + 1].start() if n + 1 < len(marks) else len(text)].strip())
    return parts


def parse(paragraphs: list[str], year: int) -> list[dict]:
    """The questions of a paper in the order of its numbers; groups carry their start and end, options are complete with ''."""
    unit, kind, group, serial = 0, "A1/A2", None, 0
    drafts: list[dict] = []
    open_group_options = False
    for at, raw in enumerate(paragraphs):
        for text in (x.strip() for x in (_GLUED.split(raw) if raw else [])):
            if not text:
                continue
            if m := UNIT.fullmatch(text):
                unit, kind, group = _UNITS[m[1]], "A1/A2", None
            elif m := TYPE.fullmatch(text):
                kind, group = _TYPES.get(m[1], m[1]), None
            elif m := RANGE.match(text):
                serial += 1
                group = _Group("A3" if m[3] == "题干" else "B1", int(m[1]), int(m[2]), m[4].strip(), serial)
                open_group_options = group.kind == "B1"
            elif m := STEM.match(text):
                serial += 1
                group = _Group("A3", None, None, m[1].strip(), serial)
            elif (m := NUMBER.match(text)) and unit:
                number = int(m[1])
                inside = group is not None and (group.first is None or group.first <= number <= group.last)
                if group is not None and not inside:
                    group = None
                drafts.append({"unit": unit, "number": number, "kind": group.kind if group else kind, "group": group, "paragraph": at, "parts": [m[2].strip()]})
                open_group_options = False
            elif open_group_options or (group and not any(d["group"] is group for d in drafts)):
                group.text += "\n" + text
            elif drafts:
                drafts[-1]["parts"].append(text)
    spans: dict[int, list[int]] = {}
    for d in drafts:
        if d["group"]:
            spans.setdefault(d["group"].serial, []).append(d["number"])
    out = []
    for d in sorted(drafts, key=lambda d: (d["unit"], d["number"])):
        parts, g = _split_labels("\n".join(d["parts"])), d["group"]
        first = OPTION.search(parts["body"])
        prompt = " ".join(parts["body"][: first.start() if first else None].split())
        chunks = option_chunks(parts["body"])
        shared = option_chunks(g.text)[0] if g and g.kind == "B1" and option_chunks(g.text) else None
        options = shared or (chunks[0] if chunks else {})
        stem = " ".join(g.text.split()) if g and g.kind == "A3" else None
        span = spans[g.serial] if g else [None]
        low, high = (g.first or min(span), g.last or max(span)) if g else (None, None)
        letter = re.search(r"[A-E]", parts.get("answer", ""))
        out.append(
            {
                "id": f"{year}-U{d['unit']}-{d['number']:03d}", "unit": d["unit"], "number": d["number"], "type": d["kind"], "stem": f"{stem} {prompt}" if stem else prompt,
                "options": {k: options.get(k, "") for k in LETTERS}, "answer": letter[0] if letter else None, "explanation": " ".join(parts.get("explanation", "").split()),
                "prompt": prompt if g else None, "group_id": f"{year}-U{d['unit']}-{d['kind']}-{low:03d}-{high:03d}" if g else None, "shared_stem": stem,
                "shared_options": {k: options.get(k, "") for k in LETTERS} if shared else None, "group_start": low, "group_end": high, "source_paragraph": d["paragraph"],
            }
        )
    return out


_SCHEMA = (
    "paper string, id string, unit int, number int, type string, stem string, options map<string,string>, answer string, explanation string, prompt string, group_id string, "
    "shared_stem string, shared_options map<string,string>, group_start int, group_end int, source_paragraph int"
)


def parse_papers(paragraphs: DataFrame) -> DataFrame:
    """Items of papers (paper, year, pos, text): one paper is one task, a few thousand paragraphs."""
    columns = [c.split()[0] for c in _SCHEMA.replace("map<string,string>", "map").split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = parse(pdf.sort_values("pos")["text"].tolist(), int(pdf["year"].iloc[0]))
        frame = pd.DataFrame([{"paper": pdf["paper"].iloc[0], **r} for r in rows], columns=columns)
        return frame.astype({"group_start": "Int32", "group_end": "Int32"})

    return paragraphs.groupBy("paper").applyInPandas(run, _SCHEMA)


def answers(paragraphs: list[str], missing: dict[int, str] | None = None) -> list[tuple[int, str, str]]:
    """(number, letter, explanation) of a unit's answer paragraphs, paired by position; `missing` gives letters no scan shows.

    Numbers in `missing` are placed at the paragraph that holds nothing but the number.
    """
    missing = missing or {}
    found = [(n, m[1] or m[2]) for n, t in enumerate(paragraphs) if (m := KEY.search("".join(t.split())))]
    anchors, number = [], 0
    lone = {n: i for i, t in enumerate(paragraphs) for n in missing if re.fullmatch(rf"{n}\s*[.．、]", t.strip())}
    if set(lone) != set(missing):
        raise ValueError(f"no paragraph for the numbers {sorted(set(missing) - set(lone))}")
    pending = iter(found)
    for number in range(1, len(found) + len(missing) + 1):
        anchors.append((number, lone[number], missing[number]) if number in missing else (number, *next(pending)))
    if [a for _, a, _ in anchors] != sorted(a for _, a, _ in anchors):
        raise ValueError("answers are out of order")
    ends = [a for _, a, _ in anchors[1:]] + [len(paragraphs)]
    out = []
    for (n, at, key), end in zip(anchors, ends):
        text = " ".join(paragraphs[at:end])
        mark = EXPLANATION_HEAD.search(text)
        body = text[mark.end() :] if mark else KEY_HEAD.sub("", text)
        out.append((n, key, " ".join(NEXT_NUMBER.sub("", body).split()).strip("。 ")))
    return out


def parse_answers(paragraphs: DataFrame, missing: dict[int, str] | None = None) -> DataFrame:
    """(paper, number, answer, explanation) of answer papers (paper, pos, text), as answers() reads them; one paper is one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = answers(pdf.sort_values("pos")["text"].tolist(), missing)
        return pd.DataFrame([(pdf["paper"].iloc[0], *r) for r in rows], columns=["paper", "number", "answer", "explanation"])

    return paragraphs.groupBy("paper").applyInPandas(run, "paper string, number int, answer string, explanation string")
