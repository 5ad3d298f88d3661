"""Question files of one subject: numbered questions, options, answers, explanations, and two kinds of groups.

Lines are classified first; a small builder then turns the classified lines into items and typed issues.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from itemweave.schema import LETTERS

# The line formats.
FORMATS = {
    "section": re.compile(r"([一二三四五六七八九十百]+)[、.]"),
    "group": re.compile(r"[（(]\s*(\d+)\s*[~～—\-至]\s*(\d+)\s*[)）]\s*(共用选项|共用题干单选)(.*)"),
    "matching": re.compile(r"(\d+)[.、]\s*[【[]?\s*配伍题\s*[】\]]?\s*[（(]?\s*[)）]?"),
    "question": re.compile(r"(\d+)[.、]\s*(.+)"),
    "child": re.compile(r"[（(]\s*(\d+)\s*[)）]\s*(.+)"),
    "option": re.compile(r"([A-EＡ-Ｅa-e])[.、．:：]\s*(.*)"),
    "answer": re.compile(r"正确答案[：:]\s*(.*)"),
    "explanation": re.compile(r"解析[：:]\s*(.*)"),
}
_IGNORED = re.compile(r"=+|（?全文完）?|.*参考答案与解析|（[^）]+）")
_PAIRS = re.compile(r"(?:[（(]\s*(\d+)\s*[)）]|(\d+)\s*[.、:])\s*([A-EＡ-Ｅ])", re.IGNORECASE)
_WIDE = str.maketrans("ＡＢＣＤＥ", "ABCDE")
_DIGITS = {c: n for n, c in enumerate("一二三四五六七八九", 1)}
#: Issues of an item that keep it out of the bank.
INVALID = frozenset({"missing-stem", "missing-options", "missing-answer", "answer-option-missing", "missing-explanation"})


def _numeral(text: str) -> int | None:
    if text == "百":
        return 100
    if "十" in text:
        tens, ones = text.split("十", 1)
        return _DIGITS.get(tens, 1 if not tens else 0) * 10 + (_DIGITS.get(ones, 0) if ones else 0)
    return _DIGITS.get(text)


@dataclass
class _Group:
    id: str
    type: str
    line: int
    legacy: bool = False
    number: int | None = None
    ordinal: int | None = None
    first: int | None = None
    last: int | None = None
    options: dict = field(default_factory=dict)
    stem: str = ""
    waiting: list = field(default_factory=list)
    members: list = field(default_factory=list)


class _Builder:
    def __init__(self, name: str, subject_id: str):
        self.name, self.subject_id = name, subject_id
        self.items: list[dict] = []
        self.issues: list[dict] = []
        self.group: _Group | None = None
        self.draft: dict | None = None
        self.groups = {"range": 0, "legacy": 0}
        self.sequence = 0
        self.section: int | None = None
        self.in_section = False

    def issue(self, code: str, line: int, ordinal: int | None = None) -> None:
        self.issues.append({"code": code, "line": line, "ordinal": ordinal})

    def leave_group(self) -> None:
        g, self.group = self.group, None
        if g is None:
            return
        if g.legacy:
            if len(g.members) < 2 or [m["child"] for m in g.members] != list(range(1, len(g.members) + 1)):
                self.issue("legacy-b1-child-mismatch", g.line)
        elif [m["source_question_number"] for m in g.members if m["source_question_number"] is not None] != list(range(g.first, g.last + 1)):
            self.issue("group-range-mismatch", g.line)

    def start(self, number: int | None, prompt: str, line: int, child: int | None = None) -> dict:
        if child is None:
            self.sequence += 1
        draft = {
            "number": number, "key": number if child is None else child, "prompt": prompt.strip(), "options": {}, "line": line, "child": child,
            "section": self.section if child is None else None, "ordinal": self.sequence if child is None else self.group.ordinal,
            "sub": None if child is None else len(self.group.waiting) + 1,
        }
        self.draft, self.in_section, self.section = draft, False, None
        if self.group and self.group.type == "B1":
            self.group.waiting.append(draft)
        return draft

    def finish(self, draft: dict, answer: str | None, explanation: str, line: int) -> None:
        g = self.group
        options = dict(g.options if g and g.type == "B1" else draft["options"])
        ordinal = len(self.items) + 1
        suffix = f"-S{draft['sub']:02d}" if draft["sub"] and draft["sub"] > 1 else ""
        item = {
            "id": f"SUB-{self.subject_id[-12:]}-{draft['ordinal']:04d}{suffix}", "subject_id": self.subject_id, "subject": self.name, "number": ordinal,
            "source_question_number": draft["number"], "source_sub_question_number": draft["child"], "source_section_number": draft["section"],
            "type": g.type if g else "A1/A2", "stem": f"{g.stem} {draft['prompt']}".strip() if g and g.type == "A3" else draft["prompt"],
            "options": options, "answer": answer, "explanation": explanation, "prompt": draft["prompt"] if g else None, "group_id": g.id if g else None,
            "shared_stem": g.stem if g and g.type == "A3" else None, "shared_options": dict(g.options) if g and g.type == "B1" else None, "child": draft["child"],
        }
        checks = (
            ("missing-stem", not draft["prompt"], draft["line"]), ("missing-options", any(not options.get(k) for k in LETTERS), draft["line"]),
            ("missing-answer", answer not in LETTERS, line), ("answer-option-missing", bool(answer) and not options.get(answer), line), ("missing-explanation", not explanation, line),
        )
        for code, wrong, at in checks:
            if wrong:
                self.issue(code, at, ordinal)
        self.items.append(item)
        if g:
            g.members.append(item)


def _letter(text: str) -> str:
    return text.translate(_WIDE).upper()


def _options(lines: list[str], at: int) -> tuple[dict, int]:
    found = {}
    while at < len(lines):
        if lines[at]:
            m = FORMATS["option"].fullmatch(lines[at])
            if not m:
                break
            found[_letter(m[1])] = m[2].strip()
        at += 1
    return found, at


def _explanation(lines: list[str], at: int) -> tuple[str, int]:
    while at < len(lines) and not lines[at]:
        at += 1
    m = FORMATS["explanation"].fullmatch(lines[at]) if at < len(lines) else None
    if not m:
        return "", at
    parts, at = [m[1].strip()], at + 1
    while at < len(lines) and lines[at] and not any(FORMATS[k].fullmatch(lines[at]) for k in ("group", "section", "question")):
        parts.append(lines[at])
        at += 1
    return "\n".join(p for p in parts if p), at + (at < len(lines) and not lines[at])


def parse(text: str, name: str, subject_id: str | None = None) -> tuple[list[dict], list[dict]]:
    """(items, issues) of one file. Items that lack a part are reported and left out; groups get start and end numbers."""
    subject_id = subject_id or "subject-" + hashlib.sha256(name.encode()).hexdigest()[:12]
    lines = [x.strip().lstrip("﻿").strip() for x in re.split(r"\r\n?|\n", text.removeprefix("﻿"))]
    b, at = _Builder(name, subject_id), 0
    while at < len(lines):
        line, here = lines[at], at + 1
        if not line:
            at += 1
        elif m := FORMATS["section"].fullmatch(line):
            b.leave_group()
            b.draft, b.in_section, b.section, at = None, True, _numeral(m[1]), at + 1
        elif m := FORMATS["group"].fullmatch(line):
            b.leave_group()
            b.draft, b.in_section, b.section = None, False, None
            b.groups["range"] += 1
            kind = "B1" if m[3] == "共用选项" else "A3"
            b.group = _Group(f"{subject_id}-{kind}-G{b.groups['range']:03d}", kind, here, first=int(m[1]), last=int(m[2]))
            at += 1
            if kind == "B1":
                b.group.options, at = _options(lines, at)
                if any(not b.group.options.get(k) for k in LETTERS):
                    b.issue("group-missing-options", here)
            else:
                while at < len(lines) and not lines[at]:
                    at += 1
                b.group.stem = lines[at] if at < len(lines) else ""
                if not b.group.stem:
                    b.issue("group-missing-stem", here)
                at += 1
        elif m := FORMATS["matching"].fullmatch(line):
            b.leave_group()
            b.draft, b.in_section, b.section = None, False, None
            b.groups["legacy"] += 1
            b.sequence += 1
            b.group = _Group(f"{subject_id}-B1-LEGACY-G{b.groups['legacy']:03d}", "B1", here, legacy=True, number=int(m[1]), ordinal=b.sequence)
            b.group.options, at = _options(lines, at + 1)
            if any(not b.group.options.get(k) for k in LETTERS):
                b.issue("group-missing-options", here)
        elif b.group and b.group.legacy and (m := FORMATS["child"].fullmatch(line)):
            b.start(b.group.number, m[2], here, child=int(m[1]))
            at += 1
        elif m := FORMATS["question"].fullmatch(line):
            draft = b.start(int(m[1]), m[2], here)
            at += 1
            if not (b.group and b.group.type == "B1"):
                draft["options"], at = _options(lines, at)
        elif b.in_section and not _IGNORED.fullmatch(line):
            draft = b.start(b.section, line, here)
            draft["options"], at = _options(lines, at + 1)
        elif m := FORMATS["answer"].fullmatch(line):
            letters = {int(x[1] or x[2]): _letter(x[3]) for x in _PAIRS.finditer(m[1])}
            explanation, at = _explanation(lines, at + 1)
            waiting = b.group.waiting if b.group and b.group.type == "B1" else [b.draft] if b.draft else []
            if letters:
                for draft in sorted(waiting, key=lambda d: letters.get(d["key"]) is None):
                    b.finish(draft, letters.get(draft["key"]), explanation, here)
                if b.group:
                    b.group.waiting = []
            elif b.draft:
                single = re.search(r"[A-EＡ-Ｅ]", m[1], re.IGNORECASE)
                b.finish(b.draft, _letter(single[0]) if single else None, explanation, here)
                if b.group and b.group.type == "B1":
                    b.group.waiting = [d for d in b.group.waiting if d is not b.draft]
            else:
                b.issue("orphan-answer", here)
                continue
            b.draft = None
            if b.group and (b.group.legacy or (b.group.members and (b.group.members[-1]["source_question_number"] or 0) >= b.group.last)):
                b.leave_group()
        else:
            at += 1
    rest = [d for d in (b.group.waiting if b.group else []) if d is not b.draft]
    for draft in ([b.draft] if b.draft else []) + rest:
        b.finish(draft, None, "", draft["line"])
    b.leave_group()
    spans: dict[str, list[int]] = {}
    for item in b.items:
        spans.setdefault(item["group_id"], []).append(item["number"])
    bad = {x["ordinal"] for x in b.issues if x["code"] in INVALID}
    kept = []
    for item in b.items:
        span = spans[item["group_id"]] if item["group_id"] else [None]
        item |= {"group_start": span[0], "group_end": span[-1]}
        item.pop("child")
        if item["number"] not in bad:
            kept.append(item)
    return kept, b.issues


_ITEM = (
    "id string, subject_id string, subject string, number int, source_question_number int, source_sub_question_number int, source_section_number int, type string, "
    "stem string, options map<string,string>, answer string, explanation string, prompt string, group_id string, shared_stem string, shared_options map<string,string>, "
    "group_start int, group_end int"
)


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, issues) of a table (path, name, text), one file per row and task step: path is added to both."""
    columns = [c.split()[0] for c in _ITEM.replace("map<string,string>", "map").split(", ")]

    def items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rec in pdf.itertuples():
                kept, _ = parse(rec.text, rec.name)
                frame = pd.DataFrame([{k: x[k] for k in columns} for x in kept], columns=columns).assign(path=rec.path)
                for c in ("number", "source_question_number", "source_sub_question_number", "source_section_number", "group_start", "group_end"):
                    frame[c] = frame[c].astype("Int32")
                yield frame

    def issues(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rec in pdf.itertuples():
                frame = pd.DataFrame(parse(rec.text, rec.name)[1], columns=["code", "line", "ordinal"]).assign(path=rec.path)
                frame["ordinal"] = frame["ordinal"].astype("Int32")
                yield frame

    return files.mapInPandas(items, _ITEM + ", path string"), files.mapInPandas(issues, "code string, line int, ordinal int, path string")
