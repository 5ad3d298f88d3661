"""Lines that a page adds to a text: page numbers and running headers."""

from __future__ import annotations

import re

PAGE = re.compile(
    r"[-—–·~*\[(（【\s]*\d{1,4}[-—–·~*\])）】\s]*|第\s*[\dlO]{1,4}\s*页(?:\s*[,，/]?\s*共\s*[\dlO]{1,4}\s*页)?|[\dlO]{1,4}\s*/\s*[\dlO]{1,4}|[Pp](?:age|g?\.)?\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?"
)
_HEADERS = re.compile(
    r"第\s*[\dlO一二三四五六七八九十百]+\s*[章节编篇讲卷回][^。！？]{0,30}"  # chapter and title
    r"|(?i:chapter|section|unit|part)\s+\d+\b[^.!?]{0,60}"
    r"|[^。！？.!?，；：:]{2,40}(?:\s{2,}|\s*[|｜·]\s*|[ \t])[^。！？.!?，；：:]{0,30}?\s?\d{1,4}"  # title, gap, page number
    r"|\d{1,4}(?:\s{2,}|\s*[|｜·]\s*)[^。！？.!?，；：:\d]{2,40}"
)
_BULLET = re.compile(r"\s*(?:[-*•●◆■]|[(（]?\d{1,2}\s*[.、)）．]|[①-⑳]|[一二三四五六七八九十]、)\s*")
_LETTERS = re.compile(r"[A-Za-z一-鿿]")


def is_page(line: str) -> bool:
    return bool(PAGE.fullmatch(line.strip()))


def is_header(line: str) -> bool:
    """A line of its own that carries a title and a number and no sentence."""
    line = line.strip()
    return len(line) <= 80 and not _BULLET.match(line) and bool(_HEADERS.fullmatch(line)) and bool(_LETTERS.search(line))


def is_edge(line: str) -> bool:
    return is_page(line) or is_header(line)


def is_bullet(line: str) -> bool:
    return bool(_BULLET.match(line))
