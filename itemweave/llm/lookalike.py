"""Visually identical text with different characters: look-alike classes and a greedy rewrite.

Strings and code points that look alike are linked, the links are closed transitively by union-find, each class gets its
most frequent admissible member as representative, and a multi-pattern automaton rewrites the others, longest match first.

Members are odd (never a representative, and a case wherever the rewrite meets them) or usual. Where a class has several
usual members, such as the two micro signs, the counts over all texts decide which one all others become; that makes texts
comparable but is no case by itself. A field is a case if the rewrite replaced something odd in it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemweave.llm import kernel as K

# Letters of other scripts or blocks drawn like a Latin letter.
CYRILLIC = ("АВСЕНІЈКМОРЅТУХԜԚҮасеіјорѕухԛԝһԁѵ", "ABCEHIJKMOPSTYXWQYaceijopsyxqwhdv")
CHEROKEE = ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZVSLCPKB")
GREEK_CAPITALS = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ABEZHIKMNOPTYXC")
GREEK_SMALL = ("ανιορυϲ", "aviopuc")
LISU = ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU")
LATIN_VARIANTS = ("ɡɑıȷօսհ", "gaijouh")
# Radicals of the supplement block that have a form of their own among the ideographs.
RADICALS = ("⺟⺠⻁⻄⻅⻆⻉⻋⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻧⻨⻩⻬⻮⻰⻳", "母民虎西见角贝车长门青韦页风飞食马骨鬼鱼鸟卤麦黄齐齿龙龟")

# Usual signs that are drawn alike; which one stays is a matter of frequency.
FORMS = ("µμ", "Ω\u2126", "·‧・⋅", "-‐‑", "～〜", "：∶", "’ʼ", "—―", "/∕", "∑Σ", "∆Δ")

#: Texts without any character outside these ranges need no look: ASCII, ideographs, common Chinese punctuation.
UNUSUAL = r"[^\t\n -~\x{4E00}-\x{9FFF}\x{3001}-\x{3002}\x{3010}\x{3011}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF1F}\x{2014}\x{2018}-\x{201D}\x{2026}]"


def _invisible(c: str) -> bool:
    return (
        unicodedata.category(c) == "Cf" or c in "͏ᅟᅠ឴឵ㅤﾠ"
        or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef" or (unicodedata.category(c) == "Cc" and c not in "\t\n\r")
    )


def _combining(i: int) -> bool:
    return any(a <= i < b for a, b in ((0x300, 0x370), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x20D0, 0x2100), (0xFE20, 0xFE30)))


def _radicals() -> Iterator[tuple[str, str]]:
    """Radicals of the supplement block with the ideograph of the classical radical of the same name."""
    names = {unicodedata.name(chr(i))[15:]: unicodedata.normalize("NFKC", chr(i)) for i in range(0x2F00, 0x2FD6)}
    for i in range(0x2E80, 0x2EF4):
        name = unicodedata.name(chr(i), "")[12:]
        plain = re.sub(r"^(?:[CJ]-|)SIMPLIFIED | (?:ONE|TWO|THREE|FOUR)$", "", name)
        if plain in names:
            yield chr(i), names[plain]


def links() -> Iterator[tuple[str, str, str]]:
    """(string, string it looks like, kind), by rule and from the tables above.

    Kinds: 'odd', the first string is no usual form; 'near', the same only beside a Latin letter; 'form', both are usual.
    """
    for i in range(0x110000):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if _invisible(c) or _combining(i):  # an accent that has no composed form with what stands before it is dropped
            yield c, "", "odd"
        elif kind in ("Zs", "Zl", "Zp") and c != " ":
            yield c, " ", "odd"
        elif 0xFF10 <= i <= 0xFF5A and kind[0] in "LN" or 0x1D400 <= i <= 0x1D7FF or 0x2E80 <= i <= 0x2FDF or 0xF900 <= i <= 0xFAFF or 0x2F800 <= i <= 0x2FA1F or 0xFF66 <= i <= 0xFF9D or 0xFB00 <= i <= 0xFB06 or i in (0x212A, 0x212B):
            usual = unicodedata.normalize("NFKC", c)
            if usual != c:
                yield c, usual, "odd"
        elif i < 0x2000 and kind[0] == "L" and not 0x1100 <= i <= 0x11FF:
            apart = unicodedata.normalize("NFD", c)
            if apart != c and unicodedata.normalize("NFC", apart) == c:
                yield apart, c, "odd"
                once = unicodedata.normalize("NFC", apart[:-1]) + apart[-1]
                if once != apart:
                    yield once, c, "odd"
    for odd, usual in (CYRILLIC, CHEROKEE, GREEK_CAPITALS, LISU, LATIN_VARIANTS, RADICALS):
        yield from ((a, b, "odd") for a, b in zip(odd, usual, strict=True))
    yield from ((a, b, "odd") for a, b in _radicals() if a not in RADICALS[0])
    yield from ((a, b, "near") for a, b in zip(*GREEK_SMALL, strict=True))
    yield from ((a, b, "form") for group in FORMS for a, b in zip(group, group[1:]))


def classes() -> tuple[dict[str, list[str]], set[str], set[str]]:
    """(members of each class by its root, odd members, odd members that need a Latin neighbour), closed by union-find."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    odd, near = set(), set()
    for a, b, kind in links():
        if kind != "form":
            odd.add(a)
        if kind == "near":
            near.add(a)
        parent[root(a)] = root(b)
    found: dict[str, list[str]] = defaultdict(list)
    for x in list(parent):
        found[root(x)].append(x)
    return dict(found), odd, near


_CACHE: dict = {}


def _tables() -> dict:
    if not _CACHE:
        members, odd, near = classes()
        known = np.zeros(0x110000, bool)
        known[[ord(x) for group in members.values() for x in group if len(x) == 1]] = True
        _CACHE.update(members=members, odd=odd, near=near, known=known)
    return _CACHE


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = _tables()
    total = np.zeros(0x110000, np.int64)
    strings: dict[str, int] = defaultdict(int)
    longer = {x for group in t["members"].values() for x in group if len(x) > 1}
    for batch in K.bounded(batches, "text", 10_000):
        texts = batch.column(0).drop_null().to_pylist()
        flat, _ = K.codepoints(texts)
        total += np.bincount(flat, minlength=0x110000)
        for x in np.flatnonzero((flat[1:] >= 0x300) & (flat[1:] < 0x370)) if len(flat) else ():
            pair = chr(flat[x]) + chr(flat[x + 1])
            if pair in longer:
                strings[pair] += 1
    seen = np.flatnonzero(t["known"] & (total > 0))
    yield pa.RecordBatch.from_arrays(
        [pa.array([chr(i) for i in seen] + list(strings), pa.string()), pa.array([int(total[i]) for i in seen] + list(strings.values()), pa.int64())],
        ["token", "n"],
    )


def fields(questions: DataFrame) -> DataFrame:
    """(id, field, text) of stem, explanation and shared options A to E; null texts give no row."""
    shared = [F.try_element_at("shared_options", F.lit(k)) for k in "ABCDE"]
    names = ["stem", "explanation", *(f"shared-option-{k}" for k in "ABCDE")]
    cells = F.array(*(F.struct(F.lit(n).alias("field"), c.alias("text")) for n, c in zip(names, [F.col("stem"), F.col("explanation"), *shared])))
    return questions.select("id", F.explode(cells).alias("x")).select("id", "x.field", "x.text").filter("text is not null")


def representatives(texts: DataFrame) -> dict[str, str]:
    """String -> the representative of its class: the usual member seen most often in all texts, of equal ones the first by code point.

    What reaches the driver is one count for each string of the look-alike tables, whatever the number of texts.
    """
    seen = texts.select("text").mapInArrow(_counts, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    n = {r.token: r.n for r in seen.collect()}
    t = _tables()
    to = {}
    for group in t["members"].values():
        usual = [x for x in group if x not in t["odd"]] or group
        best = min(usual, key=lambda x: (-n.get(x, 0), len(x), x))
        to.update({x: best for x in group if x != best})
    return to


def _latin(c: str) -> bool:
    return c.isascii() and c.isalpha()


def rewriter(to: dict[str, str]):
    """A function of one text: (greedy leftmost-longest rewrite, repeated until nothing changes; whether something odd was replaced).

    Classes nest at most twice.
    """
    automaton = ahocorasick.Automaton()
    near, odd = _tables()["near"], _tables()["odd"]
    for a, b in to.items():
        automaton.add_word(a, (a, b, a in odd, a in near))
    automaton.make_automaton()

    def once(text: str) -> tuple[str, bool]:
        out, at, case = [], 0, False
        for end, (a, b, strange, beside) in automaton.iter_long(text):
            start = end + 1 - len(a)
            if beside and not (_latin(text[start - 1 : start]) or _latin(text[end + 1 : end + 2])):
                continue
            case |= strange
            out += [text[at:start], b]
            at = end + 1
        return ("".join(out) + text[at:] if out else text), case

    def rewrite(text: str) -> tuple[str, bool]:
        case = False
        for _ in range(4):
            new, odd_here = once(text)
            case |= odd_here
            if new == text:
                break
            text = new
        return text, case

    return rewrite


def _rewritten(texts: DataFrame, to: dict[str, str]) -> DataFrame:
    """(id, field, text, consistent, case) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = rewriter(to)
        last = np.zeros(0x110000, bool)  # a text without the last character of any string to rewrite stays as it is
        last[[ord(x[-1]) for x in to if x]] = True
        for batch in K.bounded(batches, "text", 10_000):
            texts = batch.column("text").to_pylist()
            flat, no = K.codepoints(texts)
            touched = np.zeros(len(texts), bool)
            touched[no[last[flat]]] = True
            done = [rewrite(x) if t else (x, False) for x, t in zip(texts, touched.tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "field", "text")), pa.array([x for x, _ in done], pa.string()), pa.array([c for _, c in done], pa.bool_())], ["id", "field", "text", "consistent", "case"])

    return texts.mapInArrow(run, "id string, field string, text string, consistent string, case boolean")


def consistent_fields(questions: DataFrame) -> DataFrame:
    """(id, field, text, consistent): every field in which the rewrite replaced a look-alike or hidden character, and its consistent form.

    Null and empty texts are no cases; long texts are rewritten whole; an empty table gives no rows.
    """
    texts = fields(questions)
    return _rewritten(texts.filter(F.col("text").rlike(UNUSUAL)), representatives(texts)).filter("case").drop("case")


def found(questions: DataFrame) -> DataFrame:
    """(id, field) of every case."""
    return consistent_fields(questions).select("id", "field").distinct()


def consistent_texts(questions: DataFrame) -> DataFrame:
    """(id, field, text): all fields in one consistent form, changed or not."""
    texts = fields(questions)
    return _rewritten(texts, representatives(texts)).select("id", "field", F.col("consistent").alias("text"))
