"""Scalar text functions, JVM-side unless a docstring says otherwise. Null in, null out, unless stated."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EDGE = r"[\s\x{FEFF}]+"


def trimmed(text: Column) -> Column:
    """Without white space of any kind, or byte-order marks, at both ends; null gives ''."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)^" + _EDGE, ""), "(?U)" + _EDGE + "$", "")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no built-in for it, so this is an Arrow function."""
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def alnum_key(text: Column) -> Column:
    """NFKC, lower case, letters and numbers of any script only; what only compatibility folding needs runs in Python."""
    return F.regexp_replace(F.lower(nfkc(text)), r"[^\p{L}\p{N}]+", "")


@F.pandas_udf(T.DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts; an Arrow function, since the library's junk rule has no SQL equivalent."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def content_key(text: Column) -> Column:
    """NFKC, then ASCII letters, digits and ideographs only, in lower case."""
    return F.lower(F.regexp_replace(nfkc(trimmed(text)), r"[^0-9A-Za-z\x{3400}-\x{9FFF}]", ""))


def excerpt(text: Column, limit: int = 240) -> Column:
    """White space runs reduced to one space; over the limit cut to three characters less, with three points."""
    flat = F.regexp_replace(trimmed(text), r"(?U)\s+", " ")
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


BRACKETS = (("（", "）"), ("(", ")"), ("【", "】"), ("〖", "〗"), ("[", "]"))


def _depth(text: Column, left: str, right: str) -> Column:
    """(depth at the end, whether it was ever negative) of one bracket kind."""

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == left, 1).when(c == right, -1).otherwise(0)
        return F.struct(depth.alias("depth"), (s["bad"] | (depth < 0)).alias("bad"))

    only = F.split(F.regexp_replace(text, f"[^\\{left}\\{right}]", ""), "")
    return F.aggregate(only, F.struct(F.lit(0).alias("depth"), F.lit(False).alias("bad")), step)


def unbalanced(text: Column) -> Column:
    """True if any of five bracket kinds closes before it opens or stays open."""
    bad = F.lit(False)
    for left, right in BRACKETS:
        fold = _depth(text, left, right)
        bad = bad | fold["bad"] | (fold["depth"] != 0)
    return F.coalesce(bad, F.lit(False))


def answer_letter(text: Column) -> Column:
    """A full-width letter A to E as a plain one, in upper case."""
    return F.upper(F.translate(text, "ＡＢＣＤＥ", "ABCDE"))


def chinese_number(text: Column) -> Column:
    """Numerals up to 99; a lone 百 is 100; anything else is null."""
    digit = lambda c: F.nullif(F.position(c, F.lit("一二三四五六七八九")), F.lit(0))
    tens, ones = F.split_part(text, F.lit("十"), F.lit(1)), F.split_part(text, F.lit("十"), F.lit(2))
    with_ten = F.when(tens == "", 1).otherwise(digit(tens)) * 10 + F.when(ones == "", 0).otherwise(digit(ones))
    return F.when(text == "百", 100).when(text.contains("十"), with_ten).when(F.length(text) == 1, digit(text)).cast("int")


def scanned_number(text: Column) -> Column:
    """A number of 1 to 600 that starts a line, with I and L read as 1 and & as 8; null without a real digit."""
    token = F.regexp_extract(F.upper(text), r"^[（(]?([0-9IL&]{1,3})[.．、,，·]?\s*", 1)
    number = F.try_to_number(F.when(token.rlike("[0-9]"), F.translate(token, "IL&", "118")), F.lit("999")).cast("int")
    return F.when(number.between(1, 600), number)


def bigrams(text: Column) -> Column:
    """The distinct pairs of neighbouring characters."""
    n = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(n > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def containment(expected: Column, actual: Column) -> Column:
    """The share of the elements of `expected` that are in `actual`; 0 if `expected` is empty."""
    return F.when(F.size(expected) > 0, F.size(F.array_intersect(expected, actual)) / F.size(expected)).otherwise(F.lit(0.0))


def year_of(item_id: Column) -> Column:
    """The year an id starts with, null without one."""
    return F.regexp_extract(item_id, r"^(\d{4})(?:-|$)", 1).try_cast("int")


def source_number(item_id: Column, unit: Column, number: Column) -> Column:
    """The item's number in its source: units of 150 are counted through in 2019 to 2022."""
    year = year_of(item_id)
    return F.when(year.between(2019, 2022) & unit.isNotNull(), (unit - 1) * 150 + number).otherwise(number)


def subject_id(source_name: Column) -> Column:
    return F.concat(F.lit("subject-"), F.substring(F.sha2(source_name, 256), 1, 12))


def answers_of_line(text: Column) -> Column:
    """Answer letters by number from a line such as '(2)A (3) B'; a lone letter gets the key 0; null without any."""
    pattern = r"(?i)(?:[（(]\s*(\d+)\s*[)）]|(\d+)\s*[.、:])\s*([A-EＡ-Ｅ])"
    numbers = F.transform(
        F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("b")),
        lambda x: F.coalesce(F.nullif(x["a"], F.lit("")), x["b"]).cast("int"),
    )
    letters = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(3)), answer_letter)
    zipped = F.arrays_zip(numbers.alias("k"), letters.alias("v"))
    # the last letter of a repeated number counts
    last = F.filter(zipped, lambda x, i: ~F.exists(F.slice(zipped, i + 2, F.greatest(F.size(zipped) - i - 1, F.lit(0))), lambda y: y["k"] == x["k"]))
    single = F.nullif(answer_letter(F.regexp_extract(text, r"(?i)([A-EＡ-Ｅ])", 1)), F.lit(""))
    return F.when(F.size(zipped) > 0, F.map_from_entries(last)).when(single.isNotNull(), F.create_map(F.lit(0), single))


def item_fingerprint(stem: Column, options: Column, answer: Column | None = None, explanation: Column | None = None) -> Column:
    """A digest of white-space-free stem and options A to E, and of answer and explanation if given."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    parts = [bare(stem), *(bare(F.try_element_at(options, F.lit(k))) for k in "ABCDE")]
    if answer is not None:
        parts.append(F.coalesce(answer, F.lit("")))
    if explanation is not None:
        parts.append(bare(explanation))
    return F.sha2(F.concat_ws("\x1f", *parts), 256)
