"""Lines repeated across the documents of one source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemweave.operators.skew import lookup_join, small
from itemweave.session import written

BROADCAST_SOURCES = 1_000_000  # sources whose names may be broadcast
MIN_DOCS, MIN_SHARE_OF_20 = 3, 1  # at least 3 questions and at least 1/20 of the source's questions
SPACE = r"[\t\x0B\f\r\x{85}\p{Z}]+"


def lines(text: Column) -> Column:
    """The lines of a text, trimmed, with runs of white space reduced to one space."""
    return F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, SPACE, " ")))


def _line_keys(source: Column, text: Column) -> Column:
    """A 64-bit key of source and line for every line, null for an empty line."""
    return F.transform(lines(text), lambda x: F.when(x != "", F.xxhash64(source, x)))


def excessive_lines(questions: DataFrame) -> DataFrame:
    """(source, keys, total): for every source the keys of its excessive lines and its number of questions.

    A line counts once for a question, whichever field holds it. The list of a source is short by definition: each of
    its lines stands in 5 % of the questions, so it holds at most 20 times the mean number of lines of a question.
    Questions without a source have no excessive lines. Empty lines, null texts and empty tables give none.
    """
    both = F.concat(*(F.coalesce(_line_keys(F.col("source"), F.col(c)), F.array().cast("array<bigint>")) for c in ("stem", "explanation")))
    rows = questions.filter("source is not null").select("source", F.explode(F.array_distinct(F.array_compact(both))).alias("key"))
    counts = rows.groupBy("source", "key").agg(F.count("*").alias("docs")).filter(F.col("docs") >= MIN_DOCS)
    totals = questions.filter("source is not null").groupBy("source").agg(F.count("*").alias("total"))
    often = counts.join(totals, "source").filter(F.col("docs") * 20 >= F.col("total") * MIN_SHARE_OF_20)
    return written(often.groupBy("source").agg(F.collect_set("key").alias("keys"), F.first("total").alias("total")), "p6-lines")


def excessive_places(questions: DataFrame) -> DataFrame:
    """(id, field, line_no): every place where an excessive line of the question's own source stands."""
    rows = lookup_join(questions.select("id", "source", "stem", "explanation"), excessive_lines(questions), "source", "total")
    found = []
    for field in ("stem", "explanation"):
        place = rows.select("id", F.lit(field).alias("field"), "keys", F.posexplode(_line_keys(F.col("source"), F.col(field))).alias("pos", "key"))
        found.append(place.filter(F.array_contains("keys", F.col("key"))).select("id", "field", (F.col("pos") + 1).alias("line_no")))
    return found[0].unionByName(found[1]).distinct()


def without_site_lines(questions: DataFrame) -> DataFrame:
    """The questions with excessive lines taken out of stem and explanation; all other lines stay as they were.

    Questions without a source, or of a source without excessive lines, come back unchanged.
    """
    lists = excessive_lines(questions)
    rows = questions.select("source", F.struct(*questions.columns).alias("row"))
    matched = lookup_join(rows, lists, "source", "total")
    cleaned = F.col("row")
    for field in ("stem", "explanation"):
        text = F.col("row")[field]
        cells = F.arrays_zip(F.split(text, "\n").alias("raw"), _line_keys(F.col("source"), text).alias("key"))
        kept = F.filter(cells, lambda x: x["key"].isNull() | ~F.array_contains(F.col("keys"), x["key"]))
        cleaned = cleaned.withField(field, F.array_join(F.transform(kept, lambda x: x["raw"]), "\n"))
    rest = rows.join(small(lists.select("source"), BROADCAST_SOURCES), "source", "left_anti").select("row")
    return matched.select(cleaned.alias("row")).unionByName(rest).select("row.*")
