"""Reconciliation of a bank with what it should hold, and of several readings with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemweave.functions.text import match_ratio
from itemweave.schema import LETTERS


def expected_counts(items: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """(*by, expected, actual) where the numbers differ; expected: (*by, expected). Strata only one side has count as 0 on the other."""
    actual = items.groupBy(*by).agg(F.count("*").alias("actual"))
    both = expected.join(actual, by, "full").select(*by, F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), F.coalesce("actual", F.lit(0).cast("long")).alias("actual"))
    return both.filter("expected <> actual")


def incomplete_items(items: DataFrame) -> DataFrame:
    """(id, problem): no stem, no explanation, no valid answer, or a missing option."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    tests = [F.when(blank(F.col("stem")), "stem"), F.when(blank(F.col("explanation")), "explanation"), F.when(~F.coalesce(F.col("answer").isin(*LETTERS), F.lit(False)), "answer")]
    tests += [F.when(blank(F.try_element_at("options", F.lit(k))), f"option-{k}") for k in LETTERS]
    return items.select("id", F.explode(F.array_compact(F.array(*tests))).alias("problem"))


def subject_reconciliation(items: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject_id, problem): subjects (subject_id, subject_name, source_file_name, count) against the bank.

    Problems: 'count' (another number of items), 'empty', 'file-name' (the display name looks like a file or equals a source name),
    'unknown' (items of a subject that isn't listed).
    """
    actual = items.filter("subject_id is not null").groupBy("subject_id").agg(F.count("*").alias("actual"))
    rows = subjects.withColumn("listed", F.lit(True)).join(actual, "subject_id", "full").withColumn("n", F.coalesce("actual", F.lit(0).cast("long")))
    bare = F.regexp_replace("source_file_name", r"\.[^.]*$", "")
    tests = F.array_compact(
        F.array(
            F.when(F.col("listed").isNull(), "unknown"), F.when(F.col("listed") & (F.col("n") != F.col("count")), "count"), F.when(F.col("listed") & (F.col("n") == 0), "empty"),
            F.when(F.col("subject_name").rlike(r"(?i)\.txt$|[\\/]") | (F.col("subject_name") == bare), "file-name"),
        )
    )
    return rows.select("subject_id", F.explode(tests).alias("problem"))


def duplicate_names(subjects: DataFrame) -> DataFrame:
    """(subject_name, n): display names that several subjects share. Null names are no names."""
    return subjects.filter("subject_name is not null").groupBy("subject_name").agg(F.count("*").alias("n")).filter("n > 1")


def unique_names(subjects: DataFrame) -> DataFrame:
    """The subjects, if no name repeats; else ValueError."""
    names = sorted(r.subject_name for r in duplicate_names(subjects).limit(20).collect())
    if names:
        raise ValueError(f"repeated subject names: {', '.join(names)}")
    return subjects


def fuse_readings(layout: DataFrame, readings: list[DataFrame], least: float | dict[str, float] = 0.72) -> tuple[DataFrame, DataFrame]:
    """(fused, disagreements) of readings (ord, field, text) of one layout (ord), the first preferred.

    fused: (ord, field, text), the first reading that isn't blank; disagreements: (ord, field, ratio) where the first two that are
    not blank agree less than `least`, which may differ by field.
    """
    sides = None
    for n, r in enumerate(readings):
        side = r.select("ord", "field", F.nullif(F.trim("text"), F.lit("")).alias(f"t{n}"))
        sides = side if sides is None else sides.join(side, ["ord", "field"], "full")
    rows = sides.join(layout.select("ord").distinct(), "ord", "left_semi").withColumn("found", F.array_compact(F.array(*(f"t{n}" for n in range(len(readings))))))
    bound = F.lit(least) if not isinstance(least, dict) else F.try_element_at(F.create_map(*(F.lit(x) for kv in least.items() for x in kv)), F.col("field"))
    fused = rows.filter(F.size("found") > 0).select("ord", "field", F.element_at("found", 1).alias("text"))
    pairs = rows.filter(F.size("found") > 1).select("ord", "field", F.element_at("found", 1).alias("a"), F.element_at("found", 2).alias("b"))
    return fused, pairs.select("ord", "field", F.round(match_ratio("a", "b"), 3).alias("ratio")).filter(F.col("ratio") < bound)


def excluded(layout: DataFrame, fused: DataFrame, answers: DataFrame, fields: list[str]) -> DataFrame:
    """(ord, reason): places of the layout that can't become an item, because a field or the answer letter is missing."""
    have = fused.filter(F.col("field").isin(fields)).groupBy("ord").agg(F.count_distinct("field").alias("n"))
    letters = answers.filter(F.col("answer").isin(*LETTERS)).select("ord", F.lit(True).alias("answered"))
    rows = layout.select("ord").distinct().join(have, "ord", "left").join(letters, "ord", "left")
    reason = F.when(F.coalesce("n", F.lit(0)) < len(fields), "field").when(F.col("answered").isNull(), "answer")
    return rows.select("ord", reason.alias("reason")).filter("reason is not null")
