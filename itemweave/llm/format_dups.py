"""Duplicates hidden by formatting differences: progressive partition refinement.

Level 1 splits the bank by cheap invariants: stripped stem and option lengths and the letter histograms. Only classes
with several members reach level 2, which compares the full stripped texts. Both levels are counted with map-side
combination, so a class that holds a third of all rows is one partial count per task, never one task's list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemweave.functions.identity import option_values, stripped
from itemweave.operators.skew import lookup_join, small
from itemweave.session import written


BROADCAST_IDS = 1_000_000  # ids that may be broadcast


def _histogram(text: Column) -> Column:
    """A number that depends on the letters of a text and how often each occurs, not on their order."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda a, c: a + F.xxhash64(c).bitwiseAND(F.lit(0x3FFFFFFFFF)))


def item_classes(questions: DataFrame) -> DataFrame:
    """(id, first_id, copies): one row per question whose item has several records, with the smallest id of its item and the item's number of records.

    Two questions are one item if stem and options agree on letters and digits in lower case, options taken as a bag
    without their letters. Null stems and options count as empty; repeated ids count as separate records; an empty
    table gives an empty result; other columns are not read.
    """
    stem, opts = stripped(F.col("stem")), F.transform(option_values(F.col("options")), stripped)
    base = questions.select("id", stem.alias("s"), opts.alias("o"))
    joined = F.array_join(F.col("o"), "")
    cheap = base.withColumn(
        "cheap", F.xxhash64(F.length("s"), F.length(joined), F.size("o"), _histogram(F.col("s")), _histogram(joined))
    )
    level1 = written(cheap.groupBy("cheap").agg(F.count("*").alias("n")).filter("n > 1"), "p3-classes")
    exact = F.unhex(F.md5(F.concat_ws("\x1f", F.col("s"), F.array_sort("o"))))
    several = written(lookup_join(cheap, level1, "cheap", "n").select("id", exact.alias("exact")), "p3-several")
    level2 = written(several.groupBy("exact").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1"), "p3-items")
    return lookup_join(several, level2, "exact", "copies").select("id", "first_id", "copies")


def format_duplicates(questions: DataFrame) -> DataFrame:
    """(first_id, id): every question that is not the smallest id of its item."""
    return item_classes(questions).filter("first_id < id").select("first_id", "id").distinct()


def deduplicated(questions: DataFrame) -> DataFrame:
    """The bank with one record for each item (its smallest id) and the number of its copies, itself included.

    A column that is already called copies is replaced. Repeated rows of one id are one record.
    """
    classes = written(item_classes(questions), "p3-members")
    kept = small(classes.filter("id = first_id").select("id", "copies").distinct(), BROADCAST_IDS)
    dropped = small(classes.filter("id <> first_id").select("id").distinct(), BROADCAST_IDS)
    columns = [c for c in questions.columns if c != "copies"]
    rows = questions.select(F.col("id"), F.struct(*columns).alias("row"))
    # ids alone are counted; whole records move only where an id repeats, or where the ids to join are too many to broadcast
    often = small(written(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "p3-often"), BROADCAST_IDS)
    rows = rows.join(often, "id", "left_anti").unionByName(rows.join(often, "id", "left_semi").dropDuplicates(["id"]))
    rows = rows.join(dropped, "id", "left_anti").join(kept, "id", "left")
    return rows.select("row.*", F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))
