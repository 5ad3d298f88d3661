"""Checks over the order of items: ranges, adjacency, neighbours, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from itemweave.functions.text import bigrams, containment, year_of
from itemweave.schema import GROUPED_TYPES, LETTERS
from itemweave.session import written


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """The rows with pos, their place from 1 in a total order, without bringing them into one task.

    Range partitions are sorted and written once; what the driver sees is one count for each partition.
    """
    spark = rows.sparkSession
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = written(parts.withColumns({"pid_": F.spark_partition_id(), "mid_": F.monotonically_increasing_id()}), "numbered")
    sizes = sorted((r.pid_, r.low, r.n) for r in parts.groupBy("pid_").agg(F.min("mid_").alias("low"), F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for pid, low, n in sizes:
        offsets.append((pid, total - low))
        total += n
    shift = spark.createDataFrame(offsets, "pid_ int, shift_ long")
    return parts.join(F.broadcast(shift), "pid_").withColumn("pos", F.col("mid_") + F.col("shift_") + 1).drop("pid_", "mid_", "shift_")


def group_ranges(items: DataFrame) -> DataFrame:
    """(group_id, members, declared_start, declared_end, complete): whether the numbers are exactly those of the declared range."""
    groups = items.filter("group_id is not null and group_id <> ''").groupBy("group_id").agg(
        F.count("*").alias("members"), F.min("group_start").alias("declared_start"), F.max("group_end").alias("declared_end"),
        F.array_sort(F.collect_list("number")).alias("numbers"),
        (F.count_distinct("group_start") + F.count_distinct("group_end") == 2).alias("agreed"),
    )
    valid = F.col("agreed") & (F.col("declared_start") <= F.col("declared_end"))
    expected = F.when(valid, F.sequence("declared_start", "declared_end"))
    complete = F.coalesce(valid & (F.col("numbers") == expected), F.lit(False))
    return groups.select("group_id", "members", "declared_start", "declared_end", complete.alias("complete"))


def group_contiguity(items: DataFrame, order: str) -> DataFrame:
    """(group_id, contiguous): whether the members follow one another in the bank, by their places in `order`.

    Only ids travel to find the places. Repeated values of the order get places of their own, by id.
    """
    placed = numbered(items.select("id", "group_id", F.col(order).alias("at_")), "at_", "id")
    groups = placed.filter("group_id is not null and group_id <> ''").groupBy("group_id")
    return groups.agg((F.max("pos") - F.min("pos") + 1 == F.count("*")).alias("contiguous"))


def group_conflicts(items: DataFrame) -> DataFrame:
    """(group_id, kind): type, scope, shared-stem and shared-options conflicts among the members of a group."""
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    shared = F.concat_ws("|", *(F.concat(F.lit(f"{k}:"), clean(F.try_element_at("shared_options", F.lit(k)))) for k in LETTERS))
    rows = items.filter("group_id is not null and group_id <> ''").withColumns({"ss": clean(F.col("shared_stem")), "so": F.when(F.col("shared_options").isNotNull(), shared).otherwise("")})
    g = rows.groupBy("group_id").agg(
        F.count_distinct("type").alias("types"), F.min_by("type", F.struct("number", "id")).alias("type"),
        F.count_distinct(F.coalesce(year_of(F.col("id")), F.lit(-1))).alias("years"), F.count_distinct(F.coalesce("unit", F.lit(-1))).alias("units"),
        F.count_distinct("ss").alias("stems"), F.min("ss").alias("stem"), F.count_distinct("so").alias("options"), F.min("so").alias("option"),
    )
    kinds = F.array(
        F.when((F.col("types") != 1) | ~F.col("type").isin(*GROUPED_TYPES), "group-type-conflict"),
        F.when((F.col("years") != 1) | (F.col("units") != 1), "group-scope-conflict"),
        F.when((F.col("type") == "A3") & ((F.col("stems") != 1) | (F.col("stem") == "")), "shared-stem-conflict"),
        F.when((F.col("type") == "B1") & ((F.col("options") != 1) | (F.col("option") == "")), "shared-options-conflict"),
    )
    return g.select("group_id", F.explode(F.array_compact(kinds)).alias("kind"))


def next_number(items: DataFrame) -> DataFrame:
    """(id, next_exists): whether an item of the same year and unit has the number that follows."""
    rows = items.select("id", year_of(F.col("id")).alias("year"), "unit", "number")
    following = rows.select("year", "unit", (F.col("number") - 1).alias("number")).distinct().withColumn("next_exists", F.lit(True))
    return rows.join(following, ["year", "unit", "number"], "left").select("id", F.coalesce("next_exists", F.lit(False)).alias("next_exists"))


#: Neighbours meet in blocks of so many places; the rows at the edge of a block also go to the one beside it.
BLOCK = 4096


def neighbour_overlap(items: DataFrame, order: list[str], expected: str, explanation: str, partition: str) -> DataFrame:
    """(id, own, neighbours, suspect): how well an explanation fits its own item and the items beside it in the whole order.

    Scores are the share of an item's loose bigrams that an explanation holds. A neighbour of another partition scores 0. Own
    below 0.08 and a neighbour better by more than 0.12 is suspect. Members of groups and the first and last row of the whole
    order aren't judged. Ids alone are numbered; texts meet their neighbours in small blocks of places, whatever the
    partitions' sizes.
    """
    from itemweave.operators.quality import loose

    keys = [c for c in (partition, *order) if c != "id"]
    place = numbered(items.select("id", *keys), partition, *order).select("id", "pos")
    total = place.agg(F.max("pos").alias("n")).first().n or 0
    texts = items.select("id", F.col(partition).alias("part"), F.coalesce("group_id", F.lit("")).alias("group"), loose(F.col(expected)).alias("e"), loose(F.col(explanation)).alias("x"))
    rows = texts.join(place, "id")
    block, at = F.floor((F.col("pos") - 1) / BLOCK), (F.col("pos") - 1) % BLOCK
    homes = F.array_compact(F.array(block, F.when(at == 0, block - 1), F.when(at == BLOCK - 1, block + 1)))
    rows = rows.select("*", block.alias("home"), F.explode(homes).alias("block"))
    w = W.partitionBy("block").orderBy("pos")
    beside = rows.withColumns({f"{c}{n}": f(c).over(w) for n, f in enumerate((F.lag, F.lead)) for c in ("part", "e")})
    judged = beside.filter((F.col("block") == F.col("home")) & (F.col("group") == "") & (F.col("pos") > 1) & (F.col("pos") < total))
    found = bigrams(F.col("x"))
    score = lambda n: F.when(F.col(f"part{n}").eqNullSafe(F.col("part")), containment(bigrams(F.coalesce(f"e{n}", F.lit(""))), found)).otherwise(F.lit(0.0))
    out = judged.select("id", containment(bigrams(F.col("e")), found).alias("own"), F.greatest(score(0), score(1)).alias("neighbours"))
    return out.withColumn("suspect", (F.col("own") < 0.08) & (F.col("neighbours") > F.col("own") + 0.12))
