"""Scanned pages as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from itemweave.functions.text import nfkc

SCHEMA = "source string, kind string, dpi int, records array<struct<page:int,column:int,row:int,lines:array<string>>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, column, row, lines) of nested OCR files."""
    pages = spark.read.schema(SCHEMA).json(path, multiLine=True)
    return pages.select(F.explode("records").alias("r")).select("r.page", "r.column", F.coalesce("r.row", F.lit(1)).alias("row"), "r.lines")


def tile_of(name) -> list:
    """page, column, row from a name such as p012-c3-r2.txt; row 1 without one."""
    part = lambda n: F.regexp_extract(name, r"p(\d+)-c(\d+)(?:-r(\d+))?\.txt$", n).try_cast("int")
    return [part(1).alias("page"), part(2).alias("column"), F.coalesce(part(3), F.lit(1)).alias("row")]


def clean_lines(pages: DataFrame, noise: list[str]) -> DataFrame:
    """(page, column, row, line, text): NFKC without white space; noise lines and the overlap of tiles are left out.

    A line among the first five of a tile after the first is overlap if it was among the last five of the tile before it in
    the same page and column.
    """
    rows = pages.select("page", "column", "row", F.posexplode("lines").alias("at", "raw"))
    rows = rows.withColumn("text", F.regexp_replace(nfkc("raw"), r"\s+", "")).filter("text <> ''")
    for mark in noise:
        rows = rows.filter(~F.lower("text").contains(mark.lower()))
    back = W.partitionBy("page", "column", "row").orderBy(F.desc("at"))
    tails = rows.withColumn("r", F.row_number().over(back)).filter("r <= 5").groupBy("page", "column", "row").agg(F.collect_set("text").alias("tail"))
    tiles = pages.select("page", "column", "row").distinct()
    before = tiles.withColumn("prev", F.lag("row").over(W.partitionBy("page", "column").orderBy("row")))
    before = before.join(tails.withColumnRenamed("row", "prev"), ["page", "column", "prev"], "left").select("page", "column", "row", "tail")
    kept = rows.join(before, ["page", "column", "row"], "left")
    overlap = (F.col("row") > 1) & (F.col("at") < 5) & F.coalesce(F.array_contains("tail", F.col("text")), F.lit(False))
    return kept.filter(~overlap).select("page", "column", "row", (F.col("at") + 1).alias("line"), "text")
