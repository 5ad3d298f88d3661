"""Reading banks from files and writing results."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemweave.operators.sequence import numbered
from itemweave.schema import ITEM


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """A bank in Parquet."""
    return spark.read.parquet(path)


def read_array_module(spark: SparkSession, path: str, name: str, schema: T.StructType = ITEM) -> DataFrame:
    """The items of the array literal `name` in generated modules (`export const NAME = [...]`), in order, as (bank_ord, item columns).

    A file is one record; a module without that array gives no rows.
    """
    text = spark.read.text(path, wholetext=True)
    literal = F.regexp_extract("value", rf"(?s)export const {name}\s*=\s*(\[.*?\])\s*;?\s*(?:export|$)", 1)
    array = F.from_json(literal, T.ArrayType(schema))
    return text.select(F.posexplode(array).alias("bank_ord", "item")).select("bank_ord", "item.*")


class ExportError(ValueError):
    """A module has no bank, or several that could be meant."""


def bank_name(spark: SparkSession, path: str) -> str:
    """The export that holds a module's bank: QUESTIONS, else the only QUESTIONS_*; anything else raises ExportError."""
    names = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"export const (QUESTIONS(?:_\w+)?)\s*=\s*\["), F.lit(1))).alias("n"))
    found = sorted(r.n for r in names.distinct().limit(100).collect())
    if "QUESTIONS" in found:
        return "QUESTIONS"
    if len(found) != 1:
        raise ExportError(f"several banks: {', '.join(found)}" if found else "no bank")
    return found[0]


def read_bank_module(spark: SparkSession, path: str, schema: T.StructType = ITEM) -> DataFrame:
    """The items of a module's bank, found by bank_name()."""
    return read_array_module(spark, path, bank_name(spark, path), schema)


def inside(root: str, path: str) -> str:
    """The path, if it lies below the root once both are resolved; else ValueError."""
    full = posixpath.normpath(posixpath.join(root, path))
    if not full.startswith(posixpath.normpath(root).rstrip("/") + "/"):
        raise ValueError(f"{path} is outside {root}")
    return full


def read_text_files(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """(texts, failures) of all *.txt below a directory, any letter case: (file_no, path, text) of valid UTF-8 files, (path) of the others.

    file_no, from 1, is the place of the path among all paths in the order of their code units.

    One bad file doesn't fail the rest. A byte-order mark is dropped, line ends become line feeds.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][xX][tT]").load(directory)
    rows = numbered(raw.select("path", F.is_valid_utf8(F.col("content").cast("string")).alias("valid"), F.col("content").cast("string").alias("text")), "path").withColumnRenamed("pos", "file_no")
    text = F.regexp_replace(F.regexp_replace("text", r"^\x{FEFF}", ""), r"\r\n?", "\n")
    return rows.filter("valid").select("file_no", "path", text.alias("text")), rows.filter("not valid").select("path")


def source_name(path: str = "path"):
    """The file name without folders and extension, either slash, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]*)$", 1), r"\.[^.]*$", ""))


def pending(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """The inputs without a record among the outputs."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def write_bank(items: DataFrame, path: str, root: str | None = None) -> None:
    """The bank in Parquet, one folder per year, so that a year is pruned by its folder; below the root, if one is given."""
    from itemweave.functions.text import year_of

    path = path if root is None else inside(root, path)
    items.withColumn("year", year_of(F.col("id"))).write.mode("overwrite").partitionBy("year").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """One JSON object per row."""
    report.write.mode("overwrite").json(path)


def row_digest(columns: list[str]) -> Column:
    """A digest of the columns' values in order; null differs from the empty text."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1d")) for c in columns)), 256)


#: Rows whose digests are joined into one text; their digests are joined once more.
VERSION_BLOCK = 65_536


def bank_version(items: DataFrame, subjects: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(version): 16 hexadecimal digits that depend on names, contents and order of all subjects and items.

    subjects: (subject_id, ord, source_name, subject_name). Each subject counts with both names and its items in order; items of
    other subjects don't count. Digests of rows are joined in blocks by their place, those of blocks by subject, those of subjects
    by ord, so that no subject has to fit into one row.
    """
    rows = items.select("subject_id", *dict.fromkeys((*order, "id")), row_digest(columns).alias("d"))
    placed = numbered(rows.join(F.broadcast(subjects.select("subject_id", "ord")), "subject_id"), "ord", *order, "id")  # one row for each subject of a bank
    joined = lambda by, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda x: x[c]), "")
    blocks = placed.groupBy("subject_id", F.floor((F.col("pos") - 1) / VERSION_BLOCK).alias("b")).agg(F.sha2(joined("pos", "d"), 256).alias("bd"))
    per = blocks.groupBy("subject_id").agg(F.sha2(joined("b", "bd"), 256).alias("sd"))
    named = subjects.join(per, "subject_id", "left").select("ord", F.sha2(F.concat_ws("\x1f", "source_name", "subject_name", F.coalesce("sd", F.lit(""))), 256).alias("nd"))
    return named.agg(F.substring(F.sha2(F.coalesce(joined("ord", "nd"), F.lit("")), 256), 1, 16).alias("version"))


def fingerprint(items: DataFrame, columns: list[str]) -> DataFrame:
    """(n, digest): an order-free fingerprint of the rows' columns, sha256 of the sums of the row digests' parts.

    Row digests are folded with sums that combine before the shuffle; nothing grows with the number of rows.
    """
    row = row_digest(columns)
    parts = [F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")) for i in range(5)]
    folded = items.agg(F.count("*").alias("n"), *(p.alias(f"p{i}") for i, p in enumerate(parts)))
    return folded.select("n", F.sha2(F.concat_ws("|", "n", *(f"p{i}" for i in range(5))), 256).alias("digest"))
