"""The item record, its dimensions and the constants of the paper format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TEXTS = T.MapType(T.StringType(), T.StringType())

ITEM = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("unit", T.IntegerType()),
        T.StructField("number", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("stem", T.StringType()),
        T.StructField("options", _TEXTS),
        T.StructField("answer", T.StringType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("group_id", T.StringType()),
        T.StructField("shared_stem", T.StringType()),
        T.StructField("shared_options", _TEXTS),
        T.StructField("group_start", T.IntegerType()),
        T.StructField("group_end", T.IntegerType()),
    ]
)

# Fixed values.
LETTERS = ("A", "B", "C", "D", "E")
TYPES = ("A1/A2", "A3", "B1")
GROUPED_TYPES = ("A3", "B1")
HISTORY_YEARS = (2018, 2019, 2020, 2021, 2022)
BLUEPRINT = (
    (1, 1, "A1/A2", 110), (1, 2, "B1", 40),
    (2, 1, "A1/A2", 95), (2, 2, "A3", 17), (2, 3, "B1", 38),
    (3, 1, "A1/A2", 87), (3, 2, "A3", 33), (3, 3, "B1", 30),
    (4, 1, "A1/A2", 80), (4, 2, "A3", 36), (4, 3, "B1", 34),
)
PAGE_SIZE = 10


def blueprint(spark: SparkSession) -> DataFrame:
    """(unit, section_ord, type, count): how many items of which type an exam of a unit holds, in section order."""
    return spark.createDataFrame(list(BLUEPRINT), "unit int, section_ord int, type string, count int")
