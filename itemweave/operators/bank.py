"""The bank as a table: union in order, lookups, and the long form of its text fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemweave.schema import LETTERS


def union_banks(*banks: DataFrame) -> DataFrame:
    """All items, with bank_no from 0 in the order given; columns a bank lacks are null there."""
    numbered = [b.withColumn("bank_no", F.lit(n)) for n, b in enumerate(banks)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def text_fields(items: DataFrame, *keep: str) -> DataFrame:
    """(id, *keep, field, field_group, text): one row for each text field that is not null.

    Fields are stem, explanation, option-A to E, prompt, shared_stem and shared-option-A to E.
    """
    def cell(name: str, text: Column, group: str) -> Column:
        return F.struct(F.lit(name).alias("field"), F.lit(group).alias("field_group"), text.alias("text"))

    cells = [cell("stem", F.col("stem"), "stem"), cell("explanation", F.col("explanation"), "explanation")]
    cells += [cell(f"option-{k}", F.try_element_at("options", F.lit(k)), "option") for k in LETTERS]
    cells += [cell("prompt", F.col("prompt"), "stem"), cell("shared_stem", F.col("shared_stem"), "stem")]
    cells += [cell(f"shared-option-{k}", F.try_element_at("shared_options", F.lit(k)), "option") for k in LETTERS]
    exploded = items.select("id", *keep, F.explode(F.array(*cells)).alias("x"))
    return exploded.select("id", *keep, "x.field", "x.field_group", "x.text").filter("text is not null")


def by_ids(ids: DataFrame, bank: DataFrame) -> DataFrame:
    """The items of `ids` (id, pos) in their order; ids that the bank lacks give a row of nulls."""
    return ids.join(bank, "id", "left").orderBy("pos")


def blocks(items: DataFrame, order: str = "bank_ord") -> DataFrame:
    """Items with block (group_id, or id where that is null or empty), block_pos (first place in the order), block_size, block_type.

    Groups are small by their nature, so a window over the block is bounded.
    """
    from pyspark.sql import Window as W

    key = F.coalesce(F.nullif(F.col("group_id"), F.lit("")), F.col("id"))
    w = W.partitionBy("block")
    return items.withColumn("block", key).withColumns(
        {"block_pos": F.min(order).over(w), "block_size": F.count("*").over(w), "block_type": F.min_by("type", order).over(w)}
    )
