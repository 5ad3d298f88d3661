"""Guarded corrections: a patch applies only to the text it was written against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from itemweave.operators.bank import text_fields
from itemweave.schema import LETTERS


class PatchConflict(ValueError):
    """A patch didn't fit; the message counts the reasons."""


def patch_status(items: DataFrame, patches: DataFrame, order: str = "patch_id") -> DataFrame:
    """patches with `status`: 'ok', 'unknown-id', 'unknown-field', 'duplicate' (a later patch of the field), 'changed' (before differs).

    `before` is held against the original text, not against what another patch made of it. A null before fits a null text.
    """
    known = items.select("id").distinct().withColumn("known", F.lit(True))
    cells = text_fields(items).select("id", "field", F.col("text").alias("now"), F.lit(True).alias("held"))
    turn = F.row_number().over(W.partitionBy("id", "field").orderBy(order))
    fields = ["stem", "explanation", "prompt", "shared_stem", *(f"option-{k}" for k in LETTERS), *(f"shared-option-{k}" for k in LETTERS)]
    rows = patches.withColumn("turn", turn).join(known, "id", "left").join(cells, ["id", "field"], "left")
    status = (
        F.when(F.col("known").isNull(), "unknown-id").when(~F.col("field").isin(fields) | F.col("field").isNull(), "unknown-field")
        .when(F.col("turn") > 1, "duplicate").when(~F.col("before").eqNullSafe(F.col("now")), "changed").otherwise("ok")
    )
    return rows.withColumn("status", status).select(*patches.columns, "status")


def _fixed_map(column: str, prefix: str):
    return F.transform_values(column, lambda k, v: F.coalesce(F.try_element_at("fixes", F.concat(F.lit(prefix), k)), v))


def apply_patches(items: DataFrame, patches: DataFrame, strict: bool = True, order: str = "patch_id") -> DataFrame:
    """The items with all fitting patches applied. Strict: any patch that doesn't fit raises PatchConflict before anything is returned."""
    status = patch_status(items, patches, order)
    if strict:
        wrong = {r.status: r.n for r in status.filter("status <> 'ok'").groupBy("status").agg(F.count("*").alias("n")).collect()}
        if wrong:
            raise PatchConflict(", ".join(f"{k}: {v}" for k, v in sorted(wrong.items())))
    new = status.filter("status = 'ok'").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "after"))).alias("fixes"))
    rows = items.join(new, "id", "left")
    fix = lambda f, c: F.when(F.map_contains_key("fixes", f), F.try_element_at("fixes", F.lit(f))).otherwise(c)
    columns = {c: fix(c, F.col(c)) for c in ("stem", "explanation", "prompt", "shared_stem")}
    for column, prefix in (("options", "option-"), ("shared_options", "shared-option-")):
        columns[column] = _fixed_map(column, prefix)
    return rows.withColumns(columns).select(*items.columns)  # the items' own columns, in their order


def backfill_status(items: DataFrame, backfills: DataFrame, suffix: str) -> DataFrame:
    """As patch_status for (id, before, after) of explanations, with 'no-marker' where after lacks the marker at its end."""
    patches = backfills.withColumn("field", F.lit("explanation")).withColumn("patch_id", F.monotonically_increasing_id())
    status = patch_status(items, patches)
    return status.withColumn("status", F.when((F.col("status") == "ok") & ~F.col("after").endswith(suffix), "no-marker").otherwise(F.col("status"))).drop("patch_id")
