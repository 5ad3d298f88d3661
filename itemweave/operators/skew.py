"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this counts as hot. At most rows / HOT_ROWS keys can be hot, which bounds what is broadcast.
HOT_ROWS = 200_000


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, count: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of `rows` with `lookup` (one row per `key`, `count` = number of matching rows).

    Hot keys go through a broadcast of their lookup rows, so their rows never move; all others through a shuffle join.
    Rows with a null key match nothing. An empty side gives an empty result.
    """
    hot = lookup.filter(F.col(count) > hot_rows)
    if hot.isEmpty():
        return rows.join(lookup, key)
    cold = lookup.filter(F.col(count) <= hot_rows)
    by_broadcast = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return by_broadcast.unionByName(rest.join(cold, key))


def small(lookup: DataFrame, rows: int) -> DataFrame:
    """The lookup, to be broadcast if it holds at most so many rows; a larger one is joined through a shuffle."""
    return F.broadcast(lookup) if lookup.count() <= rows else lookup
