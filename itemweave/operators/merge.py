"""Replica merge: last writer wins per record, and the cursor that follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_replicas(local: DataFrame, remote: DataFrame) -> DataFrame:
    """One record per (collection, key): the higher version (null is 0), then the later updated_at text (null is ''), a full tie stays local.

    Records without a key are dropped. Columns: collection, key, version, updated_at, payload. One aggregate, no window.
    """
    shape = ["collection", "key", "version", "updated_at", "payload"]
    both = local.select(*shape, F.lit(1).alias("held")).unionByName(remote.select(*shape, F.lit(0).alias("held"))).filter("key is not null and key <> ''")
    rank = F.struct(F.coalesce("version", F.lit(0)), F.coalesce("updated_at", F.lit("")), "held")
    best = both.groupBy("collection", "key").agg(F.max_by(F.struct("version", "updated_at", "payload"), rank).alias("x"))
    return best.select("collection", "key", "x.version", "x.updated_at", "x.payload")


def cursor(merged: DataFrame, local_key: str | None, remote_key: str | None, done: str = "completed") -> str | None:
    """The current session's key: the remote one if it is unfinished and there is no local one or its updated_at is later."""
    keys = [k for k in (local_key, remote_key) if k]
    rows = {r.key: r for r in merged.filter(F.col("key").isin(keys)).select("key", "updated_at", done).collect()} if keys else {}
    local, remote = rows.get(local_key), rows.get(remote_key)
    if remote is not None and not remote[done] and (local is None or (remote.updated_at or "") > (local.updated_at or "")):
        return remote_key
    return local_key


def merge_queues(local: list, remote: list) -> list:
    """Ordered distinct union, local first."""
    return list(dict.fromkeys([*local, *remote]))
