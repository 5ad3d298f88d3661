"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemweave.operators.skew import HOT_ROWS, lookup_join
from itemweave.session import written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b); component is the smallest node reached.

    Each round links every node to the minimum of its neighbourhood. Minima combine before the shuffle, and the edges of a
    node with more than HOT_ROWS of them meet its minimum by broadcast, so a hub's edges never gather in one task.
    Self loops and repeated edges change nothing; no edges give no rows; null ends are ignored.
    Every round is a written table, so lost executors repeat one round at most.
    """
    links = edges.select("a", "b").filter("a is not null and b is not null and a <> b")
    links = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    size = links.count()

    def with_low(rows: DataFrame, low: DataFrame) -> DataFrame:
        if 2 * size <= HOT_ROWS:  # no node has so many edges, and stars never add any
            return rows.join(low, "a")
        return lookup_join(rows, written(low, "cc-low"), "a", "n")

    for _ in range(max_rounds):
        # large star: all larger neighbours of a node point to the minimum around it
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"), F.count("*").alias("n"))
        large = with_low(both, low).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        large = written(large, "cc")
        # small star: all smaller neighbours and the node itself point to the minimum among them
        low = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        small = with_low(large, low).select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
        small = written(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "cc")
        before, size = size, small.count()
        same = size == before and small.join(links, ["a", "b"], "left_anti").isEmpty()
        links = small
        if same:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = links.select(F.col("b").alias("node")).distinct().join(links.select(F.col("a").alias("node")), "node", "left_anti")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
