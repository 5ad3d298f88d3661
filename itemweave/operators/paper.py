"""Random selection of whole blocks with exact totals, and pages.

Randomness is a hash of seed and block key, so a draw is reproducible on any cluster. Blocks of one item are taken by rank,
fully in SQL; only the residual choice among larger blocks is a dynamic program, over a pool cut to what it can use.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from itemweave.operators.bank import blocks
from itemweave.operators.sequence import numbered
from itemweave.schema import PAGE_SIZE, TYPES


def draw(seed: int, key: Column) -> Column:
    """The sort key of a random order: a digest of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key))


def type_rank(kind: Column) -> Column:
    return F.array_position(F.array(*(F.lit(t) for t in TYPES)), kind).cast("int")


def stratified_quota(items: DataFrame, quotas: DataFrame, by: list[str], seed: int, key: str = "id") -> DataFrame:
    """Of each stratum the `count` first items in the random order; strata with fewer give all they have.

    The rank is a window per stratum with a row limit, which Spark evaluates per task before the shuffle (window group limit).
    """
    most = quotas.agg(F.max("count")).first()[0] or 0
    rank = F.row_number().over(W.partitionBy(*by).orderBy(draw(seed, F.col(key)), key))
    ranked = items.withColumn("draw_pos", rank).filter(F.col("draw_pos") <= most)
    return ranked.join(F.broadcast(quotas), by).filter(F.col("draw_pos") <= F.col("count")).drop("count")


def choose_blocks(sizes: list[int], target: int, at_most: bool = False) -> list[int]:
    """Positions of blocks, taken in the order given, whose sizes sum to `target`; with at_most to the largest total reachable.

    The first way found to reach a total stays. Unreachable without at_most raises ValueError; a target below 1 gives [].
    """
    if target < 1:
        return []
    reached = {0: None}  # total -> (position of the last block, total before it)
    for pos, size in enumerate(sizes):
        for total in sorted((t for t in reached if t + size <= target and t + size not in reached), reverse=True):
            reached[total + size] = (pos, total)
        if target in reached:
            break
    total = target if target in reached else max(reached) if at_most else None
    if total is None:
        raise ValueError(f"no whole blocks add up to {target}")
    chosen = []
    while total:
        pos, total = reached[total]
        chosen.append(pos)
    return chosen[::-1]


def whole_blocks(items: DataFrame, quotas: DataFrame, by: list[str], seed: int, at_most: bool = False, order: str = "bank_ord") -> DataFrame:
    """Items of whole blocks per stratum with the exact total `count`: all item columns, block columns and draw (random order of blocks).

    Of each stratum and block size only the first `count` / size blocks in the random order can ever be needed, so what one task
    sees is bounded by the quota, whatever the size of the bank. Raises if a stratum can't be met, unless at_most.
    """
    rows = blocks(items, order)
    heads = rows.filter(F.col(order) == F.col("block_pos")).select(*by, "block", "block_size").withColumn("draw", draw(seed, F.col("block")))
    heads = heads.join(F.broadcast(quotas), by)
    rank = F.row_number().over(W.partitionBy(*by, "block_size").orderBy("draw", "block"))
    most = quotas.agg(F.max("count")).first()[0] or 0  # a literal limit on the rank is applied per task, before the shuffle
    useful = heads.withColumn("r", rank).filter(F.col("r") <= most).filter(F.col("r") * F.col("block_size") <= F.col("count"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "block"])
        return pdf.iloc[sorted(choose_blocks(pdf["block_size"].tolist(), int(pdf["count"].iloc[0]), at_most))][["block", "draw"]]

    chosen = useful.groupBy(*by).applyInPandas(pick, "block string, draw string")
    return rows.join(chosen, "block")


def exam_paper(items: DataFrame, blueprint: DataFrame, seed: int, order: str = "bank_ord") -> DataFrame:
    """One paper per unit of the blueprint: paper_pos in section order, blocks whole and in random order, exact section counts.

    A unit whose pool is too small raises ValueError when the paper is computed.
    """
    chosen = whole_blocks(items, blueprint.select("unit", "type", "count"), ["unit", "type"], seed, order=order)
    rows = chosen.join(F.broadcast(blueprint.select("unit", "type", "section_ord")), ["unit", "type"])
    return rows.withColumn("paper_pos", F.row_number().over(W.partitionBy("unit").orderBy("section_ord", "draw", "block", order)))


def review_paper(items: DataFrame, count: int, seed: int, at_most: bool = False, order: str = "bank_ord") -> DataFrame:
    """A random review of `count` items of whole blocks, sorted by type; 0 counts as 10, and more than there are as all."""
    total = items.count()
    wanted = max(1, min(total, count or 10))
    if wanted == total:  # everything: no choice to make, and no task has to see all blocks
        rows = blocks(items, order)
        rows = rows.withColumns({"draw": draw(seed, F.col("block")), "rank_": type_rank(F.col("block_type"))})
        return numbered(rows, "rank_", "draw", "block", order).withColumnRenamed("pos", "paper_pos").drop("rank_")
    one = items.withColumn("pool", F.lit(1))
    quota = items.sparkSession.createDataFrame([(1, wanted)], "pool int, count int")
    rows = whole_blocks(one, quota, ["pool"], seed, at_most, order).drop("pool")  # `count` rows at most from here on
    return rows.withColumn("paper_pos", F.row_number().over(W.orderBy(type_rank(F.col("block_type")), "draw", "block", order)))


def pages(items: DataFrame, paper: list[str], pos: str = "paper_pos", size: int = PAGE_SIZE) -> DataFrame:
    """Items with page_no: whole blocks in the order of `pos`; a new page where the type changes or the block doesn't fit.

    A block larger than a page stands alone. The fold runs over one array for each paper; a paper is a bounded list of blocks.
    """
    key = F.coalesce(F.nullif(F.col("group_id"), F.lit("")), F.col("id"))
    rows = items.withColumn("page_block", key)
    heads = rows.groupBy(*paper, "page_block").agg(F.min(pos).alias("p"), F.count("*").cast("int").alias("n"), F.min_by("type", pos).alias("t"))
    packed = heads.groupBy(*paper).agg(F.array_sort(F.collect_list(F.struct("p", "n", "t", "page_block"))).alias("list"))
    start = F.struct(F.lit(0).alias("page"), F.lit(0).alias("used"), F.lit("").alias("t"), F.expr("cast(array() as array<struct<page_block:string,page_no:int>>)").alias("out"))

    def step(s, b):
        fresh = (s["page"] == 0) | ~s["t"].eqNullSafe(b["t"]) | (s["used"] + b["n"] > size)
        page = s["page"] + F.when(fresh, 1).otherwise(0)
        return F.struct(
            page.alias("page"), (F.when(fresh, 0).otherwise(s["used"]) + b["n"]).alias("used"), F.coalesce(b["t"], F.lit("")).alias("t"),
            F.concat(s["out"], F.array(F.struct(b["page_block"].alias("page_block"), page.alias("page_no")))).alias("out"),
        )

    numbered = packed.select(*paper, F.explode(F.aggregate("list", start, step)["out"]).alias("x")).select(*paper, "x.page_block", "x.page_no")
    return rows.join(numbered, [*paper, "page_block"]).drop("page_block")


def mistake_order(ids: DataFrame, bank: DataFrame, seed: int) -> DataFrame:
    """(id, pos): known ids once each, members of A3 and B1 groups together by number and id in Chinese order, blocks in random order."""
    rows = ids.select("id").distinct().join(bank.select("id", "type", "group_id", "number"), "id")
    grouped = F.col("type").isin("A3", "B1") & (F.coalesce("group_id", F.lit("")) != "")
    block = F.when(grouped, F.concat_ws(":", "type", "group_id")).otherwise(F.concat(F.lit("question:"), F.col("id")))
    rows = rows.withColumn("block", block)
    rows = rows.select("id", "block", draw(seed, F.col("block")).alias("d"), F.coalesce("number", F.lit(0)).alias("number"))
    rows = rows.withColumn("zh", F.collate("id", "zh"))
    return numbered(rows, "d", "block", "number", "zh", "id").select("id", "pos")
