"""Identity rules: keep the first of equal keys, of equal blocks, and of blocks met in sequence."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemweave.operators.skew import lookup_join
from itemweave.session import written


def keep_first(items: DataFrame, key: Column, order: str) -> DataFrame:
    """(id, key, first_id, duplicate): first_id is the id of the smallest `order` with the key. A null or empty key is never a duplicate.

    The firsts are found by map-side minima, so a key that holds most of the rows costs no more than others.
    """
    keyed = items.select("id", F.col(order).alias("ord"), key.alias("key"))
    firsts = keyed.filter("key <> ''").groupBy("key").agg(F.min_by("id", "ord").alias("first_id"), F.min("ord").alias("first_ord"), F.count("*").alias("n"))
    rows = lookup_join(keyed, firsts, "key", "n")
    found = rows.select("id", "key", "first_id", (F.col("ord") > F.col("first_ord")).alias("duplicate"))
    alone = keyed.filter("key is null or key = ''").select("id", "key", F.col("id").alias("first_id"), F.lit(False).alias("duplicate"))
    return found.unionByName(alone)


def block_dedup(items: DataFrame, fingerprint: str, block: str, order: str) -> DataFrame:
    """(block, kept_block): blocks with equal bags of member fingerprints are one; the first in the order is kept."""
    bags = items.groupBy(block).agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(fingerprint))), 256).alias("bag"), F.min(order).alias("ord"))
    kept = bags.groupBy("bag").agg(F.min_by(block, "ord").alias("kept_block"), F.count("*").alias("n"))
    return lookup_join(bags, kept, "bag", "n").select(F.col(block).alias("block"), "kept_block")


def sequential_block_dedup(items: DataFrame, key: str, block: str, order: str) -> DataFrame:
    """(block, dropped): blocks taken in order; a block with any key that an accepted earlier block had is dropped whole.

    A dropped block's keys don't count as seen, so the decision depends on the sequence: it is the first maximal independent
    set in the order. Rounds decide it without walking the sequence: a block that comes first for each of its keys is
    accepted, whatever shares a key with it is dropped, and both leave. Every round is two aggregates by key and a written
    table; no key's blocks meet in one task, and the number of rounds follows the longest chain of dependent blocks. Every round
    decides at least the first block left, so there is an end.
    Null and empty keys never collide.
    """
    pairs = items.filter(F.col(key) != "").groupBy(F.col(block).alias("block"), F.col(key).alias("key")).agg(F.min(order).alias("ord"))
    # a block's place is that of its first item
    places = items.groupBy(F.col(block).alias("block")).agg(F.struct(F.min(order).alias("o"), F.first(block).alias("b")).alias("place"))
    repeated = pairs.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    contested = lookup_join(pairs, repeated, "key", "n").select("block").distinct()  # all other blocks stay, whatever happens
    left = written(pairs.select("block", "key").join(contested, "block", "left_semi").join(places, "block"), "blocks")
    dropped = None
    for n in count(1):
        firsts = written(left.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("n")), "blocks")
        seen = lookup_join(left, firsts, "key", "n").select("block", "key", "n", (F.col("place") == F.col("first")).alias("leads"))
        accepted = written(seen.groupBy("block").agg(F.min("leads").alias("all")).filter("all").select("block"), "blocks")
        taken = firsts.join(accepted.select(F.col("block").alias("winner")), F.col("first.b") == F.col("winner"), "left_semi").select("key", "n")
        losers = lookup_join(left, taken, "key", "n").select("block").distinct().join(accepted, "block", "left_anti")
        losers = written(losers, "blocks")
        dropped = losers if dropped is None else dropped.unionByName(losers)
        if n % 20 == 0:  # a long chain doesn't become a long plan
            dropped = written(dropped, "blocks")
        left = written(left.join(accepted.unionByName(losers), "block", "left_anti"), "blocks")
        if left.isEmpty():
            break
    return places.select("block").join(dropped.distinct().withColumn("hit", F.lit(True)), "block", "left").select("block", F.coalesce("hit", F.lit(False)).alias("dropped"))


def residual_duplicates(items: DataFrame, fingerprint: str) -> DataFrame:
    """(fingerprint, n, first_id) of fingerprints that occur more than once."""
    return items.groupBy(fingerprint).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def symmetric_difference(found: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(id, side): ids that only one of the two sets has."""
    a, b = found.select("id").distinct(), reviewed.select("id").distinct()
    return a.join(b, "id", "left_anti").withColumn("side", F.lit("found")).unionByName(b.join(a, "id", "left_anti").withColumn("side", F.lit("reviewed")))
