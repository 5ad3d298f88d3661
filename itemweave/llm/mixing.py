"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemweave.llm.tokens import with_tokens
from itemweave.session import written

SEED = 20240607


def _uniform(*keys: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by seed and keys."""
    return (F.xxhash64(F.lit(seed), *keys).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))


def rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, rate) of every source of the documents or the targets.

    The mixture is the largest one in which every source reaches its share: its size is the smallest
    max_repeats * tokens / share, so one source is used max_repeats times and all others less. A source without a target
    has rate 0, as has a target source without any token; such a source doesn't bound the others.
    """
    tokens = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    goals = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    both = tokens.filter("source is not null").join(goals, "source", "full").select(
        "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
        F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"),
    )
    bound = both.filter("target_share > 0 and tokens > 0").agg(F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share")).alias("total"))
    total = bound.first().total or 0.0  # one number
    rate = F.when((F.col("tokens") > 0) & (F.col("target_share") > 0), F.col("target_share") * F.lit(total) / F.col("tokens"))
    return both.select(
        "source", "target_share", "max_repeats", "tokens", F.least(F.coalesce(rate, F.lit(0.0)), F.col("max_repeats").cast("double")).alias("rate")
    )


def mixture(documents: DataFrame, targets: DataFrame, seed: int = SEED, tokenizer: str | None = None, text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sizes, copies): tokens of all documents, and (doc_id, source, tokens, copies) of the documents in the mixture, with text where asked for.

    A document is used floor(rate) times, and once more with the probability of the fraction, decided by a hash of seed and
    doc_id. Documents without a source, or with null or empty text, are no part of the mixture. Repeated doc_ids count as
    rows of their own.
    """
    sizes = written(with_tokens(documents, tokenizer, text), "p9-sizes")
    rate = rates(sizes, targets).filter("rate > 0").select("source", "rate")
    copies = F.floor("rate") + (_uniform(F.col("doc_id"), seed=seed) < F.col("rate") - F.floor("rate")).cast("long")
    chosen = sizes.filter("tokens > 0").join(rate, "source").withColumn("copies", copies).filter("copies > 0")
    return sizes, chosen.select("doc_id", "source", "tokens", "copies", *(["text"] if text else []))


def report(documents: DataFrame, targets: DataFrame, seed: int = SEED, tokenizer: str | None = None) -> DataFrame:
    """(source, target_share, reached_share, tokens, repeats, max_repeats): tokens in the mixture, repeats as the rate used."""
    sizes, chosen = mixture(documents, targets, seed, tokenizer)
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"))
    rows = rates(sizes, targets).join(used, "source", "left").withColumn("used", F.coalesce("used", F.lit(0).cast("long")))
    total = rows.agg(F.sum("used").alias("total")).first().total or 0  # one number
    return rows.select(
        "source", "target_share", (F.col("used") / F.lit(max(total, 1))).alias("reached_share"),
        F.col("used").alias("tokens"), F.col("rate").alias("repeats"), "max_repeats",
    )


def mixed(documents: DataFrame, targets: DataFrame, seed: int = SEED, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, copy, tokens, text): the documents of the mixture, one row for every use of a document."""
    _, chosen = mixture(documents, targets, seed, tokenizer, text=True)
    return chosen.select("doc_id", "source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), "tokens", "text")
