"""Expressions that give a text or an item an identity (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Lower case, letters and digits only; null counts as empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def option_values(options: Column) -> Column:
    """The option texts without their letters; a null map has none, a null text is empty."""
    return F.coalesce(F.map_values(options), F.array().cast("array<string>"))
