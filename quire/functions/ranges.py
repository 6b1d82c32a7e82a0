"""Ranges of a number, cut at sorted bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that quantiles are taken of, about.
SAMPLED = 1 << 16


def at_or_below(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above a number, by binary search; 0 for null."""
    steps = [F.lit(1 << k) for k in reversed(range(max(1, len(bounds).bit_length())))]
    known = F.split(F.lit(",".join(map(str, bounds or [(1 << 63) - 1]))), ",").cast("array<bigint>")
    return F.aggregate(F.array(*steps), F.lit(0), lambda at, step: F.when(F.try_element_at(known, at + step) <= value, at + step).otherwise(at))


def quantiles(df: DataFrame, value: Column, parts: int) -> list[int]:
    """Bounds of about `parts` ranges of near equal numbers of different values, from a sample of SAMPLED of them, chosen by hash."""
    rows, span = df.select(value.alias("v")).filter("v IS NOT NULL"), 1 << 30
    n = rows.count()
    share = span if n <= SAMPLED else span * SAMPLED // n
    seen = sorted(r.v for r in rows.filter(F.pmod(F.xxhash64(F.lit("quantiles"), "v"), F.lit(span)) < share).distinct().collect())
    return seen[:: max(1, -(-len(seen) // parts))][1:]
