"""Closed-form statistics over aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson_interval(passed: Column, n: Column, z: float = 1.96) -> Column:
    """struct(rate, low, high): share with its Wilson score interval, all zero when there are no rows."""
    total = n.cast("double")
    rate = passed / total
    z2 = z * z
    scale = 1 + z2 / total
    centre = (rate + z2 / (2 * total)) / scale
    spread = z * F.sqrt(rate * (1 - rate) / total + z2 / (4 * total * total)) / scale

    def known(value: Column) -> Column:
        return F.when(n > 0, value).otherwise(F.lit(0.0))

    return F.struct(
        known(rate).alias("rate"),
        known(F.greatest(F.lit(0.0), centre - spread)).alias("low"),
        known(F.least(F.lit(1.0), centre + spread)).alias("high"),
    )


def idf(df: Column, n: Column) -> Column:
    """Weight of a term found in `df` of `n` documents."""
    return F.log1p((n - df + 0.5) / (df + 0.5))


def bm25_part(tf: Column, length: Column, average: Column, k1: float, b: float) -> Column:
    """Saturated, length-normalised term frequency; an empty document counts as length 1."""
    size = F.greatest(length, F.lit(1))
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / average))
