"""Plan helpers for row-local work: enough partitions, and arrays computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """Redistributes a scan that has fewer partitions than the cluster has cores; any other is left as it is.

    A small file is one partition, and one core would then run all regex work. A large input has enough
    partitions already and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def explode_once(df: DataFrame, array: Column, name: str, *keep: str | Column, position: str | None = None) -> DataFrame:
    """`keep` columns and one row per element of a computed array, elements being non-null.

    A plain explode makes the optimizer test the array's size below the projection, which computes the array
    twice per row. The outer form is not rewritten that way; rows without elements leave right after it.
    """
    made = F.explode_outer(array).alias(name) if position is None else F.posexplode_outer(array).alias(position, name)
    return df.select(*keep, made).filter(F.col(name).isNotNull())
