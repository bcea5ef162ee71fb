"""Order-dependent columns without sorting a whole source in one task.

Rows are cut into blocks of consecutive order values. Each block is sorted on its own; what it needs from
the rows before it is one number per block, summed up or carried over the short table of blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.plans.session import cut_lineage

BLOCK_ROWS = 100_000


def _blocked(df: DataFrame, order: str, block_rows: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / F.lit(block_rows)))


def _before(by: Sequence[str]) -> Window:
    return Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def dense_index(
    df: DataFrame, by: Sequence[str], order: str, name: str = "idx", block_rows: int = BLOCK_ROWS, tasks: int | None = None
) -> DataFrame:
    """Adds `name` = 0, 1, 2, ... per `by` in the order of a whole-number column that is unique per `by`.

    The blocks are dealt to `tasks` partitions, else to as many as the session's shuffles have.
    """
    blocked = _blocked(df, order, block_rows)
    blocked = blocked if tasks is None else blocked.repartition(tasks, *by, "_block")
    offsets = (
        blocked.groupBy(*by, "_block")
        .agg(F.count("*").alias("_rows"))
        .select(*by, "_block", F.coalesce(F.sum("_rows").over(_before(by)), F.lit(0)).alias("_offset"))
    )
    place = F.row_number().over(Window.partitionBy(*by, "_block").orderBy(order)) - 1
    return (
        blocked.withColumn("_place", place)
        .join(offsets, [*by, "_block"])
        .withColumn(name, F.col("_offset") + F.col("_place"))
        .drop("_block", "_offset", "_place")
    )


def max_before(
    df: DataFrame, by: Sequence[str], order: str, value: Column, name: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds `name` = largest non-null `value` over the rows before this one, NULL when there is none."""
    blocked = _blocked(df.withColumn("_value", value), order, block_rows)
    carried = (
        blocked.groupBy(*by, "_block")
        .agg(F.max("_value").alias("_top"))
        .select(*by, "_block", F.max("_top").over(_before(by)).alias("_carried"))
    )
    earlier = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.withColumn("_local", F.max("_value").over(earlier))
        .join(carried, [*by, "_block"])
        .withColumn(name, F.greatest("_local", "_carried"))
        .drop("_block", "_value", "_local", "_carried")
    )


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Adds `name` = 0, 1, 2, ... over the whole table in the order of any columns.

    A distributed range sort, written once so that both uses below see the same partitions, then one
    row count per partition. Partition numbers are in the sort order.
    """
    numbered = (
        df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).transform(cut_lineage)
    )
    part = F.shiftright("_at", 33)
    starts = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return (
        numbered.withColumn("_part", part)
        .join(starts, "_part")
        .withColumn(name, F.col("_start") + within)
        .drop("_at", "_part", "_start")
    )
