"""Time windows without a window per source.

A source may hold a third of all rows, and so may one second of one source. Neither is ever one task's
group here: rows are first folded to one row per (source, stamp), and the running sums run inside time
buckets whose number of distinct stamps is bounded by the bucket width. All shuffles have as many partitions as the
rows need, so what one task holds doesn't grow with the input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_WINDOWS = 4

#: Parts that the rows of one stamp, or the tokens of one bucket, are dealt to.
DEALS = 16


def covering_sums(spans: DataFrame, width: Column, by: Sequence[str], tasks: int, within: Sequence[str]) -> DataFrame:
    """Sum of the weights of all spans covering each anchor.

    `spans` has `by, lo, hi, weight, row` with `hi - lo <= width`; every span is an anchor at its `hi`. The width may be a
    column that is the same for all rows of one `by`. `spans` is partitioned by `by` and the columns `within`; there its
    changes are folded before they move.
    Returns `by, ts_ms, row, total`: one row per distinct anchor stamp with the lowest `row` on it.

    A forward window [t, t + W] holds an event at e exactly when t lies in [e - W, e], so counting
    events per window is counting spans over a point. A span adds its weight where it starts and
    takes it back after its end. A bucket is wider than any span, so a span meets at most two
    buckets and is opened again at the start of the second; no bucket needs rows of another.
    """
    size = width * BUCKET_WINDOWS + 1

    def bucket(at: Column) -> Column:
        return F.floor(at / size)

    def change(at_bucket: Column, at: Column, weight: Column, row: Column) -> Column:
        return F.struct(
            at_bucket.alias("bucket"), at.alias("ts_ms"), weight.cast("long").alias("weight"), row.alias("row")
        )

    lo, hi, weight = F.col("lo"), F.col("hi"), F.col("weight")
    no_row = F.lit(None).cast("long")
    changes = F.array(
        change(bucket(lo), lo, weight, no_row),
        change(bucket(hi), hi + 1, -weight, no_row),
        change(bucket(hi), hi, F.lit(0), F.col("row")),
        F.when(bucket(lo) != bucket(hi), change(bucket(hi), bucket(hi) * size, weight, no_row)),
    )

    def folded(rows: DataFrame, *more: str) -> DataFrame:
        return rows.groupBy(*by, *more, "bucket", "ts_ms").agg(F.sum("weight").alias("weight"), F.min("row").alias("row"))

    each = spans.select(*by, *within, F.explode(F.filter(changes, lambda c: c.isNotNull())).alias("c")).select(*by, *within, "c.*")
    per_stamp = folded(folded(each, *within).repartition(tasks, *by, "bucket"))
    running = (
        Window.partitionBy(*by, "bucket").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        per_stamp.withColumn("total", F.sum("weight").over(running))
        .filter(F.col("row").isNotNull())
        .select(*by, "ts_ms", "row", "total")
    )


def dealt(rows: DataFrame, tasks: int, by: str = "source") -> DataFrame:
    """The stamped rows with `deal`, partitioned by `by`, stamp and `deal`: equal stamps lie in a few partitions, never in one."""
    stamped = rows.filter(F.col("ts_ms").isNotNull()).withColumn("deal", F.pmod(F.xxhash64("n"), F.lit(DEALS)))
    return stamped.repartition(tasks, by, "ts_ms", "deal")


def forward_counts(events: DataFrame, width: int, tasks: int, by: str = "source") -> DataFrame:
    """Events of `by, ts_ms, n` inside [t, t + width] for every stamp t: `by, ts_ms, row, total`."""
    marks = dealt(events.select(by, "ts_ms", "n"), tasks, by).withColumn("token", F.lit(None).cast("string"))
    return _counts(marks, F.lit(width), tasks, [by])


def forward_distinct(tokens: DataFrame, width: int, tasks: int, by: str = "source") -> DataFrame:
    """Distinct tokens of `by, ts_ms, n, token` inside [t, t + width]: `by, ts_ms, row, total`."""
    return _counts(dealt(tokens.select(by, "ts_ms", "n", "token"), tasks, by), F.lit(width), tasks, [by])


def tagged_counts(marks: DataFrame, widths: Mapping[str, int], tasks: int, by: str = "source") -> DataFrame:
    """Several counts of one stream, each with its own window: `by, tag, ts_ms, row, total`.

    `marks` has `by, tag, token, ts_ms, n` and lies as `dealt` has left it, with `deal`. Marks without a token count as
    in `forward_counts`, those with one as in `forward_distinct`; a tag has marks of one sort. All tags go through the
    same shuffles, by tag and time bucket.
    """
    width = reduce(lambda rest, t: F.when(F.col("tag") == t, F.lit(widths[t])).otherwise(rest), widths, F.lit(1))
    return _counts(marks, width, tasks, [by, "tag"])


def _counts(marks: DataFrame, width: Column, tasks: int, by: list[str]) -> DataFrame:
    """The counts of `marks`, of which `by` has no column that is a literal: such a one would be no key of a partition.

    A token counts once per window, through its first use inside it: a use at e whose previous use is
    at p counts for window starts after p only. The previous use matters only within the width, so it
    is searched in the token's own bucket with the last uses of the bucket before.
    """
    uses = (
        marks.groupBy(*by, "ts_ms", "deal", "token")
        .agg(F.count("*").alias("times"), F.min("n").alias("row"))
        .withColumn("bucket", F.floor(F.col("ts_ms") / (width * BUCKET_WINDOWS)))
    )
    # Only a token's earlier use matters to the next bucket.
    near_end = F.col("token").isNotNull() & (F.col("ts_ms") >= (F.col("bucket") + 1) * width * BUCKET_WINDOWS - width)
    homes = F.when(near_end, F.array("bucket", F.col("bucket") + 1)).otherwise(F.array("bucket"))
    # A token's uses stay together; marks without one need no order, so their stamps are dealt out.
    part = F.pmod(F.xxhash64(F.coalesce("token", F.col("ts_ms").cast("string"))), F.lit(DEALS))
    within = ["home", "part"]
    in_order = Window.partitionBy(*by, *within, "token").orderBy("ts_ms")
    spans = (
        uses.select(*by, F.explode(homes).alias("home"), part.alias("part"), "token", "ts_ms", "times", "row")
        .repartition(tasks, *by, *within)
        .groupBy(*by, *within, "token", "ts_ms")
        .agg(F.sum("times").alias("times"), F.min("row").alias("row"))
        .withColumn("previous", F.when(F.col("token").isNotNull(), F.lag("ts_ms").over(in_order)))
        .filter(F.col("home") == F.floor(F.col("ts_ms") / (width * BUCKET_WINDOWS)))
        .select(
            *by,
            *within,
            F.greatest(F.col("previous") + 1, F.col("ts_ms") - width).alias("lo"),
            F.col("ts_ms").alias("hi"),
            F.when(F.col("token").isNull(), F.col("times")).otherwise(1).alias("weight"),
            "row",
        )
    )
    return covering_sums(spans, width, by, tasks, within)
