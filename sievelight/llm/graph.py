"""Connected components without gathering links or groups anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.plans.session import stored
from sievelight.plans.sizing import BROADCAST_ROWS


def _contracted(links: DataFrame) -> DataFrame:
    """The links `a > b` of each partition made into stars: one from each node to the least that it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def least(node: int) -> int:
            while (above := up.setdefault(node, node)) != node:
                up[node] = node = up[above]
            return node

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = least(a), least(b)
                up[max(x, y)] = min(x, y)
        nodes = [node for node in up if least(node) != node]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([least(node) for node in nodes], pa.int64())], ["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over links `a > b`; links that a large star repeats leave in the small star after it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    met = both.join(least, "a")
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = out.filter("a > b")
    return out if large else out.distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", task_links: int = BROADCAST_ROWS) -> DataFrame:
    """`node, component` for every node of a link, `component` being the smallest node that it reaches.

    First, tasks of about `task_links` links each make stars of what they hold, so that few links are left, in short
    chains; links that make up one such task are done with that. Then alternating large and small stars: every round is
    one aggregation and one join over the links, and the number of rounds grows with the logarithm of the longest chain.
    A hub's links meet its minimum in a join that adaptive execution can split. Rounds are cut by tables in the shared
    folder. Links with a null end and loops are left out.
    """
    now = links.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b"))
    now = stored(now.filter("a > b"))
    tasks = max(1, -(-now.count() // task_links))
    now = stored(_contracted(now.coalesce(1) if tasks == 1 else now.repartition(tasks)))
    mark = _mark(now)
    while tasks > 1 and mark[0]:
        now = stored(_star(_star(now, True), False))
        was, mark = mark, _mark(now)
        if mark == was:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(links: DataFrame) -> tuple:
    """A count and a sum of hashes: equal for equal sets of links."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
