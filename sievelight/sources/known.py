"""A set of known patterns that grows from run to run: a table by digest, of which a run reads what it touches."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.plans.session import stored
from sievelight.sources.state import current_version, read_state, write_state

SCHEMA = "id string, key binary, prefix string"


def _prefix(key: Column) -> Column:
    """The first byte of a digest in hex: 256 parts of about equal size."""
    return F.lower(F.hex(F.substring(key, 1, 1)))


def known_keys(spark: SparkSession, path: str, prefixes: Iterable[str] | None = None) -> DataFrame:
    """`id, key, prefix` of the set at `path`, of the parts named only; without a set there are no rows."""
    rows = read_state(spark, path, SCHEMA)
    return rows if prefixes is None else rows.filter(F.col("prefix").isin(*prefixes))


def _touched(problems: DataFrame) -> list[str]:
    """The parts that the problems' keys belong to, 256 at most."""
    return [r["prefix"] for r in problems.select(_prefix(F.col("key")).alias("prefix")).distinct().collect() if r["prefix"] is not None]


def mark_known(problems: DataFrame, path: str) -> DataFrame:
    """Adds `status`, known or new, by the whole digest `key`: patterns that share a short id stay apart. Only touched parts are read."""
    problems = stored(problems)
    seen = known_keys(problems.sparkSession, path, _touched(problems)).select("key").distinct().withColumn("_seen", F.lit(True))
    status = F.when(F.col("_seen"), "known").otherwise("new")
    return problems.join(seen, "key", "left").withColumn("status", status).drop("_seen")


def add_known(problems: DataFrame, path: str) -> int:
    """Adds the patterns of `problems` (`id, key`) that the set does not hold, and gives their number.

    The keys are compared with the parts they fall into; files that are there stay as they are. A run that dies while it
    adds may leave some of its keys, which the next one finds.
    """
    spark = problems.sparkSession
    asked = stored(problems.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("id")).select("id", "key"))
    have = known_keys(spark, path, _touched(asked)).select("key").distinct()
    fresh = stored(asked.join(have, "key", "left_anti").select("id", "key", _prefix(F.col("key")).alias("prefix")))
    added = fresh.count()
    if added:
        now = current_version(spark, path)
        if now is None:
            write_state(fresh, path, partition_by=("prefix",))
        else:
            fresh.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(now)
    return added


def compact_known(spark: SparkSession, path: str) -> int:
    """Rewrites the set as a new version of one file per part, each key once, and gives the version's number."""
    rows = known_keys(spark, path).groupBy("key").agg(F.min("id").alias("id")).select("id", "key", _prefix(F.col("key")).alias("prefix"))
    return write_state(rows.repartition("prefix"), path, partition_by=("prefix",))
