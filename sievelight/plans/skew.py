"""Joins of rows with facts about their own key, where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARES = 1_000


def attach_facts(rows: DataFrame, key: str, facts: DataFrame, copies: str, columns: list[str], spread: Column) -> DataFrame:
    """Left join of `rows` with `facts`, which has one row per text or binary `key` and counts its rows in `copies`.

    A key is hot when it holds more than one thousandth of all counted rows, so there are never more than a
    thousand hot keys and their facts are broadcast. Hot rows then get a join key of their own, made from
    `spread`, so that the shuffle join sees small keys only. `spread` must be distinct enough to scatter rows.
    """
    share = facts.select((F.sum(copies) / HOT_SHARES).alias("share")).scalar()
    hot = facts.filter(F.col(copies) > share)
    cold = facts.filter(F.col(copies) <= share)
    hot = hot.select(F.col(key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in columns])
    cold = cold.select(F.col(key).alias("_cold_key"), *[F.col(c).alias(f"_cold_{c}") for c in columns])
    scattered = F.unhex(F.sha1(spread.cast("string"))).cast(rows.schema[key].dataType)
    is_cold = F.col("_hot_key").isNull()
    joined = (
        rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
        .withColumn("_join_key", F.when(is_cold, F.col(key)).otherwise(scattered))
        .join(cold, F.col("_join_key") == F.col("_cold_key"), "left")
    )
    facts_of = [F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in columns]
    return joined.select(*rows.columns, *facts_of)


def attach_group_first(rows: DataFrame, key: str, row: str = "n", name: str = "first_n") -> DataFrame:
    """Adds the lowest `row` of each row's non-null `key` group; NULL where the key is not repeated."""
    groups = (
        rows.groupBy(key)
        .agg(F.min(row).alias(name), F.count("*").alias("_copies"))
        .filter(F.col("_copies") > 1)
    )
    return attach_facts(rows, key, groups, "_copies", [name], F.col(row))


def lookup(rows: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of `rows` with `facts`, which has one row per `on`; wide hot rows are not shuffled at all.

    Keys holding more than one thousandth of all rows are at most a thousand. Their rows meet broadcast facts
    where they are; all other rows take the shuffle join.
    """
    counts = rows.groupBy(*on).agg(F.count("*").alias("_copies"))
    share = rows.select((F.count("*") / HOT_SHARES).alias("share")).scalar()
    hot_keys = F.broadcast(counts.filter(F.col("_copies") > share).select(*on))
    hot = rows.join(F.broadcast(facts.join(hot_keys, on, "left_semi")), on)
    cold = rows.join(hot_keys, on, "left_anti").join(facts, on)
    return hot.unionByName(cold)
