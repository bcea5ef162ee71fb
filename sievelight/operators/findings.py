"""The common output of every audit: `source, kind, row, key, detail`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.plans.spread import explode_once

COLUMNS = ("source", "kind", "row", "key", "detail")
HITS_TYPE = "array<struct<kind:string,row:bigint,key:string,detail:string>>"


def as_findings(
    hits: DataFrame, kind: str | Column, detail: Column, row: Column | None = None, key: Column | None = None
) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return hits.select(
        F.col("source").cast("string").alias("source"),
        kind.alias("kind"),
        (F.lit(None) if row is None else row).cast("long").alias("row"),
        (F.lit(None) if key is None else key).cast("string").alias("key"),
        detail.alias("detail"),
    )


def union_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def text(*parts: str | Column) -> Column:
    """Detail text from words and columns; a NULL part is left out."""
    cells = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat(*cells)


def hit(kind: str | Column, detail: str | Column, row: Column | None = None, key: Column | None = None) -> Column:
    """One finding inside a row."""
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        (F.lit(None) if row is None else row).cast("long").alias("row"),
        (F.lit(None) if key is None else key).cast("string").alias("key"),
        (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"),
    )


def hits(*checks: tuple[Column, Column]) -> Column:
    """The findings of the (failed, finding) checks that fail, as an array."""
    return F.filter(F.array(*[F.when(failed, found) for failed, found in checks]), lambda h: h.isNotNull())


def from_hits(df: DataFrame, found: Column, source: str = "source") -> DataFrame:
    """Findings of the arrays in one scan, however many checks they come from."""
    rows = explode_once(df, found, "hit", F.col(source).cast("string").alias("source"))
    return rows.select("source", *[F.col(f"hit.{c}").alias(c) for c in COLUMNS[1:]])


def first_per_kind(findings: DataFrame) -> DataFrame:
    """The first finding, by row, of each kind in each source."""
    return (
        findings.groupBy("source", "kind")
        .agg(F.min(F.struct("row", "key", "detail")).alias("first"))
        .select("source", "kind", "first.row", "first.key", "first.detail")
    )


def kinds(findings: DataFrame) -> DataFrame:
    """Sorted distinct kinds of each source."""
    return findings.groupBy("source").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def by_kind(findings: DataFrame, pivot: bool = False) -> DataFrame:
    """Findings per kind: rows `source, kind, findings`, or one `defect_<kind>` column per kind."""
    if not pivot:
        return findings.groupBy("source", "kind").agg(F.count("*").alias("findings"))
    named = findings.withColumn("name", F.concat(F.lit("defect_"), F.replace("kind", F.lit("-"), F.lit("_"))))
    return named.groupBy("source").pivot("name").agg(F.count("*"))
