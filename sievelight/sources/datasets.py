"""Datasets with a row order: CSV, JSON array and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.functions.compat import trim
from sievelight.sources.json_ranges import read_json_objects
from sievelight.sources.lines import read_numbered_lines

JSON_MAP = "map<string,string>"


def _named(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read_csv_dataset(spark: SparkSession, path: str) -> DataFrame:
    """`source, n` and one text column per header cell; short rows are padded with empty text.

    All files under the path must have the same header; one with another header is an error when rows are read.
    """
    header = [c.strip() for c in spark.read.option("header", True).csv(path).columns]
    options = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    shape = ", ".join(f"{_named(name)} string" for name in header)
    cells = F.array(*[F.coalesce(F.col("row")[name], F.lit("")) for name in header])
    lines = read_numbered_lines(spark, path, kept_only=True)
    lines = lines.select("source", "n", F.from_csv("line", shape, options).alias("row")).select("source", "n", cells.alias("cells"))
    other = (F.col("n") == 1) & (F.col("cells") != F.array(*map(F.lit, header)))
    # The check is part of the filter, or the optimizer would drop header rows before they are looked at.
    wrong = F.raise_error(F.concat(F.lit("another header in "), F.col("source"))).cast("boolean")
    rows = lines.filter(F.when(other, wrong).otherwise(F.col("n") > 1))
    return rows.select("source", (F.col("n") - 1).alias("n"), *[F.get("cells", F.lit(k)).alias(name) for k, name in enumerate(header)])


def _from_json_rows(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """`source, n, fields` and the schema's columns from one object text per row."""
    parsed = rows.select(
        "source", "n", F.from_json("object", JSON_MAP).alias("fields"), F.from_json("object", schema).alias("row")
    )
    return parsed.select("source", "n", "fields", *[F.col("row")[c].alias(c) for c in schema.names])


def read_jsonl_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One object per line; lines that do not start an object are skipped and not counted. A broken object is an error."""
    schema = schema or spark.read.json(path).drop("_corrupt_record").schema
    lines = read_numbered_lines(spark, path, keep=trim(F.col("line")).startswith("{"), kept_only=True)
    broken = F.raise_error(F.concat(F.lit("broken JSON in row "), F.col("n"), F.lit(" of "), F.col("source"))).cast("string")
    whole = F.when(trim(F.col("line")).endswith("}") & F.from_json("line", JSON_MAP).isNotNull(), F.col("line")).otherwise(broken)
    return _from_json_rows(lines.select("source", "n", whole.alias("object")), schema)


def read_json_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """An array of objects per file, of any size; anything else is an error. Many tasks share a large file (see `json_ranges`)."""
    objects = read_json_objects(spark, path)
    schema = schema or spark.read.json(objects.select("object").rdd.map(lambda row: row["object"])).drop("_corrupt_record").schema
    broken = F.raise_error(F.concat(F.lit("broken JSON in row "), F.col("n"), F.lit(" of "), F.col("source"))).cast("string")
    whole = F.when(F.from_json("object", JSON_MAP).isNotNull(), F.col("object")).otherwise(broken)
    return _from_json_rows(objects.select("source", "n", whole.alias("object")), schema)


READERS = {"csv": read_csv_dataset, "json": read_json_dataset, "jsonl": read_jsonl_dataset}


def read_dataset(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """A dataset by its file ending, or by `form`: csv, json, else JSON lines."""
    form = form or next((f for f in ("csv", "json") if path.lower().endswith(f".{f}")), "jsonl")
    return READERS[form](spark, path)
