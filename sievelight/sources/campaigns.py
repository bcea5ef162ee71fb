"""Campaign folders: campaign.json, posts/*.md, visits.csv and sales.csv under one folder per campaign."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions.compat import is_json, trim
from sievelight.plans.skew import attach_facts
from sievelight.sources.lines import read_numbered_lines, read_text_files

HOME = r"(?i)^(.*?)/(campaign\.json|posts/[^/]*\.md|visits\.csv|sales\.csv)$"


class Campaigns(NamedTuple):
    """`campaigns(source, fields, text)`, `posts(source, file, text)`, `visits(source, url, visits)`,
    `sales(source, url, amount)`, `files(source, file, position, text)`."""

    campaigns: DataFrame
    posts: DataFrame
    visits: DataFrame
    sales: DataFrame
    files: DataFrame


def _home(path: Column) -> Column:
    return F.regexp_extract(path, HOME, 1)


def _table(spark: SparkSession, root: str, name: str, wanted: list[str]) -> DataFrame:
    """Rows of a CSV per campaign; columns are found by lower-cased header cell, absent ones are empty."""
    lines = read_numbered_lines(spark, root, glob=name, kept_only=True)
    cells = lines.select("source", "n", F.transform(F.split("line", ",", -1), trim).alias("cells"))
    heads = cells.groupBy("source").agg(
        F.count("*").alias("copies"), F.max(F.when(F.col("n") == 1, F.transform("cells", F.lower))).alias("head")
    )
    rows = attach_facts(cells.filter(F.col("n") > 1), "source", heads, "copies", ["head"], F.col("n"))

    def cell(column: str) -> Column:
        at = F.array_position("head", column).cast("int") - 1
        return F.coalesce(F.when(at >= 0, F.get("cells", at)), F.lit("")).alias(column)

    return rows.select(_home(F.col("source")).alias("source"), *[cell(c) for c in wanted])


def _any_case(glob: str) -> str:
    """File names are told apart without regard to case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in glob)


def _placed(files: DataFrame, path: str, *columns: str) -> DataFrame:
    """Files of a campaign folder as `source, file` and the columns named."""
    home, file = _home(F.col(path)).alias("source"), F.regexp_extract(path, HOME, 2).alias("file")
    return files.select(home, file, *columns).filter(F.col("file") != "")


def read_campaigns(spark: SparkSession, root: str) -> Campaigns:
    """The campaigns below a folder.

    Campaign files and posts are read whole, each kind by its own names; tables are read by lines, and whole only where
    `files` is asked for. Which folders there are comes from the listing, without any contents.
    """
    own = _placed(read_text_files(spark, root, glob=_any_case("campaign.json")), "source", "text")
    posts = _placed(read_text_files(spark, root, glob=_any_case("*.md")), "source", "text")
    tables = _placed(read_text_files(spark, root, glob=_any_case("*.csv")), "source", "text")
    placed = own.unionByName(posts).unionByName(tables)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    raw = own.filter(F.col("file") == "campaign.json").select("source", F.col("text"))
    homes = _placed(listing, "path").select("source").distinct()
    is_object = (F.left(trim(F.col("text")), F.lit(1)) == "{") & is_json(F.col("text"))
    fields = F.when(is_object, F.from_json("text", "map<string,string>", {"mode": "PERMISSIVE"}))
    campaigns = homes.join(raw, "source", "left").select("source", fields.alias("fields"), "text")
    posts = posts.filter(F.col("file").rlike(r"^posts/"))
    order = F.when(F.col("file") == "campaign.json", "0").when(F.col("file") == "visits.csv", "2").when(F.col("file") == "sales.csv", "3")
    position = F.coalesce(order, F.concat(F.lit("1"), F.col("file")))
    return Campaigns(
        campaigns,
        posts,
        _table(spark, root, "visits.csv", ["url", "visits"]),
        _table(spark, root, "sales.csv", ["url", "amount"]),
        placed.select("source", "file", position.alias("position"), "text"),
    )
