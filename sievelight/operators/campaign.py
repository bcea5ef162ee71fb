"""Campaign link audit and attribution.

Tables: `posts(source, file, text)`, `campaigns(source, fields map, text)`, `visits(source, url, visits)` and
`sales(source, url, ...)`; `source` is the campaign.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.compat import is_blank, number, split_lines, trim
from sievelight.functions.links import UTM3, is_pii_line, link_utm, links_in_line, lower_ok
from sievelight.operators.findings import as_findings, from_hits, hit, hits, text, union_findings
from sievelight.plans.spread import explode_once

HASH_LENGTH = 16


def lines_of_files(files: DataFrame) -> DataFrame:
    """`source, file, line_no, line` of `source, file, text`."""
    return files.select("source", "file", F.posexplode(split_lines(F.col("text"))).alias("at", "line")).select(
        "source", "file", (F.col("at") + 1).cast("long").alias("line_no"), "line"
    )


def extract_links(posts: DataFrame) -> DataFrame:
    """`source, file, line_no, url` of every external markdown or href link."""
    return explode_once(lines_of_files(posts), links_in_line(F.col("line")), "url", "source", "file", "line_no")


def campaign_fields(campaigns: DataFrame, required: Sequence[str] = UTM3) -> DataFrame:
    """Required fields: absent ones are `missing-field`, ones with upper case `bad-utm`."""
    known = F.col("fields").isNotNull()
    checks = [(~known, hit("missing-field", "campaign file is missing or is not JSON"))]
    for name in required:
        value, key = F.col("fields")[name], F.lit(name)
        blank = is_blank(value)
        checks.append((known & blank, hit("missing-field", f"campaign file is missing {name}", key=key)))
        checks.append((known & ~blank & ~lower_ok(value), hit("bad-utm", f"campaign field {name} is not lowercase", key=key)))
    return from_hits(campaigns, hits(*checks))


def _quoted(detail: Column, value: Column, include_text: bool) -> Column:
    return F.concat(detail, F.lit(": "), F.coalesce(value, F.lit(""))) if include_text else detail


def bad_utm(links: DataFrame, include_text: bool = False) -> DataFrame:
    """utm_* names or values of a link that are not lower case; an empty value counts."""
    parts = links.select("source", "file", "line_no", F.explode(link_utm(F.col("url"))).alias("name", "used"))
    renamed = F.col("used.name") != F.col("name")
    wrong = parts.filter(renamed | ~lower_ok(F.col("used.value")))
    detail = F.when(
        renamed, text("link line ", F.col("line_no"), ' uses an uppercase name for "', F.col("name"), '"')
    ).otherwise(
        _quoted(text("link line ", F.col("line_no"), " ", F.col("name"), " value is not lowercase"), F.col("used.value"), include_text)
    )
    return as_findings(wrong, "bad-utm", detail, F.col("line_no"), F.col("file"))


def missing_utm(links: DataFrame, required: Sequence[str] = UTM3, include_text: bool = False) -> DataFrame:
    """Links without the required parameters; the finding lists which."""
    utm = link_utm(F.col("url"))
    lacking = F.filter(
        F.array(*[F.when(F.coalesce(utm[k]["value"], F.lit("")) == "", F.lit(k)) for k in required]),
        lambda k: k.isNotNull(),
    )
    short = links.withColumn("lacking", lacking).filter(F.size("lacking") > 0)
    detail = _quoted(
        text("link line ", F.col("line_no"), " is missing ", F.array_join("lacking", ", ")),
        F.col("url"),
        include_text,
    )
    return as_findings(short, "missing-utm", detail, F.col("line_no"), F.col("file"))


def pii_scan(lines: DataFrame) -> DataFrame:
    """Lines of `source, file, line_no, line` that hold an email or a phone number."""
    found = lines.filter(is_pii_line(F.col("line")))
    detail = text("file ", F.col("file"), " line ", F.col("line_no"), " holds an email or phone")
    return as_findings(found, "pii", detail, F.col("line_no"), F.col("file"))


def _triple(url: Column) -> list[Column]:
    utm = link_utm(url)
    return [F.lower(F.coalesce(utm[k]["value"], F.lit(""))).alias(k) for k in UTM3]


def scoreboard_join(visits: DataFrame, sales: DataFrame, campaigns: DataFrame) -> DataFrame:
    """`source, visits_total, visits_joined, sales_total, sales_joined` per campaign.

    Visits and sales are folded to one row per UTM triple before they meet the campaigns, so a campaign
    with a third of all visits is a few rows by then.
    """
    amount = F.coalesce(number(F.col("visits")), F.lit(0.0))
    rows = visits.select("source", *_triple(F.col("url")), amount.alias("visits"), F.lit(0).alias("sales")).unionByName(
        sales.select("source", *_triple(F.col("url")), F.lit(0.0).alias("visits"), F.lit(1).alias("sales"))
    )
    folded = rows.groupBy("source", *UTM3).agg(F.sum("visits").alias("visits"), F.sum("sales").alias("sales"))
    totals = folded.groupBy("source").agg(F.sum("visits").alias("visits_total"), F.sum("sales").alias("sales_total"))
    own = campaigns.select("source", *[F.lower(F.coalesce(F.col("fields")[k], F.lit(""))).alias(k) for k in UTM3])
    complete = own.filter(~F.array_contains(F.array(*UTM3), F.lit("")))
    joined = (
        complete.join(folded, ["source", *UTM3])
        .groupBy("source")
        .agg(F.sum("visits").alias("visits_joined"), F.sum("sales").alias("sales_joined"))
    )
    numbers = ("visits_total", "visits_joined", "sales_total", "sales_joined")
    return (
        campaigns.select("source")
        .join(totals, "source", "left")
        .join(joined, "source", "left")
        .select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])
    )


def campaign_findings(
    campaigns: DataFrame, posts: DataFrame, include_text: bool = False, required: Sequence[str] = UTM3
) -> DataFrame:
    """All four checks over campaign files and posts; `required` are the fields that campaigns and links must have."""
    links = extract_links(posts)
    texts = posts.unionByName(
        campaigns.filter(F.col("text").isNotNull()).select("source", F.lit("campaign.json").alias("file"), "text")
    )
    return union_findings(
        [
            campaign_fields(campaigns, required),
            bad_utm(links, include_text),
            missing_utm(links, required, include_text),
            pii_scan(lines_of_files(texts)),
        ]
    )


def content_hash(files: DataFrame) -> DataFrame:
    """`source, digest`: a fingerprint of each directory's file names, positions and texts, of whatever size.

    `files` is `source, file, position, text`. Each file is hashed with its place; the hashes of a directory are hashed in
    256 blocks, by a hash of the place, and those in turn. Only hashes are gathered, a block at a time.
    """
    place = F.concat(F.coalesce("position", F.lit("")), F.lit("\n"), F.coalesce("file", F.lit("")))
    leaf = F.sha2(F.concat(place, F.lit("\n"), F.coalesce("text", F.lit(""))), 256)
    leaves = files.select("source", F.left(F.sha2(place, 256), F.lit(2)).alias("block"), place.alias("place"), leaf.alias("leaf"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("place", "leaf"))), lambda x: x["leaf"])
    blocks = leaves.groupBy("source", "block").agg(F.sha2(F.array_join(in_order, ""), 256).alias("hash"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("block", "hash"))), lambda x: x["hash"])
    whole = blocks.groupBy("source").agg(F.sha2(F.array_join(in_order, ""), 256).alias("digest"))
    return whole.select("source", F.left("digest", F.lit(HASH_LENGTH)).alias("digest"))
