"""Not-modified revisits of web archives: what a 304 stands for is the latest earlier full response of its URL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm.urls import url_host, url_path

# Header fields that a 304 may update in a stored response.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")

#: Blocks of time into which the captures of one URL are cut, so that a URL with a third of all captures is many groups.
BLOCKS = 1024


def canonical_url(url: Column) -> Column:
    """Host in lower case without a default port, path without slashes at its end, query in order and without `utm_` fields.

    Scheme and fragment don't count. Null for a null url.
    """
    host = F.regexp_replace(url_host(url), ":(80|443)?$", "")
    path = F.regexp_replace(url_path(url), "/+$", "")
    fields = F.split(F.coalesce(F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1), F.lit("")), "&")
    kept = F.array_sort(F.filter(fields, lambda f: (f != "") & ~f.startswith("utm_")))
    return F.when(url.isNotNull(), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, permitted: Sequence[str] = PERMITTED, blocks: int = BLOCKS) -> DataFrame:
    """One row per revisit: `record_id, canonical_url, original_id, outcome, headers`.

    records: record_id (unique), url, ts (long), kind (`response` or `revisit`), status, etag, last_modified, digest and
    headers (map with names in lower case). A full response is a `response` of status 200. A revisit's original is the
    full response of the same canonical URL with the greatest `ts` below its own; of equal times, the greatest record_id.

    outcome: `resolved` if the revisit's validator agrees: its etag in weak comparison; without an etag its
    last_modified; without both its payload digest. `mismatch` if that differs, `unvalidated` if it has none of the
    three, `orphan` without an earlier full response, a null url or a null ts. headers: the original's, with the
    permitted ones of the revisit in their place, for resolved rows; otherwise null.

    Captures of a URL are cut into blocks of time. The last response of each block is aggregated and carried forward
    over the blocks; rows are ordered within blocks only. Payloads and headers take no part in that.
    """
    slim = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind", ((F.col("kind") == "response") & (F.col("status") == 200)).alias("full"))
    span = slim.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    low, high = F.coalesce(span.select("lo").scalar(), F.lit(0)), F.coalesce(span.select("hi").scalar(), F.lit(0))
    slim = slim.filter((F.col("full") | (F.col("kind") == "revisit")) & F.col("canonical_url").isNotNull() & F.col("ts").isNotNull())
    slim = slim.withColumn("block", F.floor((F.col("ts") - low) / ((high - low) / blocks + 1)).cast("int"))
    key = F.when(F.col("full"), F.struct("ts", "record_id"))
    lasts = slim.groupBy("canonical_url", "block").agg(F.max(key).alias("last"))
    before = Window.partitionBy("canonical_url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("canonical_url", "block", F.max("last").over(before).alias("carried"))
    # Of one time, revisits come first, so they only see what is strictly earlier.
    inside = Window.partitionBy("canonical_url", "block").orderBy("ts", F.col("full").cast("int"), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = slim.withColumn("near", F.max(key).over(inside)).filter("kind = 'revisit'")
    found = seen.join(carried, ["canonical_url", "block"]).select("record_id", F.coalesce("near", "carried")["record_id"].alias("original_id"))

    revisits = records.filter("kind = 'revisit'").withColumn("canonical_url", canonical_url(F.col("url"))).join(found, "record_id", "left").alias("v")
    originals = records.filter("kind = 'response' AND status = 200").select("record_id", "etag", "last_modified", "digest", "headers").alias("o")
    met = revisits.join(originals, F.col("v.original_id") == F.col("o.record_id"), "left")
    agrees = (
        F.when(F.col("v.etag").isNotNull(), F.coalesce(_weak(F.col("v.etag")) == _weak(F.col("o.etag")), F.lit(False)))
        .when(F.col("v.last_modified").isNotNull(), F.coalesce(F.col("v.last_modified") == F.col("o.last_modified"), F.lit(False)))
        .when(F.col("v.digest").isNotNull(), F.coalesce(F.col("v.digest") == F.col("o.digest"), F.lit(False)))
    )
    outcome = F.when(F.col("o.record_id").isNull(), "orphan").when(agrees.isNull(), "unvalidated").when(agrees, "resolved").otherwise("mismatch")
    none = F.create_map().cast("map<string,string>")
    fresh = F.map_filter(F.coalesce("v.headers", none), lambda k, _: F.lower(k).isin(*permitted))
    stale = F.map_filter(F.coalesce("o.headers", none), lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
    told = met.select("v.record_id", "v.canonical_url", F.col("o.record_id").alias("original_id"), outcome.alias("outcome"), F.map_concat(stale, fresh).alias("headers"))
    return told.withColumn("headers", F.when(F.col("outcome") == "resolved", F.col("headers")))
