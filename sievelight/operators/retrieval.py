"""Lexical retrieval with BM25 over documents `source, doc, text`; `source` is the corpus."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.stats import bm25_part, idf
from sievelight.functions.text import tokenize
from sievelight.plans.session import stored
from sievelight.plans.sizing import broadcast_if_small, is_small
from sievelight.plans.spread import explode_once

# Saturation, length weight and list length.
K1, B, TOP = 1.2, 0.75, 5
RANK_DIGITS = 9

#: Blocks per term, by impact; terms of a query that are looked at first, and how many times the list length of postings each.
LEVELS, RARE, FIRST = 32, 8, 4
#: Share of the least score to beat that blocks left out may add up to: less joins more postings and names fewer documents.
LEFT_OUT = 0.5
#: Sums may differ by their order; scores this close to the least one to beat are still compared.
SLACK = 1e-8
#: Candidates that are broadcast at most.
CANDIDATES = 200_000


class Index(NamedTuple):
    """`postings(source, doc, length, term, tf)`, `df(source, term, df)`, `lengths(source, doc, length)`,
    `stats(source, n, average)`."""

    postings: DataFrame
    df: DataFrame
    lengths: DataFrame
    stats: DataFrame


def index_from(postings: DataFrame, lengths: DataFrame) -> Index:
    """An index over stored postings and lengths."""
    df = postings.groupBy("source", "term").agg(F.count("*").alias("df"))
    stats = lengths.groupBy("source").agg(F.count("*").alias("n"), F.avg("length").alias("average"))
    return Index(postings, df, lengths, stats)


def build_index(docs: DataFrame) -> Index:
    """Term counts per document. The length rides along with its postings, so ranking never joins for it."""
    tokens = docs.select("source", "doc", tokenize(F.col("text")).alias("tokens"))
    sized = tokens.withColumn("length", F.size("tokens"))
    postings = (
        explode_once(sized, F.col("tokens"), "term", "source", "doc", "length")
        .groupBy("source", "doc", "length", "term")
        .agg(F.count("*").alias("tf"))
    )
    return index_from(postings, sized.select("source", "doc", "length"))


def query_terms(queries: DataFrame) -> DataFrame:
    """`query, position, term`: distinct terms of `query, text` in order of first use."""
    return explode_once(queries, F.array_distinct(tokenize(F.col("text"))), "term", "query", position="position")


class Matched(NamedTuple):
    """`postings(source, doc, term, impact, level)` of query terms, `terms(source, term, idf, greatest)`, and
    `wanted(source, query, position, term, idf, greatest)`: the terms of each query that a source knows."""

    postings: DataFrame
    terms: DataFrame
    wanted: DataFrame


def match_postings(index: Index, queries: DataFrame, k1: float = K1, b: float = B) -> Matched:
    """The postings of query terms with what each adds to a score.

    A term's postings form blocks by level: its greatest impact in the source is cut into LEVELS steps, so a block's
    number bounds what its postings add. Postings are counted and weighted once and stored, since several steps read them.
    """
    terms = stored(query_terms(queries))
    # Restricting the terms first lets the restriction reach below the posting counts.
    matched = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    part = bm25_part(F.col("tf"), F.col("length"), F.col("average"), k1, b)
    parts = stored(matched.join(broadcast_if_small(stored(index.stats)), "source").select("source", "doc", "term", "n", part.alias("part")))
    counted = parts.groupBy("source", "term").agg(F.count("*").alias("df"), F.max("part").alias("part"), F.max("n").alias("n"))
    weight = idf(F.col("df"), F.col("n"))
    weights = stored(counted.select("source", "term", weight.alias("idf"), (weight * F.col("part")).alias("greatest")))
    # A corpus has at most one weight per query term, so few terms have few weights, and no common term is a hot key.
    impact = F.col("idf") * F.col("part")
    level = F.floor(impact / F.col("greatest") * LEVELS).cast("int")
    postings = parts.join(broadcast_if_small(weights), ["source", "term"]).select("source", "doc", "term", impact.alias("impact"), level.alias("level"))
    wanted = terms.join(broadcast_if_small(weights), "term").select("source", "query", "position", "term", "idf", "greatest")
    return Matched(postings, weights, stored(wanted))


def _first_postings(postings: DataFrame, count: int) -> DataFrame:
    """The `count` postings of each term that add most, equals by document; each task passes on its own best only."""
    best = Window.partitionBy("source", "term").orderBy(F.desc(F.round("impact", RANK_DIGITS)), "doc")
    return postings.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= count).select("source", "doc", "term")


def _scored(met: Matched, candidates: DataFrame, hits: bool = False) -> DataFrame:
    """`source, query, doc, raw` of stored `source, query, doc`: whole scores, rounded to nine digits, above 0.

    Postings and candidates meet by document, and what they make there is summed where it is: neither a posting nor a
    term of a query travels once per candidate. Candidates are broadcast if counted to be few. With `hits` the matched
    terms, rarest first, are gathered on the way.
    """
    wanted = met.wanted.select("source", "query", "position", "term", "idf")
    asked = F.broadcast(candidates) if is_small(candidates, CANDIDATES) else candidates
    found = met.postings.select("source", "doc", "term", "impact").join(asked, ["source", "doc"])
    found = found.join(broadcast_if_small(wanted), ["source", "query", "term"])
    gathered = F.array_sort(F.collect_list(F.struct((-F.round("idf", RANK_DIGITS)).alias("rare"), "position", "term")))
    more = [F.transform(gathered, lambda t: t["term"]).alias("hits")] if hits else []
    summed = found.groupBy("source", "query", "doc").agg(F.round(F.sum("impact"), RANK_DIGITS).alias("raw"), *more)
    return summed.filter(F.col("raw") > 0)


def _best(scored: DataFrame, top: int) -> DataFrame:
    best_first = Window.partitionBy("source", "query").orderBy(F.desc("raw"), "doc")
    return scored.withColumn("place", F.row_number().over(best_first)).filter(F.col("place") <= top)


def candidates(met: Matched, top: int) -> DataFrame:
    """`source, query, doc`: all documents that can be among the `top` best of a query, without scoring the others.

    First the best postings of a query's rarest terms name documents; their whole scores give the query's least score to
    beat. Then the query's terms are ordered by their greatest impact. Of the terms a document holds, let one be last in
    that order: the terms before it add at most the sum of their greatest impacts, so the posting must make up the rest.
    Blocks that can't make up even the share LEFT_OUT of the least score are never joined; a term of which every posting
    adds little, as one that most documents hold, has no others. What is joined is summed up by document: a term that
    wasn't found adds at most what its blocks left out hold, and documents that stay below the least score with that leave.
    """
    rarest = F.row_number().over(Window.partitionBy("source", "query").orderBy(F.desc("greatest"), "term"))
    rare = stored(met.wanted.withColumn("place", rarest).filter(F.col("place") <= RARE).select("source", "query", "term"))
    named = met.postings.join(broadcast_if_small(rare.select("source", "term").distinct()), ["source", "term"], "left_semi")
    first = _first_postings(named, FIRST * top).join(broadcast_if_small(rare), ["source", "term"])
    first = stored(first.select("source", "query", "doc").distinct())
    leaders = stored(_best(_scored(met, first), top))
    bars = leaders.filter(F.col("place") == top).select("source", "query", (F.col("raw") - SLACK).alias("bar"))
    before = Window.partitionBy("source", "query").orderBy("greatest", "term").rowsBetween(Window.unboundedPreceding, -1)
    below = met.wanted.withColumn("below", F.coalesce(F.sum("greatest").over(before), F.lit(0.0)))
    # The best documents of a single term are known from its first postings.
    alone = F.count("*").over(Window.partitionBy("source", "query")) == 1
    needs = below.withColumn("alone", alone).filter(~F.col("alone")).join(broadcast_if_small(bars), ["source", "query"], "left")
    # Without enough leaders there is nothing to beat, and every posting counts.
    needs = needs.withColumn("bar", F.coalesce("bar", F.lit(-1.0))).withColumn("need", F.col("bar") * LEFT_OUT - F.col("below"))
    hidden = F.least(F.col("greatest"), F.greatest(F.col("need"), F.lit(0.0)))
    rest = F.sum("hidden").over(Window.partitionBy("source", "query"))
    needs = needs.withColumn("hidden", hidden).withColumn("rest", rest).filter(F.col("greatest") >= F.col("need"))
    lowest = F.greatest(F.lit(0), F.floor(F.col("need") / F.col("greatest") * LEVELS).cast("int") - 1)
    blocks = needs.select("source", "query", "term", "need", "hidden", "rest", "bar", F.explode(F.sequence(lowest, F.lit(LEVELS))).alias("level"))
    found = met.postings.join(broadcast_if_small(stored(blocks)), ["source", "term", "level"]).filter("impact >= need")
    summed = found.groupBy("source", "query", "doc").agg(
        F.sum(F.col("impact") - F.col("hidden")).alias("more"), F.max("rest").alias("rest"), F.max("bar").alias("bar")
    )
    able = summed.filter(F.col("more") + F.col("rest") >= F.col("bar") - SLACK)
    return stored(able.select("source", "query", "doc").unionByName(leaders.select("source", "query", "doc")).distinct())


def bm25_topk(
    index: Index, queries: DataFrame, top: int = TOP, k1: float = K1, b: float = B, digits: int = 3, hits: bool = False
) -> DataFrame:
    """`source, query, place, doc, score`: the best documents of each query, score above 0; and `hits`, if asked for.

    Ties go to the lower document. Scores are compared after rounding to nine digits, since the order of
    a distributed sum is not fixed. Documents that can't be among the best are not scored (see `candidates`), and only
    the best of each task reach the ranking shuffle. `hits` are the matched query terms, rarest first.
    """
    top = max(1, top)
    met = match_postings(index, queries, k1, b)
    best = _best(_scored(met, candidates(met, top), hits), top)
    return best.select("source", "query", "place", "doc", F.round("raw", digits).alias("score"), *(["hits"] if hits else []))


def hit_terms(index: Index, queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """Adds `hits`, the matched query terms of each ranked document, rarest first. `bm25_topk` can give them itself."""
    met = match_postings(index, queries)
    found = _scored(met, stored(ranked.select("source", "query", "doc").distinct()), True)
    return ranked.join(found.drop("raw"), ["source", "query", "doc"])


def rank_eval(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """`query, doc, place, at_first, miss` for expectations `query, doc`; only a document that is not ranked is a miss."""
    on = [c for c in ("source", "query", "doc") if c in expected.columns]
    return (
        expected.join(ranked.select(*on, "place"), on, "left")
        .withColumn("at_first", F.coalesce(F.col("place") == 1, F.lit(False)))
        .withColumn("miss", F.col("place").isNull())
    )


def index_stats(index: Index, queries: DataFrame | None = None) -> DataFrame:
    """`source, files, terms` and, given queries, `queries`."""
    terms = index.df.groupBy("source").agg(F.count("*").alias("terms"))
    files = index.stats.select("source", F.col("n").alias("files"))
    out = files.join(terms, "source", "left").na.fill(0, ["terms"])
    if queries is None:
        return out
    return out.withColumn("queries", queries.select(F.count_distinct("query")).scalar())
