"""URL filters: host rules first, then host reputation by empirical Bayes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.plans.sizing import broadcast_if_small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without it."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, null where none does.

    `rules` is a short list of (verdict, `host/path`). A rule fits its host and all subdomains, where the path starts
    with the rule's. The longest is the one with most characters; of equals, the first in the list.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda r: len(r[1])) if rules else []:
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def registered_domain(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def public_suffix(host: Column) -> Column:
    """The last label."""
    return F.substring_index(host, ".", -1)


def _shrunk(level: DataFrame, mean: Column, floor: float, ceiling: float) -> DataFrame:
    """Adds alpha and beta to rows of `good, seen` and the parent's `mean`.

    The prior's weight is one number per level, by moments: rho is what the rates of the children scatter about their
    parents' means beyond binomial chance, and a beta with mean m and correlation rho weighs 1 / rho - 1 outcomes.
    """
    level = level.withColumn("mean", F.greatest(F.lit(0.001), F.least(F.lit(0.999), mean)))
    rate, m = F.col("good") / F.col("seen"), F.col("mean")
    scatter = F.col("seen") * (rate - m) * (rate - m) / (m * (1 - m))
    rho = level.filter("seen > 0").agg(((F.sum(scatter) - F.count("*")) / F.sum(F.col("seen") - 1)).alias("rho"))
    rho = rho.select(F.greatest(F.lit(floor), F.least(F.lit(ceiling), F.coalesce("rho", F.lit(ceiling)))).alias("rho"))
    weight = 1 / rho.scalar() - 1
    return level.select(
        "*", (weight * m + F.col("good")).alias("alpha"), (weight * (1 - m) + F.col("seen") - F.col("good")).alias("beta")
    )


def host_reputation(outcomes: DataFrame, z: float = 1.645, floor: float = 0.001, ceiling: float = 0.5) -> DataFrame:
    """Posterior of the good rate of every host in `outcomes` (host, good): host, good, seen, alpha, beta, mean, lower.

    `good` is 1, 0 or null for a page without a label; every host gets a row, labelled or not. Outcomes are counted by
    host, those counts by registered domain, those by suffix and those over all. From the top down each level is a
    beta-binomial whose prior mean is the posterior mean of its parent; `lower` is the mean less `z` standard
    deviations of the host's posterior. Null hosts count as the empty host.
    """
    outcomes = outcomes.select(F.coalesce("host", F.lit("")).alias("host"), F.col("good").cast("long").alias("good"))
    counted = [F.sum("good").alias("good"), F.sum("seen").alias("seen")]
    hosts = (
        outcomes.groupBy("host")
        .agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.count("good").alias("seen"))
        .withColumn("domain", registered_domain(F.col("host")))
        .withColumn("suffix", public_suffix(F.col("host")))
    )
    domains = hosts.groupBy("domain", "suffix").agg(*counted)
    suffixes = domains.groupBy("suffix").agg(*counted)
    whole = suffixes.agg(((F.sum("good") + 1) / (F.sum("seen") + 2)).alias("mean"))
    suffixes = _shrunk(suffixes, F.coalesce(whole.scalar(), F.lit(0.5)), floor, ceiling)
    above = suffixes.select("suffix", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("above"))
    domains = _shrunk(domains.join(above, "suffix"), F.col("above"), floor, ceiling).drop("above")
    above = domains.select("domain", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("above"))
    hosts = _shrunk(hosts.join(above, "domain"), F.col("above"), floor, ceiling)
    a, b = F.col("alpha"), F.col("beta")
    spread = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", "good", "seen", "alpha", "beta", (a / (a + b)).alias("mean"), (a / (a + b) - z * spread).alias("lower"))


def url_filter(
    pages: DataFrame, rules: Sequence[tuple[str, str]], good: Column, bound: float = 0.5, z: float = 1.645
) -> DataFrame:
    """All columns of `pages` (with `url`) and host, path, rule, lower, verdict (`allow` or `block`).

    The longest fitting rule decides; where none fits, pages of hosts whose posterior lower bound reaches `bound` are
    allowed. `good` is the page's own labelled outcome, null where it has none. A null url, or one without `://`, has
    an empty host and path and is judged by the reputation of the empty host. Rows are kept as they are, repeats too.
    Columns of `pages` with the names of the added ones are replaced.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "lower", "verdict")]
    named = pages.select(*own, url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), good.alias("_good"))
    known = host_reputation(named.select("host", F.col("_good").alias("good")), z).select("host", "lower")
    rule, says = first_rule(F.col("host"), F.col("path"), rules)
    judged = named.join(broadcast_if_small(known), "host", "left")
    method = F.when(F.col("lower") >= bound, "allow").otherwise("block")
    return judged.select(*own, "host", "path", rule.alias("rule"), "lower", F.coalesce(says, method).alias("verdict"))
