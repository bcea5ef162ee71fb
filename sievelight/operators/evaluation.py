"""Rubric scoring and regression statistics.

Tables: `cases(case, checks array<struct<name, kind, value, flags>>)`, `answers(case, run, text)`. Both may carry
`suite`, which keeps several evaluations apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions.compat import half_up, is_blank, is_json, regex_column, split_lines
from sievelight.functions.stats import wilson_interval
from sievelight.plans.blocks import global_rank
from sievelight.plans.sizing import broadcast_if_small
from sievelight.plans.skew import lookup

# Check kinds, the gate and the default rubric.
KINDS = ("contains", "notContains", "regex", "notRegex", "maxLines", "minLines", "json")
PASS_GATE = 0.8
JUDGE_RUBRIC = [
    ("verdict-line", "regex", r"^\s*\**VERDICT\**:?\s*(PASS|FAIL|BLOCKED)", "m"),
    ("max-15-lines", "maxLines", "15", None),
    ("revert-line", "regex", "revert", "i"),
    ("names-a-command", "regex", r"\bnode |\bnpm |\bgit |\bpytest\b", None),
    ("no-email", "notRegex", r"[\w.+-]+@[\w-]+\.[\w.-]+", None),
]
CHECKS_TYPE = "array<struct<name:string,kind:string,value:string,flags:string>>"


def rubric_checks(checks: Sequence[tuple[str, str, str | None, str | None]]) -> Column:
    """A rubric given as plain tuples, as a `checks` column."""
    cells = [
        F.struct(*[F.lit(v).cast("string").alias(k) for k, v in zip(("name", "kind", "value", "flags"), check)])
        for check in checks
    ]
    return F.array(*cells).cast(CHECKS_TYPE)


def judge_rubric(spark: SparkSession) -> DataFrame:
    """The default rubric as rows `position, name, kind, value, flags`."""
    rows = [(i, *check) for i, check in enumerate(JUDGE_RUBRIC, 1)]
    return spark.createDataFrame(rows, "position int, name string, kind string, value string, flags string")


def _keys(df: DataFrame) -> list[str]:
    return ["suite"] if "suite" in df.columns else []


def run_checks(answers: DataFrame, cases: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """Answers of known cases with `results array<struct<key, ok>>`, one entry per check.

    All checks of an answer are evaluated in its own row. An unknown kind is an error. The JSON kind needs
    a Python pass over the answers; leave it out of `kinds` where no case uses it.
    """
    on = [*_keys(cases), "case"]
    prepared = cases.select(
        *on,
        F.transform(
            F.col("checks").cast(CHECKS_TYPE),
            lambda c: F.struct(
                F.coalesce(c["name"], c["kind"]).alias("key"),
                c["kind"].alias("kind"),
                c["value"].alias("value"),
                F.when(c["kind"].isin("regex", "notRegex"), regex_column(c["value"], c["flags"])).alias("pattern"),
                F.when(c["kind"].isin("maxLines", "minLines"), c["value"].cast("double")).alias("limit"),
            ),
        ).alias("checks"),
    )
    joined = lookup(answers.withColumn("text", F.coalesce("text", F.lit(""))), prepared, on)
    filled = F.size(F.filter(split_lines(F.col("text")), lambda line: ~is_blank(line)))
    joined = joined.withColumn("filled_lines", filled)
    if "json" in kinds:
        asked = F.exists("checks", lambda c: c["kind"] == "json")
        joined = joined.withColumn("valid_json", is_json(F.when(asked, F.col("text"))))
    body = F.col("text")

    def verdict(c: Column) -> Column:
        tests = {
            "contains": F.contains(body, c["value"]),
            "notContains": ~F.contains(body, c["value"]),
            "regex": F.regexp_like(body, c["pattern"]),
            "notRegex": ~F.regexp_like(body, c["pattern"]),
            "maxLines": F.col("filled_lines") <= c["limit"],
            "minLines": F.col("filled_lines") >= c["limit"],
            "json": F.col("valid_json"),
        }
        chosen = F.when(F.lit(False), F.lit(False))
        for kind in kinds:
            chosen = chosen.when(c["kind"] == kind, F.coalesce(tests[kind], F.lit(False)))
        return chosen.otherwise(F.raise_error(F.concat(F.lit("unknown check kind "), c["kind"])).cast("boolean"))

    results = F.transform("checks", lambda c: F.struct(c["key"].alias("key"), verdict(c).alias("ok")))
    return joined.withColumn("results", results).drop("checks", "filled_lines", "valid_json")


def score_answers(answers: DataFrame, cases: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """Adds `passed`: every check of the answer's case holds. Answers of unknown cases are left out."""
    return run_checks(answers, cases, kinds).withColumn("passed", F.forall("results", lambda r: r["ok"]))


def per_case(scored: DataFrame) -> DataFrame:
    """`case, runs, passes, rate, consistency, flaky` of cases with at least one run."""
    runs, passes = F.col("runs"), F.col("passes")
    return (
        scored.groupBy(*_keys(scored), "case")
        .agg(F.count("*").alias("runs"), F.count_if("passed").alias("passes"))
        .withColumn("rate", passes / runs)
        .withColumn("consistency", F.greatest(passes, runs - passes) / runs)
        .withColumn("flaky", (passes > 0) & (passes < runs))
    )


def failed_kinds(checked: DataFrame) -> DataFrame:
    """`case, key, failures`: failed checks per case, and over all cases where `case` is NULL."""
    failed = checked.select(
        *_keys(checked), "case", F.explode(F.filter("results", lambda r: ~r["ok"])).alias("failed")
    ).select(*_keys(checked), "case", F.col("failed.key").alias("key"))
    each = failed.groupBy(*_keys(checked), "case", "key").agg(F.count("*").alias("failures"))
    overall = each.groupBy(*_keys(checked), "key").agg(F.sum("failures").alias("failures"))
    return each.unionByName(overall.withColumn("case", F.lit(None).cast(each.schema["case"].dataType)))


def pass_gate(scored: DataFrame, threshold: float = PASS_GATE) -> DataFrame:
    """`n, pass, rate, low, high, threshold, gate` over all answers, per suite where there are suites."""
    totals = scored.groupBy(*_keys(scored)).agg(F.count("*").alias("n"), F.count_if("passed").alias("pass"))
    return (
        totals.withColumn("w", wilson_interval(F.col("pass"), F.col("n")))
        .select(*_keys(scored), "n", "pass", "w.rate", "w.low", "w.high")
        .withColumn("threshold", F.lit(float(threshold)))
        .withColumn("gate", F.when(F.col("rate") >= threshold, "PASS").otherwise("FAIL"))
    )


def regression_compare(current: DataFrame, baseline: DataFrame, on: Sequence[str] = ("suite",)) -> DataFrame:
    """Current against baseline `n, pass`: a regression only when the intervals do not meet."""
    now = current.select(*on, wilson_interval(F.col("pass"), F.col("n")).alias("now"))
    then = baseline.select(*on, wilson_interval(F.col("pass"), F.col("n")).alias("then"))
    worse = F.col("now.high") < F.col("then.low")
    drop = F.col("then.rate") - F.col("now.rate")
    return now.join(then, list(on)).select(
        *on,
        F.col("then.rate").alias("baseline_rate"),
        F.col("now.rate").alias("current_rate"),
        (half_up(drop * 1000) / 10).alias("drop_pts"),
        worse.alias("significant"),
        F.when(worse, "REGRESSION").otherwise("no significant change").alias("verdict"),
    )


def split_compare(scored: DataFrame, order: Sequence[str]) -> DataFrame:
    """Older `floor(n/2)` answers of each suite against the rest.

    The answers are ranked by one distributed sort; a suite's own rank is its distance from its first row.
    """
    keyed = scored if "suite" in scored.columns else scored.withColumn("suite", F.lit(""))
    ranked = global_rank(keyed.select("suite", *order, "passed"), ["suite", *order])
    ends = ranked.groupBy("suite").agg(F.min("rank").alias("first"), F.count("*").alias("size"))
    half = ranked.join(broadcast_if_small(ends), "suite").withColumn(
        "half", F.when(F.col("rank") - F.col("first") < F.floor(F.col("size") / 2), "older").otherwise("newer")
    )
    sums = half.groupBy("suite", "half").agg(F.count("*").alias("n"), F.count_if("passed").alias("pass"))
    newer = sums.filter(F.col("half") == "newer")
    older = (
        sums.filter(F.col("half") == "older")
        .unionByName(newer.select("suite", F.lit("older").alias("half"), F.lit(0).alias("n"), F.lit(0).alias("pass")))
        .groupBy("suite")
        .agg(F.sum("n").alias("n"), F.sum("pass").alias("pass"))
    )
    return regression_compare(newer, older)
