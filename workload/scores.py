"""Rubric evaluation, regression statistics and the metric ratchet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions.compat import is_json
from sievelight.functions.stats import wilson_interval
from sievelight.operators import evaluation as ev
from sievelight.operators import ratchet as rt
from sievelight.plans.session import stored
from sievelight.sources.sinks import save_baseline
from workload import inputs as i
from workload.files import scratch

KINDS = ("maxLines", "minLines", "regex", "notRegex", "contains", "notContains")


def _checked(spark, sf_dir):
    return ev.run_checks(i.answers(spark, sf_dir), i.cases(spark, sf_dir), KINDS)


def _scored(spark, sf_dir):
    return ev.score_answers(i.answers(spark, sf_dir), i.cases(spark, sf_dir), KINDS)


def _results(spark, sf_dir):
    each = _checked(spark, sf_dir).select("case", "run", F.explode("results").alias("r"))
    return each.select("case", "run", "r.key", "r.ok")


def _intervals(spark, sf_dir):
    counted = i.graded(spark, sf_dir).groupBy("suite").agg(F.count("*").alias("n"), F.count_if("passed").alias("pass"))
    w = F.col("w")
    return counted.withColumn("w", wilson_interval(F.col("pass"), F.col("n"))).select(
        "suite", "n", "pass", *[F.round(w[c], 9).alias(c) for c in ("rate", "low", "high")]
    )


def _rounded(df, *columns):
    return df.select(*[F.round(c, 9).alias(c) if c in columns else F.col(c) for c in df.columns])


def _halves(spark, sf_dir):
    graded = i.graded(spark, sf_dir)
    return (ev.pass_gate(graded.filter(f"n_chars {sign} 1000")) for sign in (">=", "<"))


def _compared(spark, sf_dir):
    current, baseline = _halves(spark, sf_dir)
    return _rounded(ev.regression_compare(current, baseline), "baseline_rate", "current_rate")


def _saved_baseline(spark, sf_dir):
    folder = scratch(spark)
    save_baseline(ev.pass_gate(i.graded(spark, sf_dir)), folder)
    return spark.read.parquet(folder)


def _split(spark, sf_dir):
    return _rounded(ev.split_compare(i.graded(spark, sf_dir), ["case"]), "baseline_rate", "current_rate")


def _judged(spark, sf_dir):
    """Every turn against the default rubric."""
    cases = i.cases(spark, sf_dir).select("case", ev.rubric_checks(ev.JUDGE_RUBRIC).alias("checks"))
    got = ev.run_checks(i.answers(spark, sf_dir), cases, ("regex", "notRegex", "maxLines"))
    each = got.select(F.explode("results").alias("r")).select("r.key", "r.ok")
    return each.groupBy("key").agg(F.count("*").alias("answers"), F.count_if("ok").alias("passes"))


def _json(spark, sf_dir):
    text = F.expr("if(event_id % 3 = 0, concat(props, ' x'), if(event_id % 3 = 1, substr(props, 2), props))")
    events = i.table(spark, sf_dir, "events")
    return events.groupBy("event_type", is_json(text).alias("valid")).agg(F.count("*").alias("events"))


def _outputs(spark, sf_dir):
    """Orders as test tool outputs with two count lines, or none."""
    text = F.expr("if(o_orderkey % 5 = 0, 'no tests ran', concat(o_custkey, ' passed, 1 failed\\n', o_orderkey % 100, ' passed in 2s'))")
    orders = i.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return orders.select(
        "o_orderkey",
        rt.extract_counts(F.col("text"), rt.COUNT_PATTERNS["pytest"]).alias("last"),
        rt.extract_counts(F.col("text"), rt.COUNT_PATTERNS["pytest"], how="sum").alias("total"),
    )


SQL_FAILED = (
    'SELECT "case", c.key AS key, count(*) AS failures FROM checked WHERE NOT c.ok GROUP BY 1, 2 '
    "UNION ALL SELECT NULL, c.key, count(*) FROM checked WHERE NOT c.ok GROUP BY 2"
)


def sql_gate(relation: str, keys: str = "") -> str:
    w = i.sql_wilson("pass", "n")
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return (
        f"SELECT {lead}n, pass, round({w['rate']}, 9) AS rate, round({w['low']}, 9) AS low, round({w['high']}, 9) AS high, CAST(0.8 AS DOUBLE) AS threshold, "
        f"CASE WHEN {w['rate']} >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS gate FROM (SELECT {lead}count(*) AS n, count(*) FILTER (passed) AS pass FROM {relation} {group})"
    )


def sql_compare(now: str, then: str) -> str:
    """Compare two relations `suite, n, pass`."""
    a, b = i.sql_wilson("a.pass", "a.n"), i.sql_wilson("b.pass", "b.n")
    worse = f"{a['high']} < {b['low']}"
    return (
        f"SELECT suite, round({b['rate']}, 9) AS baseline_rate, round({a['rate']}, 9) AS current_rate, floor(({b['rate']} - {a['rate']}) * 1000 + 0.5) / 10 AS drop_pts, "
        f"{worse} AS significant, CASE WHEN {worse} THEN 'REGRESSION' ELSE 'no significant change' END AS verdict FROM ({now}) a JOIN ({then}) b USING (suite)"
    )


SQL_PASSES = "SELECT suite, count(*) AS n, count(*) FILTER (passed) AS pass FROM {0} GROUP BY 1"
SQL_VERDICT = r"regexp_matches(text, '(?m)^\s*\**VERDICT\**:?\s*(PASS|FAIL|BLOCKED)')"
SQL_COMMAND = r"regexp_matches(text, '\bnode |\bnpm |\bgit |\bpytest\b')"

def _ratchet_runs(spark, sf_dir):
    """The same history in four spans of time, each judged against the baselines that those before it left behind."""
    history, folder = stored(i.order_history(spark, sf_dir)), scratch(spark)
    day = F.unix_date("run_ts")
    first, last = history.agg(F.min(day), F.max(day)).first()
    span = F.floor(4 * (day - first) / (last - first + 1)) if first is not None else F.lit(0)
    judged = [rt.ratchet_runs(history.filter(span == k), folder) for k in range(4)]
    return reduce(DataFrame.unionByName, judged)


SQL_RATCHET = (
    f"WITH {i.SQL_HISTORY}, based AS (SELECT *, max(value) FILTER (NOT failed) OVER (PARTITION BY suite ORDER BY run_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline FROM history), "
    "ruled AS (SELECT *, CASE WHEN failed THEN 'failing step' WHEN value < baseline AND uncounted = 0 THEN 'ratchet' END AS reason FROM based) "
    "SELECT *, CASE WHEN reason IS NULL THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE WHEN reason IS NULL THEN greatest(baseline, value) ELSE baseline END AS baseline_after FROM ruled"
)

QUERIES = {
    "run_checks": (_results, f'WITH {i.SQL_CHECKED} SELECT "case", run, c.key AS key, c.ok AS ok FROM checked'),
    "score_answers": (
        lambda s, d: _scored(s, d).select("case", "run", "passed"),
        f"WITH {i.SQL_CHECKED} SELECT * FROM scored",
    ),
    "per_case": (
        lambda s, d: _rounded(ev.per_case(_scored(s, d)), "rate", "consistency"),
        f'WITH {i.SQL_CHECKED} SELECT "case", runs, passes, round(CAST(passes AS DOUBLE) / runs, 9) AS rate, round(CAST(greatest(passes, runs - passes) AS DOUBLE) / runs, 9) AS consistency, '
        'passes > 0 AND passes < runs AS flaky FROM (SELECT "case", count(*) AS runs, count(*) FILTER (passed) AS passes FROM scored GROUP BY 1)',
    ),
    "failed_kinds": (lambda s, d: ev.failed_kinds(_checked(s, d)), f"WITH {i.SQL_CHECKED} {SQL_FAILED}"),
    "wilson_interval": (
        _intervals,
        f"WITH {i.SQL_GRADED} SELECT suite, n, pass, rate, low, high FROM ({sql_gate('graded', 'suite')})",
    ),
    "pass_gate": (
        lambda s, d: _rounded(ev.pass_gate(_scored(s, d)), "rate", "low", "high"),
        f"WITH {i.SQL_CHECKED} {sql_gate('scored')}",
    ),
    "regression_compare": (
        _compared,
        f"WITH {i.SQL_GRADED} "
        + sql_compare(SQL_PASSES.format("(SELECT * FROM graded WHERE n_chars >= 1000)"), SQL_PASSES.format("(SELECT * FROM graded WHERE n_chars < 1000)")),
    ),
    "split_compare": (
        _split,
        f'WITH {i.SQL_GRADED}, placed AS (SELECT *, row_number() OVER (PARTITION BY suite ORDER BY "case") - 1 AS r, count(*) OVER (PARTITION BY suite) AS size FROM graded) '
        + sql_compare(SQL_PASSES.format("(SELECT * FROM placed WHERE r >= size // 2)"), SQL_PASSES.format("(SELECT * FROM placed WHERE r < size // 2)")),
    ),
    "judge_rubric": (
        _judged,
        "SELECT c.key AS key, count(*) AS answers, count(*) FILTER (c.ok) AS passes FROM (SELECT unnest(["
        f"{{'key': 'verdict-line', 'ok': {SQL_VERDICT}}}, {{'key': 'max-15-lines', 'ok': len(list_filter(string_split_regex(text, '\\r?\\n'), lambda x: trim(x) <> '')) <= 15}}, "
        f"{{'key': 'revert-line', 'ok': regexp_matches(text, '(?i)revert')}}, {{'key': 'names-a-command', 'ok': {SQL_COMMAND}}}, "
        "{'key': 'no-email', 'ok': NOT regexp_matches(text, '[\\w.+-]+@[\\w-]+\\.[\\w.-]+')}]) AS c FROM conversations) GROUP BY 1",
    ),
    "is_json": (
        _json,
        "SELECT event_type, json_valid(CASE event_id % 3 WHEN 0 THEN props || ' x' WHEN 1 THEN substr(props, 2) ELSE props END) AS valid, count(*) AS events FROM events GROUP BY 1, 2",
    ),
    "save_baseline": (_saved_baseline, f"WITH {i.SQL_GRADED} {SQL_PASSES.format('graded')}"),
    "extract_counts": (
        _outputs,
        "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 100 END AS last, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey + o_orderkey % 100 END AS total FROM orders",
    ),
    "metric_ratchet": (lambda s, d: rt.metric_ratchet(i.order_history(s, d)), SQL_RATCHET),
    "ratchet_runs": (_ratchet_runs, SQL_RATCHET),
}
