import random

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from sievelight.operators import evaluation as ev

RUBRIC = [
    ("verdict", "regex", "^RESULT: (YES|NO)$", "m"),
    ("short", "maxLines", "4", None),
    ("undo", "regex", "^undo:", "mi"),
    ("no-mail", "notRegex", r"\b[\w.+-]+@[\w-]+\.[\w.-]+", None),
]
GOOD = "RESULT: YES\nlooked at it\nUndo: put it back"
BAD = ["fine\nundo: x", "RESULT: YES\n1\n2\n3\n4\nundo: x", "RESULT: NO\nundo: x\nme@mail.test", "RESULT: NO\nseen"]


def cases(spark, n=10):
    ids = spark.range(1, n + 1).select(F.concat(F.lit("c"), "id").alias("case"))
    return ids.withColumn("checks", ev.rubric_checks(RUBRIC))


def answers(spark, failing, n=10, runs=5):
    rows, bad = [], 0
    for i in range(n * runs):
        fails = i in failing
        rows.append((f"c{i // runs + 1}", i % runs + 1, BAD[bad % 4] if fails else GOOD))
        bad += fails
    return spark.createDataFrame(rows, "case string, run int, text string")


def scored(spark, failing):
    return ev.score_answers(answers(spark, failing), cases(spark))


def gate(spark, failing, suite="s"):
    return ev.pass_gate(scored(spark, failing)).withColumn("suite", F.lit(suite))


def test_gate_and_regression(spark):
    rng = random.Random(1)
    pick = lambda k: set(rng.sample(range(50), k))
    base, same, worse = gate(spark, pick(2)), gate(spark, pick(4)), gate(spark, pick(17))
    assert rows_of(base, "n", "pass", "gate") == [(50, 48, "PASS")]
    assert rows_of(same, "pass", "gate") == [(46, "PASS")]
    assert rows_of(worse, "pass", "gate") == [(33, "FAIL")]
    assert rows_of(ev.regression_compare(same, base), "significant", "drop_pts") == [(False, 4.0)]
    assert rows_of(ev.regression_compare(worse, base), "verdict", "drop_pts") == [("REGRESSION", 30.0)]


def test_per_case_and_failed_kinds(spark):
    got = scored(spark, {0, 5, 6, 7, 8, 9})
    rows = {r["case"]: r for r in ev.per_case(got).collect()}
    assert (rows["c1"]["passes"], rows["c1"]["flaky"], rows["c1"]["consistency"]) == (4, True, 0.8)
    assert (rows["c2"]["passes"], rows["c2"]["flaky"], rows["c2"]["consistency"]) == (0, False, 1.0)
    overall = ev.failed_kinds(got).filter("case is null")
    assert rows_of(overall, "key", "failures") == [("no-mail", 1), ("short", 2), ("undo", 1), ("verdict", 2)]
    assert ev.failed_kinds(scored(spark, set())).count() == 0


@pytest.mark.parametrize(
    "check, text, ok",
    [
        (("a", "contains", "ab", None), "xabx", True),
        (("a", "notContains", "ab", None), "xabx", False),
        (("a", "json", None, None), '{"a":1}', True),
        (("a", "json", None, None), '{"a":1} x', False),
        (("a", "minLines", "2", None), "a\n\nb", True),
        (("a", "maxLines", "1", None), "a\nb", False),
        (("a", "regex", r"\bof\b", None), "éof", True),
        (("a", "regex", "^b", None), "a\nb", False),
        (("a", "notRegex", "B", "i"), "abc", False),
        ((None, "contains", "z", None), None, False),
    ],
)
def test_check_kinds(spark, check, text, ok):
    one = spark.createDataFrame([("c", 1, text)], "case string, run int, text string")
    case = spark.createDataFrame([("c",)], "case string").withColumn("checks", ev.rubric_checks([check]))
    got = ev.score_answers(one, case).first()
    assert got["passed"] is ok
    assert got["results"][0]["key"] == (check[0] or check[1])


def test_unknown_kind_is_an_error_and_unknown_case_is_ignored(spark):
    one = spark.createDataFrame([("c", 1, "x"), ("other", 1, "x")], "case string, run int, text string")
    bad = spark.createDataFrame([("c",)], "case string").withColumn("checks", ev.rubric_checks([("a", "nope", "x", None)]))
    with pytest.raises(Exception, match="unknown check kind"):
        ev.score_answers(one, bad).collect()
    fine = spark.createDataFrame([("c",)], "case string").withColumn("checks", ev.rubric_checks(RUBRIC[:1]))
    assert ev.score_answers(one, fine, kinds=("regex",)).count() == 1


def test_default_rubric(spark):
    rows = ev.judge_rubric(spark).count()
    assert rows == 5
    texts = [
        "VERDICT: PASS\nran: pytest -q\nRevert: git restore x",
        "All fine.\nran: pytest\nrevert: x",
        "VERDICT: PASS\n" + "line\n" * 16 + "node x\nrevert: y",
        "**VERDICT**: FAIL\nnode x\nmail me@mail.test\nrevert y",
        "VERDICT: PASS\nchanged\nRevert: it",
    ]
    data = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "case string, run int, text string")
    case = spark.createDataFrame([("c",)], "case string").withColumn("checks", ev.rubric_checks(ev.JUDGE_RUBRIC))
    got = ev.score_answers(data, case, kinds=("regex", "notRegex", "maxLines")).orderBy("run").collect()
    assert [r["passed"] for r in got] == [True, False, False, False, False]


def test_split_gives_the_odd_row_to_the_newer_half(spark):
    rows = [("a", i, i > 2) for i in range(5)] + [("b", 1, True)]
    df = spark.createDataFrame(rows, "suite string, t int, passed boolean").repartition(3)
    got = {r["suite"]: r for r in ev.split_compare(df, ["t"]).collect()}
    assert (got["a"]["baseline_rate"], round(got["a"]["current_rate"], 4)) == (0.0, 0.6667)
    assert got["a"]["drop_pts"] == -66.7
    assert (got["b"]["baseline_rate"], got["b"]["current_rate"]) == (0.0, 1.0)
