import random

from helpers import rows_of
from pyspark.sql import functions as F

from sievelight.operators.cleaning import bad_email
from sievelight.operators.textaudit import jargon
from sievelight.plans import session, sizing, skew
from sievelight.plans.blocks import global_rank
from sievelight.plans.spread import spread
from sievelight.streaming import append_findings
from workload.registry import ORACLES, QUERIES


def test_stream_findings_are_appended_once(spark, tmp_path):
    rows, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    shape = "source string, n long, email string, line_no long, line string"

    def run(batch):
        spark.createDataFrame(batch, shape).write.mode("append").json(str(rows))
        stream = spark.readStream.schema(shape).json(str(rows))
        append_findings(bad_email(stream).unionByName(jargon(stream)), out, state).awaitTermination()

    run([("a", 1, "x", 1, "we leverage it"), ("a", 2, "a@b.test", 2, "fine")])
    run([("b", 1, "y", 1, "fine")])
    assert rows_of(spark.read.parquet(out), "source", "kind", "row") == [("a", "bad-email", 1), ("a", "jargon", 1), ("b", "bad-email", 1)]


def test_global_rank_over_many_partitions(spark):
    values = random.Random(4).sample(range(10_000), 2_000)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(13)
    got = global_rank(df, ["v"]).orderBy("v").collect()
    assert [(r["v"], r["rank"]) for r in got] == list(zip(sorted(values), range(2_000)))


def test_lookup_joins_hot_and_cold_keys_whole(spark):
    rng = random.Random(6)
    keys = [0 if rng.random() < 0.4 else rng.randrange(1, 3_000) for _ in range(4_000)]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k int")
    facts = spark.createDataFrame([(k, f"f{k}") for k in range(0, 3_000, 2)], "k int, fact string")
    got = skew.lookup(rows, facts, ["k"])
    assert rows_of(got, "i", "k", "fact") == [(i, k, f"f{k}") for i, k in enumerate(keys) if k % 2 == 0]


def test_broadcast_only_below_the_limit(spark):
    hint = lambda df: "Broadcast" in df._jdf.queryExecution().analyzed().toString() or "broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert hint(sizing.broadcast_if_small(spark.range(10), rows=10))
    assert not hint(sizing.broadcast_if_small(spark.range(11), rows=10))


def test_spread_leaves_wide_inputs_alone(spark):
    assert spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == 4
    wide = spark.range(100, numPartitions=9)
    assert spread(wide) is wide


def test_checkpoint_folder_of_the_session_is_kept(spark, tmp_path):
    first = session.ensure_checkpoint_dir(spark)
    assert session.ensure_checkpoint_dir(spark) == first
    assert rows_of(session.stored(spark.range(3)), "id") == [(0,), (1,), (2,)]


def test_ranking_reaches_each_query_through_a_partial_limit(spark):
    plan = QUERIES["bm25_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_counts_of_a_window_are_computed_per_bucket(spark):
    plan = QUERIES["rate_burst"](spark, "/root/testdata/sf0.001")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in text and "bucket" in text
    assert plan.filter(F.col("events") < 4).count() == 0
