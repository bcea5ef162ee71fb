"""Bradley-Terry ranking: pairs, weights, quantile bars, and quality on held-out documents."""

import os
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from helpers_llm import documents, hostile_rows  # noqa: E402

from sievelight.llm import ranking as R  # noqa: E402

SF_DIR = "/root/testdata/sf0.01"


def plain_weights(x, ridge=1e-4, steps=200_000, rate=0.5):
    """The same loss by plain gradient steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        slope = x.T @ (1 / (1 + np.exp(x @ w))) / len(x) - ridge * w
        w = w + rate * slope
        if np.abs(slope).max() < 1e-9:
            break
    return w


def test_weights_equal_plain_gradient_steps(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    x[rng.random(400) < 1 / (1 + np.exp(x @ [1.0, -2.0, 0.5]))] *= -1
    empty = R.Ranking(("a", "b", "c"), (0.0,) * 3, (1.0,) * 3, (0.0,) * 3)
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    got = R.fit_ranking(df, empty)
    assert np.allclose(got.weights, plain_weights(x), atol=2e-5)
    assert got.weights == R.fit_ranking(df.repartition(7), empty).weights
    assert R.fit_ranking(df.limit(0), empty) == empty
    # Pairs that a feature tells apart completely have finite weights.
    told = R.fit_ranking(df.select(F.abs("a").alias("a"), "b", "c"), empty)
    assert np.isfinite(told.weights).all() and told.weights[0] > 3


def test_pairs_join_kinds_only(spark):
    rows = [(k, k % 5 != 0) for k in range(300)] + [(None, 1), (7, 0), (8, None), (9, 9), (11, 1), (11, 1)]
    labels = spark.createDataFrame([(k, None if v is None else int(v)) for k, v in rows], "doc_id long, label int")
    got = [(r["winner"], r["loser"]) for r in R.label_pairs(labels, limit=10_000, partners=4).collect()]
    good = {k for k in range(300) if k % 5 and k != 7}
    bad = {k for k in range(300) if k % 5 == 0}
    assert {w for w, _ in got} == good and {x for _, x in got} == bad
    assert len(got) == len(set(got)) <= 4 * 300
    few = R.label_pairs(labels, limit=40, partners=4).collect()
    assert 0 < len(few) <= 160 and len({r["winner"] for r in few} | {r["loser"] for r in few}) <= 40
    assert R.label_pairs(labels.filter("label = 1")).collect() == [] and R.label_pairs(labels.limit(0)).collect() == []


def test_features_of_texts():
    assert R.measures(b"") == R.measures(b" \n\t") == [0.0] * len(R.FEATURES)
    got = dict(zip(R.FEATURES, R.measures("Ab CD, ab!! é\n\nAb CD, ab!! é\n12 #".encode()), strict=True))
    assert got["words"] == pytest.approx(np.log1p(10)) and got["longest_word"] == pytest.approx(np.log1p(4))
    assert got["distinct_words"] == 0.6 and got["top_word"] == 0.2 and got["words_in_capitals"] == 0.2
    assert got["repeated_lines"] == pytest.approx(1 / 3) and got["repeated_pairs"] == pytest.approx(1 - 6 / 9)
    assert got["marked_words"] == 0.2 and got["sentence_marks"] == 0.4
    chars = len("Ab CD, ab!! é\n\nAb CD, ab!! é\n12 #")
    assert got["capitals"] == 6 / chars and got["digits"] == 2 / chars and got["not_ascii"] == 2 / chars
    assert got["marks"] == 7 / chars and got["top_mark"] == 4 / chars


def test_bar_lies_at_the_quantile(spark):
    """Against sorted strengths, for every tenth; where no document lies between two edges the bar is in the middle."""
    values = np.random.default_rng(2).normal(size=1_000) * 3
    values = np.append(values[np.abs(values) > 0.5], [500.0, -500.0, 2.0, 2.0, 2.0])
    one = R.Ranking(("a",), (0.0,), (1.0,), (2.0,))
    df = spark.createDataFrame([(float(v),) for v in values], "a double")
    strengths = np.sort(np.clip(values, -R.WIDEST, R.WIDEST) * 2.0)
    counts = R.strength_counts(df, one)
    assert counts.sum() == len(values)
    for q in np.arange(0, 1.01, 0.1):
        at = R.bar_at(one, counts, q)
        assert abs((strengths < at.bar).mean() - at.rejected) < 1e-9 and q <= at.rejected < q + 0.02
    gap = R.bar_at(one, counts, (values < 0).mean())
    assert abs(gap.bar) < 0.2
    assert R.bar_at(one, counts * 0, 0.5) is one


def test_score_is_a_chance_to_win(spark):
    made = R.Ranking(("a",), (1.0,), (2.0,), (3.0,), bar=-1.5, rejected=0.1)
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 1e9), (None, -1e9)], "doc_id long, a double")
    got = {r["doc_id"]: r for r in R.ranked_documents(df, made).collect()}
    assert got[1]["strength"] == -1.5 and got[1]["score"] == pytest.approx(0.3)
    assert got[2]["score"] == pytest.approx(1 / (1 + np.exp(-(1.5 + np.log(0.3 / 0.7))))) and got[2]["kept"]
    assert 0 <= got[None]["score"] < 0.01 and not got[None]["kept"] and got[3]["score"] > 0.99


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    held = [r["doc_id"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    features = R.document_features(docs)
    ranking = R.fit_quality_ranking(features, labels.filter(~labels.doc_id.isin(held)), label="quality")
    got = R.ranked_documents(features, ranking).join(labels, "doc_id").filter(labels.doc_id.isin(held)).toPandas()
    ranks, good = got.score.rank(), got.quality == 1
    auc = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / good.sum() / (~good).sum()
    assert auc > 0.97 and (got.kept == good).mean() > 0.95
    # A stated quantile puts the bar there.
    half = R.fit_quality_ranking(features, labels, label="quality", quantile=0.5)
    kept = R.ranked_documents(features, half).agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert abs(kept - 0.5) < 0.01


def test_hostile_rows_and_no_labels(spark):
    rows = hostile_rows() + [(None, "no id"), (1, "again"), (1, "again")]
    df = documents(spark, rows)
    for name in ("words", "strength", "bin"):
        df = df.withColumn(name, F.lit("theirs"))
    features = R.document_features(df)
    assert features.columns == ["doc_id", *R.FEATURES] and features.count() == len(rows)
    labels = spark.createDataFrame([(k, j % 2) for j, (k, _) in enumerate(hostile_rows())] + [(None, 1)], "doc_id long, label int")
    got = R.ranked_documents(features, R.fit_quality_ranking(features, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["kept"] == (r["score"] >= 0.3) for r in got)
    for few in (labels.limit(0), labels.filter("label = 1")):
        assert {r["score"] for r in R.ranked_documents(features, R.fit_quality_ranking(features, few)).collect()} == {0.5}
    none = R.document_features(df.limit(0))
    assert R.ranked_documents(none, R.fit_quality_ranking(none, labels)).collect() == []
