"""The pipeline against brute force, stage by stage on what the stage before kept."""

import os
import sys

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline  # noqa: E402
from test_pairs_and_repeats import components, removed  # noqa: E402

from sievelight.llm.decontam import overlap, question_and_answer, tokens  # noqa: E402
from sievelight.llm.pieces import library  # noqa: E402
from sievelight.llm.toxicity import ToxicityModel, fit_toxicity, score_text, toxicity_scores  # noqa: E402
from sievelight.plans.session import stored  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], SF_DIR)))
    for df in kept[:-1]:
        assert df.columns == corpus_pipeline.COLUMNS
    before, *after = [texts(df) for df in kept[:-1]]
    clean, single, cut, tested = after

    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = fit_toxicity(docs, labels.filter(~corpus_pipeline.held_out()))
    assert clean == {i: t for i, t in before.items() if score_text(t, model)[0] < 0.3}

    assert single == {i: t for i, t in clean.items() if components(list(clean.items()))[i][1] == i}

    counts = removed(list(single.items()), 100)
    assert set(cut) == {i for i, (size, gone, *_) in counts.items() if gone == 0 or gone < size}
    assert all(len(cut[i].encode("utf-8", "replace")) == counts[i][0] - counts[i][1] for i in cut if "�" not in cut[i])

    items = [question_and_answer(r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    leaks = {i for i, t in cut.items() for words in [tokens(t)] if any(overlap(q, words) == 1 and overlap(a, words) == 1 for q, a in items)}
    assert leaks.isdisjoint(tested) and tested.items() <= cut.items() and len(cut) - len(tested) <= len(leaks) + 2

    encode = library(corpus_pipeline.PIECE_MODEL).encode
    last = {r["doc_id"]: r for r in kept[-1].collect()}
    assert set(last) == set(tested)
    assert all(last[i]["whole"] and last[i]["n_tokens"] == len(encode(t)) for i, t in tested.items())

    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(map(tuple, kept[-1].collect()))


def test_nulls_and_empty_texts_pass(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR))
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 2, 3]
    for _, stage in corpus_pipeline.STAGES:
        empty = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
        assert stage(spark, empty, SF_DIR).collect() == []


def test_kept_text_goes_to_python_once(spark):
    """A text that is kept is not sent a second time to be scored."""
    docs = spark.createDataFrame([(1, "you vile thing"), (2, None), (3, "")], "doc_id long, text string")
    model = ToxicityModel(-2.0, {"vile": 4.0})
    kept = toxicity_scores(docs, model, keep=("doc_id", "text"))
    assert "_text" not in kept._jdf.queryExecution().toString() and kept.columns == ["doc_id", "text", "score", "offending"]
    got = {r["doc_id"]: r for r in kept.collect()}
    alone = {r["doc_id"]: r for r in toxicity_scores(docs, model).collect()}
    assert {i: r["text"] for i, r in got.items()} == {1: "you vile thing", 2: None, 3: ""}
    assert all((got[i]["score"], got[i]["offending"]) == (alone[i]["score"], alone[i]["offending"]) for i in got) and got[1]["score"] > 0.5
