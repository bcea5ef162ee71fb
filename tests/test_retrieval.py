import math
import random
import re

import pytest

from sievelight.operators import retrieval as rt

DOCS = {
    "bread.md": "The oven file of this shop. A baker kneads dough, proofs the loaf and scores the crust.",
    "boats.md": "The harbour file of this shop. A sailor reefs the mainsail and trims the jib before the squall.",
    "bees.md": "The hive file of this shop. A keeper lifts the frame, smokes the swarm and tastes the honey.",
    "plain.md": "This shop keeps every file in one place.",
    "empty.md": "",
}
QUERIES = [("q1", "which file kneads the loaf dough"), ("q2", "JIB mainsail squall"), ("q3", "honey swarm file"), ("q4", "xylophone badger"), ("q5", " ")]


def frame(spark, docs):
    return spark.createDataFrame([("c", k, v) for k, v in docs.items()], "source string, doc string, text string")


def brute_force(docs, query, top, k1=1.2, b=0.75):
    toks = {d: re.findall(r"[^\W_]+", t.lower()) for d, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    out = []
    for d, ts in toks.items():
        score = 0
        for t in dict.fromkeys(re.findall(r"[^\W_]+", query.lower())):
            f, df = ts.count(t), sum(t in x for x in toks.values())
            if f:
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(ts) / avg))
        if score > 0:
            out.append((round(-score, 9), d))
    return [(d, round(-s, 3)) for s, d in sorted(out)[:top]]


def ranked(spark, docs, queries, top=5):
    index = rt.build_index(frame(spark, docs))
    qs = spark.createDataFrame(queries, "query string, text string")
    return index, qs, rt.bm25_topk(index, qs, top=top)


def test_each_query_finds_its_file(spark):
    index, qs, got = ranked(spark, DOCS, QUERIES)
    by_query = {}
    for r in got.orderBy("query", "place").collect():
        by_query.setdefault(r["query"], []).append((r["doc"], r["score"]))
    assert by_query == {q: brute_force(DOCS, t, 5) for q, t in QUERIES if brute_force(DOCS, t, 5)}
    assert [by_query[q][0][0] for q in ("q1", "q2", "q3")] == ["bread.md", "boats.md", "bees.md"]
    hits = {(r["query"], r["doc"]): r["hits"] for r in rt.hit_terms(index, qs, got).collect()}
    assert hits["q1", "bread.md"] == ["kneads", "loaf", "dough", "the", "file"]
    expected = spark.createDataFrame([("q1", "bread.md"), ("q2", "bees.md")], "query string, doc string")
    assert {(r["query"], r["place"], r["miss"]) for r in rt.rank_eval(got, expected).collect()} == {("q1", 1, False), ("q2", None, True)}
    stats = rt.index_stats(index, qs).first()
    assert (stats["files"], stats["queries"]) == (5, 5)
    assert stats["terms"] == len({t for x in DOCS.values() for t in re.findall(r"\w+", x.lower())})


def test_the_cap_and_ties(spark):
    docs = {"b": "same words here", "a": "same words here", "c": "same words here", "d": "other"}
    _, _, got = ranked(spark, docs, [("q", "same words")], top=2)
    assert [(r["place"], r["doc"]) for r in got.orderBy("place").collect()] == [(1, "a"), (2, "b")]


@pytest.mark.parametrize("partitions", [1, 7])
def test_random_corpus_equals_brute_force(spark, partitions):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    docs = {f"d{i}": " ".join(rng.choices(words, k=rng.randrange(1, 60))) for i in range(60)}
    queries = [(f"q{i}", " ".join(rng.choices(words, k=4))) for i in range(5)]
    index = rt.build_index(frame(spark, docs).repartition(partitions))
    got = rt.bm25_topk(index, spark.createDataFrame(queries, "query string, text string"), top=10)
    for q, text in queries:
        rows = [(r["doc"], r["score"]) for r in got.filter(f"query = '{q}'").orderBy("place").collect()]
        assert rows == brute_force(docs, text, 10)


@pytest.mark.parametrize("top", [1, 3, 7])
def test_pruned_ranking_of_many_shapes_equals_brute_force(spark, top):
    """Words of all frequencies, one in every document, repeated documents, queries of one word, of common and of unknown ones."""
    rng = random.Random(top)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    docs = {f"d{k:03}": "all " * (1 + k % 3) + " ".join(rng.choices(words, weights, k=rng.randrange(1, 50))) for k in range(150)}
    docs |= {f"e{k:03}": "all w0 w1 w2" for k in range(30)}
    queries = [(f"q{k}", " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for k in range(12)]
    queries += [("all", "all"), ("common", "all w0"), ("tied", "w0 w1 all w2"), ("rare", "w59 all"), ("none", "zz"), ("half", "zz w0 zz"), ("", "")]
    qs = spark.createDataFrame(queries, "query string, text string")
    two = frame(spark, docs).unionByName(frame(spark, {"x": "w0 all", "y": "w59"}).selectExpr("'other' AS source", "doc", "text"))
    got = rt.bm25_topk(rt.build_index(two), qs, top=top, hits=True)
    rows = {}
    for r in got.orderBy("place").collect():
        rows.setdefault((r["source"], r["query"]), []).append((r["doc"], r["score"]))
    want = {("c", q): brute_force(docs, t, top) for q, t in queries} | {("other", q): brute_force({"x": "w0 all", "y": "w59"}, t, top) for q, t in queries}
    assert rows == {k: v for k, v in want.items() if v}
    again = {(r["source"], r["query"], r["doc"]): r["hits"] for r in rt.hit_terms(rt.build_index(two), qs, got.drop("hits")).collect()}
    assert again == {(r["source"], r["query"], r["doc"]): r["hits"] for r in got.collect()}


def test_a_word_in_every_document_is_not_joined(spark):
    """Far fewer documents are scored than meet a query, though every query uses a word that every document has."""
    docs = {f"d{k:04}": f"the {'rare' if k % 400 == 7 else 'some'} w{k % 500} x{k % 90} the" for k in range(2_000)}
    queries = spark.createDataFrame([(f"q{k}", f"the w{k * 9} x{k} rare") for k in range(30)], "query string, text string")
    met = rt.match_postings(rt.build_index(frame(spark, docs)), queries)
    pairs = met.postings.join(met.wanted, ["source", "term"]).select("query", "doc").distinct().count()
    assert pairs == 2_000 * 30
    assert rt.candidates(met, 5).count() < 2_000 * 30 / 10
