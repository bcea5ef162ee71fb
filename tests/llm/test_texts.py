"""Quality, toxicity, decontamination and pieces."""

import os
import random
import re
import sys
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from helpers_llm import documents, hostile_rows, prose  # noqa: E402

from sievelight.llm import pieces as P  # noqa: E402
from sievelight.llm.hashing import StretchHasher  # noqa: E402
from sievelight.llm.decontam import _batch_hits, benchmark_hits, build_index, contaminated, overlap, tokens  # noqa: E402
from sievelight.llm.quality import ASSUMED, fit_label_model, quality_verdicts  # noqa: E402
from sievelight.llm.toxicity import fit_toxicity, score_text, toxicity_scores  # noqa: E402

SF_DIR = "/root/testdata/sf0.01"
MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    marked = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_quality_counts_equal_brute_force(spark):
    rows = [(i, t) for i, t in hostile_rows() if len(t or "") < 9_000]
    rows += [(500, "l one\nl one\n\n \nl two\nl one"), (501, "# a | b <c> 50% $5 & *x*"), (502, " ".join(["w x y z a b c d"] * 4))]
    got = quality_verdicts(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = counts(dict(rows)[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_of_no_documents(spark):
    assert quality_verdicts(documents(spark, [])).collect() == []


def test_label_model_finds_accuracies():
    """Votes drawn from known tables: the posterior tells the classes apart, and a single fault is enough."""
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.85
    tables = ASSUMED
    votes = np.array([[rng.choice([-1, 0, 1], p=tables[0 if g else 1]) for _ in range(6)] for g in good])
    patterns, at, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior = fit_label_model(patterns, n.astype(float))[at.ravel()]
    assert ((posterior >= 0.5) == good).mean() > 0.93
    assert len(fit_label_model(np.empty((0, 6), int), np.empty(0))) == 0


def test_quality_agrees_with_labels(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "quality")
    judged = quality_verdicts(spark.read.parquet(f"{SF_DIR}/documents.parquet")).filter("NOT base_failed").join(labels, "doc_id").toPandas()
    assert judged.kept[judged.quality == 1].mean() > 0.98
    assert judged.kept[judged.quality == 0].mean() < 0.2


def learn(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    rows = labels.collect()
    held = [r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    return docs, labels, held, fit_toxicity(docs, labels.filter(~labels.doc_id.isin(held)))


def test_toxicity_on_held_out_documents(spark):
    docs, labels, held, model = learn(spark)
    got = toxicity_scores(docs, model).join(labels, "doc_id").filter(labels.doc_id.isin(held)).toPandas()
    ranks, toxic = got.score.rank(), got.toxic == 1
    auc = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / toxic.sum() / (~toxic).sum()
    assert auc > 0.85
    assert ((got.score >= 0.3) & ~toxic).mean() < 0.03
    # Offending sentences are found, and nothing but sentences.
    text = "All is well here. You are an idiot and a moron. The end."
    score, found = score_text(text, model)
    assert score >= 0.3 and [text[a:b].strip() for a, b, _ in found] == ["You are an idiot and a moron"]
    hostile = toxicity_scores(documents(spark, hostile_rows()), model).collect()
    assert len(hostile) == len(hostile_rows()) and all(0 <= r["score"] <= 1 for r in hostile)
    assert {r["score"] for r in hostile if r["doc_id"] in (25, 28, 31)} == {0.0}


def test_toxicity_is_noisy_or():
    model = P and __import__("sievelight.llm.toxicity", fromlist=["ToxicityModel"]).ToxicityModel(-2.0, {"bad": 3.0, "good": -1.0})
    p = [1 / (1 + np.exp(2.0)), 1 / (1 + np.exp(-1.0)), 1 / (1 + np.exp(0.0))]
    score, found = score_text("Plain words. Bad, bad words! Bad good\n123", model)
    assert score == pytest.approx(1 - np.prod([1 - x for x in p])) and len(found) == 2


def test_a_long_clean_text_is_clean(spark):
    """100,000 sentences without evidence score no more than a few, for the fitted and the default model; one insult still counts."""
    from sievelight.llm.toxicity import HIGHEST_BIAS, PLAIN, ToxicityModel

    fitted = learn(spark)[3]
    mild = ToxicityModel(HIGHEST_BIAS, {"xqz": -0.3, "vbn": 0.1})
    for model in (fitted, ToxicityModel(), mild):
        for sentence in ("xqz vbn wrt. ", "wrt. ", "vbn!\n"):
            score, found = score_text(sentence * 100_000, model)
            assert found == [] and score == pytest.approx(score_text("wrt." * PLAIN, model)[0]) and score < 0.2
    score, found = score_text("xqz vbn. " * 50_000 + "You are an idiot and a moron." + " xqz vbn." * 50_000, fitted)
    assert score >= 0.3 and len(found) == 1


def test_toxicity_without_labels(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        assert all(r["score"] < 0.1 for r in toxicity_scores(docs, fit_toxicity(docs, known)).collect())
    assert toxicity_scores(documents(spark, []), fit_toxicity(docs, labels)).collect() == []


def brute_hits(docs, items, share=0.6):
    """Every passage scored against every item, without an index."""
    index = build_index(items, share)
    by_item = [dict(zip(index.items[a:b].tolist(), index.impacts[a:b].tolist(), strict=True)) for a, b in zip(index.starts, index.starts[1:], strict=False)]
    out = {}
    for doc, text in docs:
        words = tokens(text or "")
        for start in range(0, max(len(words) - index.longest, 1), index.longest):
            read = words[start : start + 2 * index.longest]
            for k, item in enumerate(index.ids):
                score = sum(by_item[index.terms[w]].get(k, 0) for w in set(read) if w in index.terms)
                if score >= index.needed[k] - 1e-9:
                    q, a = (overlap(part, read) for part in index.parts[k])
                    out[doc, item] = max(out.get((doc, item), (0, 0)), (round(q + a, 9), round(score, 9)))
    return out


def test_hits_equal_brute_force(spark):
    items = [(k, prose(100 + k, 12 + k) + ". " + prose(200 + k, 5) + ".") for k in range(70)] + [(90, ""), (91, None), (92, "yes"), (0, prose(100, 12) + ". " + prose(200, 5) + ".")]
    docs = hostile_rows() + [(200 + k, prose(300 + k, 3 + 29 * k) + " " + t + " " + prose(400 + k, 80)) for k, (_, t) in enumerate(items[:9])]
    docs += [(300, prose(103, 15)), (301, prose(500, 10) + prose(205, 5)), (302, "Yes!")]
    table = spark.createDataFrame(items, "item_id long, text string")
    for size in (20_000, 40):
        got = benchmark_hits(documents(spark, docs), table, index_items=size)
        found = {(r["doc_id"], r["item_id"]) for r in contaminated(got).collect()}
        assert {(200 + k, k) for k in range(9)} <= found and (301, 5) not in found and (302, 92) in found
    want = brute_hits(docs, [(i, t) for i, t in items[:-1]])
    got = benchmark_hits(documents(spark, docs), table).collect()
    assert {(r["doc_id"], r["item_id"]): (round(r["question_overlap"] + r["answer_overlap"], 9), round(r["score"], 9)) for r in got} == want


def brute_contaminated(docs, items, share=0.6, least=0.6):
    """(document, item) of every retrieved passage that holds both parts, each judged by itself."""
    index = build_index(items, share)
    out = set()
    for doc, text in docs:
        words = tokens(text or "")
        for start in range(0, max(len(words) - index.longest, 1), index.longest):
            read = words[start : start + 2 * index.longest]
            for k, item in enumerate(index.ids):
                held = {w for w in set(read) if w in index.terms}
                score = sum(x for w in held for at in [slice(index.starts[index.terms[w]], index.starts[index.terms[w] + 1])] for x in index.impacts[at][index.items[at] == k])
                if score >= index.needed[k] - 1e-9 and all(overlap(part, read) >= least for part in index.parts[k]):
                    out.add((doc, item))
    return out


def test_every_passage_is_judged(spark):
    """A passage with all of the question and little of the answer doesn't hide one with enough of both."""
    question, answer = [f"q{k}" for k in range(22)], [f"a{k}" for k in range(12)]
    items = [(1, " ".join(question) + ". " + " ".join(answer) + "."), (2, prose(7, 30))]
    filler = prose(8, 120).split()
    one, other = [*question, *answer[:6]], [*question[:15], *answer[:9]]
    docs = [(1, [*one, *filler, *other]), (2, [*other, *filler, *one]), (3, one), (4, other), (5, [*one, *filler, *one])]
    docs = [(i, " ".join(w)) for i, w in docs] + [(6, " ".join(one)), (6, " ".join(other)), *hostile_rows()]
    hits = benchmark_hits(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r for r in contaminated(hits).collect()}
    assert set(got) == brute_contaminated(docs, items) == {(1, 1), (2, 1), (4, 1), (6, 1)}
    assert all(r["question_overlap"] == 0.65 and r["answer_overlap"] == 0.7 for r in got.values())
    assert {r["doc_id"] for r in contaminated(hits, question=0.9, answer=0.3).collect()} == {1, 2, 3, 5, 6}


def test_size_of_an_index_changes_nothing(spark):
    """Texts that hold parts of items, near the threshold too, and items of very different lengths."""
    items = [(k, prose(100 + k, 6 + 3 * (k % 9)) + (" common words here. " if k < 30 else " . ") + prose(200 + k, 5) + ".") for k in range(45)] + [(60, None), (61, ""), (62, "!?")]
    docs = [(1000 + k, prose(900 + k, k) + " " + " ".join(t.split()[: round(len(t.split()) * (0.5 + k % 9 / 16))]) + " " + prose(950 + k, 40)) for k, t in items[:45]]
    table, got = spark.createDataFrame(items, "item_id long, text string"), []
    for size in (20_000, 48, 47, 17, 10):
        rows = benchmark_hits(documents(spark, docs + hostile_rows()), table, index_items=size).collect()
        got.append(sorted((r["doc_id"], r["item_id"], r["score"], r["question_overlap"], r["answer_overlap"], sorted(map(tuple, r["passages"]))) for r in rows))
    assert len(got[0]) > 20 and all(g == got[0] for g in got)


def test_hits_without_items_or_documents(spark):
    table = spark.createDataFrame([], "item_id long, text string")
    assert benchmark_hits(documents(spark, hostile_rows()), table).collect() == []
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert benchmark_hits(documents(spark, []), some).collect() == []


PIECE_ROWS = [
    *hostile_rows(), (900, "  two  blanks\nand\n\nlines "), (901, " "), (902, "▁ own mark ▁x"), (903, "😀 ﬁ ① tab\t\r\nx"), (904, "日本語" * 100 + "a" * 3_000),
]


def test_ids_equal_the_library(spark):
    model, library = P.load_model(MODEL), P.library(MODEL)
    docs = documents(spark, PIECE_ROWS)
    dictionary = P.build_dictionary(docs, model)
    assert P.round_trip(dictionary, model).filter("NOT same").count() == 0
    for hot in (20, 100_000):
        segments = P.encoded_segments(docs, dictionary, model, hot_words=hot)
        got = {r["doc_id"]: r["ids"] for r in P.assembled(segments).collect()}
        for i, text in PIECE_ROWS:
            assert got.get(i, []) == library.encode(text or ""), (hot, i)
    decoded = {r["doc_id"]: r["text"] for r in P.decode_documents(P.assembled(segments), model).collect()}
    assert all(decoded.get(i, "") == (t or "").replace("▁", " ") for i, t in PIECE_ROWS)
    told = {r["doc_id"]: r for r in P.document_digests(docs, segments, model).collect()}
    assert all(told[i]["whole"] and told[i]["n_tokens"] == len(library.encode(t or "")) for i, t in PIECE_ROWS)


def test_whole_is_equality_of_the_decoded_text(spark):
    """Wrong ids of the same width, swapped ids, swapped segments and lost ones are told from the text itself."""
    model = P.load_model(MODEL)
    rows = [(1, "one two three, four"), (2, "abc \u00e9\u4e2d"), (3, "plain words here"), (4, "zq \u4e2d wv"), (5, "kept as it is"), (6, ""), (7, None), (8, "\u2581a")]
    docs = documents(spark, rows)
    table = P.build_dictionary(docs, model)
    segments = [(r["doc_id"], r["segment"], list(r["ids"])) for r in P.encoded_segments(docs, table, model, hot_words=3).collect()]

    def whole(rows):
        table = spark.createDataFrame(rows, "doc_id long, segment long, ids array<int>")
        return {r["doc_id"]: r["whole"] for r in P.document_digests(docs, table, model).collect()}

    assert all(whole(segments).values())
    width = {k: len(p) for k, p, _ in model.pieces}
    other = {k: next(j for j, n in width.items() if n == width[k] and j != k) for _, _, ids in segments for k in ids if k in width}
    first = min(s for s in segments if s[0] == 1)
    wrong = [(d, s, [other[ids[0]], *ids[1:]]) if (d, s, ids) == first else (d, s, ids) for d, s, ids in segments]
    assert [i for i, w in whole(wrong).items() if not w] == [1]
    one = {d: [k for e, _, ids in sorted(segments) if e == d for k in ids] for d, *_ in segments}
    swapped = [(d, 0, ids[::-1] if d == 3 else ids) for d, ids in one.items()]
    assert [i for i, w in whole(swapped).items() if not w] == [3]
    size = max(s for d, s, _ in segments if d == 4)
    turned = [(d, size - s if d == 4 else s, ids) for d, s, ids in segments]
    assert size > 0 and [i for i, w in whole(turned).items() if not w] == [4]
    assert [i for i, w in whole([x for x in segments if x[0] != 5]).items() if not w] == [5]
    invalid = [(d, s, [model.byte_ids[0xE4], *ids] if d == 2 and s == 0 else ids) for d, s, ids in segments]
    assert [i for i, w in whole(invalid).items() if not w] == [2]


def test_pieces_of_rows_without_an_id(spark):
    model, library = P.load_model(MODEL), P.library(MODEL)
    rows = [(1, prose(5, 40)), (None, prose(6, 40)), (None, prose(6, 40)), (None, "\u4e2d\U0001f600 x"), (None, None), (None, ""), (2, "one two")]
    docs = documents(spark, rows)
    told = P.document_digests(docs, P.encoded_segments(docs, P.build_dictionary(docs, model), model, hot_words=3), model).collect()
    want = sorted((i or 0, len(library.encode(t or ""))) for i, t in rows)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in told) == want and all(r["whole"] for r in told)


def test_viterbi_equals_the_library_on_a_unigram_model(spark, tmp_path):
    """The same pieces as a unigram model: the library's own Viterbi gives the same ids."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    for k, p in enumerate(proto.pieces):
        if p.type == 1:
            p.score = -4.0 - (k % 977) / 64
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    model, library = P.load_model(str(path)), P.library(str(path))
    rows = [(i, t) for i, t in PIECE_ROWS if i != 904] + [(905, "ab" * 400)]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r["ids"] for r in P.assembled(P.encoded_segments(docs, P.build_dictionary(docs, model), model)).collect()}
    for i, text in rows:
        assert got.get(i, []) == library.encode(text or ""), i


def test_pieces_of_no_documents(spark):
    model, docs = P.load_model(MODEL), documents(spark, [])
    segments = P.encoded_segments(docs, P.build_dictionary(docs, model), model)
    assert P.document_digests(docs, segments, model).collect() == []


def test_search_memory_does_not_grow_with_the_batch():
    """Texts of words that all items hold: every word meets a posting of every item."""
    words = [f"w{k}" for k in range(40)]
    index = build_index([(i, " ".join(words) + f" own{i}") for i in range(200)])
    texts = [" ".join([f"own{k % 200}", *words] * 8) for k in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    found = sum(b.num_rows for b in _batch_hits(iter([batch]), index))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and peak < 300 << 20


def test_hashes_of_parts_make_up_the_hash_of_the_whole(spark):
    """Any cut of a text gives its hash, and changed, moved or lost bytes do not."""
    hasher = StretchHasher()
    data = np.frombuffer(prose(5, 400).encode() + "א中\U0001f600".encode(), np.uint8)
    want = int(hasher(data, np.array([0, len(data)]))[0][0])

    def joined(data, cuts):
        rows = [(k, int(h), int(p)) for k, (h, p) in enumerate(zip(*hasher(data, np.array([0, *cuts, len(data)])), strict=True))]
        parts = F.array_sort(F.collect_list(F.struct("k", "hash", "power")))
        both = spark.createDataFrame(rows, "k long, hash long, power long").select(StretchHasher.joined(parts).alias("b")).first()["b"]
        return (both["h0"] << 31) | both["h1"]

    for cuts in ([], [1], [7, 7, 100], sorted(random.Random(6).sample(range(len(data)), 60))):
        assert joined(data, cuts) == want
    assert joined(data[::-1].copy(), [9]) != want and joined(data[1:], [9]) != want


def test_decoded_texts_are_not_shuffled(spark):
    model = P.load_model(MODEL)
    docs = documents(spark, [(1, "one two"), (2, None)])
    told = P.document_digests(docs, P.encoded_segments(docs, P.build_dictionary(docs, model), model), model)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "hash" in plan and "bytes" not in plan and "sha2" not in plan


def test_pieces_of_short_stretches_list_no_edges(monkeypatch):
    """Merges look up what they ask for; they give what the fold over all edges gives."""
    model = P.load_model(MODEL)
    lattice, draw = P.Lattice(model), random.Random(5)
    words = [P.SPACE + w for w in prose(11, 60).split()] + ["".join(draw.choices("abeinrst\u00e9\u4e2d\U0001f600", k=draw.randint(1, P.SHORT))) for _ in range(200)]
    for word in words:
        spans = P.merged_spans(len(word), lattice.edges(word))
        assert P.merged_pieces(word, lattice.scores) == [word[a:b] for a, b in spans], word
    monkeypatch.setattr(P.Lattice, "edges", lambda *_: 1 / 0)
    assert all(lattice.encode(w) for w in words)


def test_stretches_are_cut_as_bytes():
    model = P.load_model(MODEL)
    texts = [prose(12, 30), None, "", "\u4e2d\U0001f600 x\u00e9", " ", "\x00\x7f\u07ff\uffff"]
    found, first = P.Cutter(model).cut(texts)
    assert all(isinstance(w, bytes) and w for w in found) and len(first) == len(texts) + 1
    for k, text in enumerate(texts):
        want = ((P.SPACE if model.prefix else "") + text.replace(" ", P.SPACE)) if text else ""
        assert b"".join(found[first[k] : first[k + 1]]).decode() == want
    assert not P.is_long(("\u4e2d" * P.LONG).encode()) and P.is_long(b"a" * (P.LONG + 1))
