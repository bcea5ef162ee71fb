"""Jaccard components and repeated byte strings against brute force."""

import hashlib
import os
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from helpers_llm import documents, hostile_rows, prose  # noqa: E402

from sievelight.llm import hashing as H  # noqa: E402
from sievelight.llm import jaccard as J  # noqa: E402
from sievelight.llm.graph import connected_components  # noqa: E402
from sievelight.llm.jaccard import jaccard_components  # noqa: E402
from sievelight.llm.suffixes import suffix_dedup  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def components(rows):
    sets = {i: shingles(t) for i, t in rows}
    at = {i: i for i in sets}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                at[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies():
    """A group in which many pairs are just above or below the threshold, so links chain."""
    base = prose(7, 60).split()
    rows = []
    for k in range(40):
        words = list(base)
        for j in range(k % 4):
            words[(k * 7 + j * 13) % 60] = f"edit{(k + j) % 5}"
        rows.append((1000 + k, " ".join(words)))
    return rows


@pytest.mark.parametrize("rows", [hostile_rows(), near_copies()], ids=["hostile", "near"])
def test_components_equal_brute_force(spark, rows):
    got = jaccard_components(documents(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(rows)


def test_threshold_is_met_exactly(spark):
    # 9 shingles each, 8 shared, 10 in all: 80 of 100. One more word apart: 8 of 11.
    words = [f"w{k}" for k in range(14)]
    rows = [(1, " ".join(words[:13])), (2, " ".join([*words[:12], "z"])), (3, " ".join(["y", *words[1:12], "z"]))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(documents(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in components(rows).items()} == {1: 1, 2: 1, 3: 1}


def test_no_documents(spark):
    empty = documents(spark, [])
    assert jaccard_components(empty).collect() == []
    assert suffix_dedup(empty).collect() == []


def test_repeated_rows_keep_their_rows(spark):
    rows = [(1, prose(1, 30)), (1, prose(1, 30)), (2, prose(1, 30)), (2, None)]
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard_components(documents(spark, rows)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (2, 2)]


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    texts = [b"One two\x0bthree", b"", b" \t ", "n\u00ef two".encode(), b"x" * 300 + b" two " + b"y" * 255, b"two" * 200, b"x" * 300, b"a\x00b \x00"]
    words = [w for t in texts for w in t.lower().split()]
    whole, offsets = H.word_lists(texts, lower=True)
    assert offsets.tolist() == [0, 3, 3, 3, 5, 8, 9, 10, 12]
    assert len(set(whole.tolist())) == len(set(words)) == len(set(zip(words, whole.tolist(), strict=True)))
    for block in (H.LONG_WORD, 300, 700):
        monkeypatch.setattr(H, "WORD_BLOCK", block)
        assert H.word_lists(texts, lower=True)[0].tolist() == whole.tolist()


def test_documents_of_their_own_leave_after_a_quarter_of_their_ngrams(spark):
    passage = prose(70, 12)
    rows = [(k, prose(200 + k, 150) + " " + passage) for k in range(4)] + [(10, prose(80, 60)), (11, prose(80, 59) + " end")]
    docs = documents(spark, rows).select(F.col("doc_id").alias("doc"), "text")
    facts = J._facts(docs, 5, 80, J.np.zeros(1 << J.ORDER_BITS, J.np.int64))
    placed = facts.select("doc", "size", "shares", F.posexplode("prefix").alias("pos", "h")).withColumn("comp", F.col("doc")).withColumn("n_rows", F.lit(2))
    read = []

    def seen(rows, docs, n, share, common=J._common):
        read.append({r["doc"] for r in rows.select("doc").distinct().collect()})
        return common(rows, docs, n, share)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(J, "_common", seen)
        left = J._possible(placed, docs, 80, 5).select("doc").distinct().collect()
    assert read == [{0, 1, 2, 3, 10, 11}, {10, 11}] and {r["doc"] for r in left} == {10, 11}


def test_long_chains_connect(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 102), (102, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 102: 100}


def test_few_links_need_no_rounds(spark, monkeypatch):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(90, 70), (80, 90), (5, None), (6, 6)], "a long, b long")
    want = {**{k: 0 for k in range(41)}, 70: 70, 80: 70, 90: 70}
    for task_links in (6, 20):
        assert {r["node"]: r["component"] for r in connected_components(links, task_links=task_links).collect()} == want
    monkeypatch.setattr("sievelight.llm.graph._star", lambda *_: 1 / 0)
    assert {r["node"]: r["component"] for r in connected_components(links).collect()} == want


def test_many_keys_are_looked_up_in_a_bitmap(spark, monkeypatch):
    """The rows are those of a broadcast of the keys, and what is broadcast has a bound that the keys don't move."""
    draw = J.np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 6000)
    rows = spark.createDataFrame([(k, int(h)) for k, h in enumerate(draw)], "doc long, h long")
    keys = rows.filter("doc % 2 = 0").select("h")
    want = {r["doc"] for r in rows.filter("doc % 2 = 0").collect()}
    assert {r["doc"] for r in J._among(rows, keys).collect()} == want
    monkeypatch.setattr(J, "is_small", lambda _, most=500: most > 500)
    met = J._among(rows, keys)
    assert sorted(met.columns) == ["doc", "h"] and {r["doc"] for r in met.collect()} == want
    monkeypatch.setattr(J, "BITMAP_ROW_BITS", 1)
    assert sorted(r["doc"] for r in J._among(rows, keys).collect()) == sorted(want)


def test_components_with_a_bitmap_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "is_small", lambda _, most=500: most > 500)
    monkeypatch.setattr(J, "BITMAP_ROW_BITS", 2)
    rows = [(k, prose(300 + k // 4, 40) + " " + prose(400 + k, k % 3 + 1)) for k in range(32)] + [(90, None), (91, prose(1, 3))]
    got = jaccard_components(documents(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(rows)


def test_bitmap_comes_before_the_join_with_the_keys(spark, monkeypatch):
    """Rows without a set bit must not reach the shuffle, so the keys are joined above the bits in the optimized plan."""
    rows = spark.createDataFrame([(k, k * 7919) for k in range(6000)], "doc long, h long")
    monkeypatch.setattr(J, "is_small", lambda _, most=500: most > 500)
    plan = J._among(rows, rows.filter("doc % 2 = 0").select("h"))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 2 and "_row" in joins[1] and "_row" not in joins[0]


def test_documents_without_partners_leave_before_any_pair_is_made(spark, monkeypatch):
    """Each shares a passage with all others, so they would meet; copies of a set and rows that repeat an id don't count as partners."""
    monkeypatch.setattr(J, "ORDER_BITS", 1)  # as in a large table, classes tell little of how rare an n-gram is
    passage = prose(70, 30)
    rows = [(k, prose(200 + k, 150) + " " + passage) for k in range(6)] + [(20, prose(203, 150) + " " + passage)]
    rows += [(10, prose(80, 60)), (11, prose(80, 59) + " end"), (11, prose(80, 59) + " end"), (12, None), (12, prose(5, 3))]
    met = []

    def seen(rows, group, first, percent, to_pivots=J._to_pivots):
        met.append({r["doc"] for r in rows.select("doc").distinct().collect()})
        return to_pivots(rows, group, first, percent)

    monkeypatch.setattr(J, "_to_pivots", seen)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(documents(spark, rows)).collect()}
    assert met[0] == {10, 11} and got[11] == 10 and got[20] == 3 and got[5] == 5


def removed(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        mask = bytearray(len(data))
        for p in range(len(data) - window + 1):
            w = data[p : p + window]
            if w in seen:
                mask[p : p + window] = b"\1" * window
            seen.add(w)
        kept = bytes(b for b, m in zip(data, mask, strict=True) if not m)
        spans = sum(1 for k in range(len(mask)) if mask[k] and (k == 0 or not mask[k - 1]))
        out[i] = (len(data), sum(mask), spans, hashlib.sha256(kept).hexdigest())
    return out


def passages():
    shared = prose(11, 40)
    rows = [(k, prose(20 + k, 15) + " " + shared[k : len(shared) - 2 * k] + " " + prose(40 + k, 15)) for k in range(6)]
    rows += [(10, prose(50, 30) + "\n" + prose(50, 30)), (11, "q" * 99), (12, "q" * 100), (13, "q" * 101), (14, "é" * 80)]
    return rows + [(15, prose(60, 8)), (16, prose(60, 8)), (17, shared + shared), (18, "xy" * 300)]


@pytest.mark.parametrize("rows", [hostile_rows(), passages()], ids=["hostile", "passages"])
def test_removed_bytes_equal_brute_force(spark, rows):
    got = suffix_dedup(documents(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == removed(rows, 100)


def test_texts_longer_than_a_piece(spark, monkeypatch):
    """Cuts of long texts lose no window."""
    rows = [(1, prose(5, 400)), (2, prose(6, 100) + prose(5, 400)[500:2500] + prose(8, 100)), (3, prose(9, 300))]
    from sievelight.llm import suffixes

    monkeypatch.setattr(suffixes, "PIECE", 1 << 10)
    monkeypatch.setattr(suffixes, "_LOW", suffixes.np.uint64((1 << 10) - 1))
    got = suffix_dedup(documents(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == removed(rows, 100)


def test_kept_text_and_columns(spark):
    rows = [(1, prose(1, 40)), (2, "new words first " + prose(1, 40))]
    got = {r["doc_id"]: r for r in suffix_dedup(documents(spark, rows), with_text=True, keep=("lang",)).collect()}
    assert got[1]["kept"] == rows[0][1] and got[2]["kept"] == "new words first " and got[2]["lang"] is None


def test_rows_without_an_id_take_part(spark):
    """Long texts with null ids: they lose what texts with ids hold, equal ones alike, and come out with null ids."""
    own, other, third = prose(901, 60), prose(902, 60), prose(903, 60)
    rows = [(5, own), (None, "before " + own + " after"), (None, own), (None, other), (None, other), (None, third + " " + third), (None, None), (None, ""), (7, prose(904, 60))]
    got = suffix_dedup(documents(spark, rows), with_text=True).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 7
    kept = sorted((r["n_bytes"], r["kept"]) for r in got if r["doc_id"] is None)
    cut = ("before  " + own + " after").replace(" " + own, "")
    want = [(0, ""), (0, ""), (len(own), ""), (len(other), other), (len(other), other)]
    assert all(w in kept for w in want) and kept.count((len(other), other)) == 2
    assert [n for n, t in kept if n == len(own) + 13 and "before" in t and len(t) <= len(cut)] == [len(own) + 13]
    twice = next(t for n, t in kept if n == 2 * len(third) + 1)
    assert len(twice) == len(third) + 1 and twice.startswith(third)
    assert {r["doc_id"]: r["n_removed"] for r in got if r["doc_id"] is not None} == {5: 0, 7: 0}
