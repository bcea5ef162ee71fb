"""The Merkle manifest and fill-in-middle, against plain Python and back again."""

import hashlib
import os
import re
import sys
import zlib

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from helpers_llm import documents, hostile_rows  # noqa: E402

from sievelight.llm import merkle as M  # noqa: E402
from sievelight.llm.middle import Marks, fill_in_middle, from_middle, restore_text, to_middle, unit_ends  # noqa: E402


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(level, paths):
    """Root of (digest, rows below) nodes; each row's siblings go to its path."""
    while len(level) > 1:
        above = []
        for at in range(0, len(level), 3):
            run = level[at : at + 3]
            for k, (_, below) in enumerate(run):
                for row in below:
                    paths[row].append(("".join(h for h, _ in run[:k]), "".join(h for h, _ in run[k + 1 :])))
            above.append((sha("".join(h for h, _ in run)), [row for _, below in run for row in below]))
        level = above
    return level[0]


def brute_manifest(leaves):
    """(subroot, root, path) per row number of (source, id, digest)."""
    paths, subroot, tops = {k: [] for k in range(len(leaves))}, {}, []
    for source in sorted({s for s, _, _ in leaves}, key=lambda s: (s is not None, (s or "").encode())):
        mine = sorted((k for k, row in enumerate(leaves) if row[0] == source), key=lambda k: (leaves[k][1] is not None, leaves[k][1] or 0, leaves[k][2]))
        tops.append(climb([(leaves[k][2], [k]) for k in mine], paths))
        subroot.update({k: tops[-1][0] for k in mine})
    root = climb(tops, paths)[0]
    return [(subroot[k], root, tuple(paths[k])) for k in range(len(leaves))]


@pytest.mark.parametrize(("band", "small"), [(6, 100_000), (2, 0)])
def test_manifest_equals_plain_python(spark, monkeypatch, band, small):
    """Groups of 1, 3, 9, 10, 27, 28 and 200 rows, one without a name, null and repeated ids, whole rows repeated."""
    monkeypatch.setattr(M, "BAND", band)
    monkeypatch.setattr(M, "SMALL", small)
    leaves = []
    for source, size in {None: 10, "a": 1, "é": 3, "b": 9, "-": 27, "=": 28, "": 200, **{f"g{k}": 1 for k in range(9)}}.items():
        leaves += [(source, None if k == 4 else k // 2 if k < 8 else k, sha(f"{source} {k}")) for k in range(size)]
    leaves += leaves[:3]
    df = spark.createDataFrame(leaves, "source string, doc_id long, hex string")
    for name in ("tree", "pos", "row", "steps", "level", "_n"):
        df = df.withColumn(name, F.lit("x"))
    got = M.merkle_proofs(df.withColumn("leaf", F.unhex("hex")), keep=("pos",))
    assert got.columns == ["source", "doc_id", "leaf", "pos", "subroot", "root", "steps"]
    got = got.withColumn("folded", M.fold(F.col("leaf"), F.col("steps"))).withColumn("proof", M.proof_digest(F.col("steps"))).collect()
    assert all(r["folded"] == r["root"] for r in got)
    rows = [(r["source"], r["doc_id"], r["leaf"].hex(), r["subroot"].hex(), r["root"].hex(), r["proof"], tuple((bytes(s[0]).hex(), bytes(s[1]).hex()) for s in r["steps"])) for r in got]
    want = [(*leaf, sub, root, sha("".join(a + b for a, b in path)), path) for leaf, (sub, root, path) in zip(leaves, brute_manifest(leaves), strict=True)]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_manifest_of_one_row_and_of_none(spark):
    df = spark.createDataFrame([("s", 7, sha("x"))], "source string, doc_id long, hex string").withColumn("leaf", F.unhex("hex"))
    (row,) = M.merkle_proofs(df).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["steps"] == []
    assert M.merkle_proofs(df.limit(0)).collect() == []


def test_row_digest_parts_fields(spark):
    """Nulls, empty texts and shifted borders all differ; lengths are bytes."""
    rows = [(None, "ab"), ("", "ab"), ("a", "b"), ("ab", ""), ("é", None)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", F.hex(M.row_digest([F.col("a"), F.col("b")])).alias("h"))
    got = {(r["a"], r["b"]): r["h"].lower() for r in df.collect()}
    assert got == {(a, b): sha(field(a) + field(b)) for a, b in rows} and len(set(got.values())) == 5


def test_a_changed_row_does_not_fold_to_the_root(spark):
    rows = [(None if k % 7 == 0 else f"s{k % 3}", k, "one\ntwo" if k % 2 else "one") for k in range(60)]
    df = spark.createDataFrame(rows, "source string, doc_id long, text string")
    leaf = M.row_digest([F.col("doc_id"), F.col("text")])
    other = M.row_digest([F.col("doc_id"), F.replace("text", F.lit("\n"), F.lit(""))])
    got = M.merkle_proofs(df.select("source", "doc_id", leaf.alias("leaf"), other.alias("other")), keep=("other",))
    got = got.withColumn("same", M.fold(F.col("other"), F.col("steps")) == F.col("root")).collect()
    assert len(got) == 60 and all(r["same"] == (r["doc_id"] % 2 == 0) for r in got)


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_middle(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = sha("42:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_equals_plain_python_and_comes_back(spark):
    rows = hostile_rows() + [(k, f" \tword{k} é <b> \U0001f600\n\nend" + " " * (k % 3)) for k in range(1_000, 1_300)]
    rows += [(1, "again"), (1, "again"), (None, "no id but a text"), (5_000, "has <P> in it"), (5_001, "<<P> x"), (5_002, "\x0b\x0c"), (5_003, "<S <M P> <P")]
    df = documents(spark, rows)
    for name in ("form", "output", "_text"):
        df = df.withColumn(name, F.lit("theirs"))
    made = fill_in_middle(df, keep=("text",))
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = [(r["doc_id"], r["text"], (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in made.collect()]
    assert sorted(map(repr, got)) == sorted(repr((k, t, brute_middle(k, t))) for k, t in rows)
    assert {x[2][1] for x in got} == {"plain", "psm", "spm"}
    back = restore_text(made, keep=("doc_id", "text")).collect()
    assert len(back) == len(rows) and all(r["restored"] == (r["text"] or "") for r in back)
    same = fill_in_middle(df, keep=("text",), restored=True).collect()
    assert len(same) == len(rows) and all(r["restored"] == (r["text"] or "") for r in same)
    assert fill_in_middle(df.limit(0)).collect() == [] and restore_text(made.limit(0)).collect() == []
    (bare,) = restore_text(spark.createDataFrame([(1, None, None)], "doc_id long, output string, form string")).collect()
    assert bare["restored"] == ""


def test_rotations_at_every_pair_of_cuts():
    data, marks = " aé  b\t<c\n d ".encode(), Marks(b"<prefix>", b"<s>", b"<mid>")
    ends = [0, *unit_ends(data)]
    for first in ends:
        for second in (e for e in ends if e >= first):
            for form in ("psm", "spm"):
                p, m, s = data[:first], data[first:second], data[second:]
                out = bytes(to_middle(data, first, second, form, marks))
                tail = marks.middle + m
                assert out == (marks.prefix + p + marks.suffix + s + tail if form == "psm" else marks.suffix + s + marks.prefix + p + tail)
                assert from_middle(out, form, marks) == data


def test_draws_need_no_more_than_the_id():
    """Half of the ids are transformed and four of five of those have the suffix first, whatever the texts are."""
    from sievelight.llm.middle import draws

    drawn = [draws(42, k) for k in range(4_000)]
    assert 0.46 < sum(d[2] % 100 < 50 for d in drawn) / 4_000 < 0.54
    assert 0.76 < sum(d[3] % 100 < 80 for d in drawn) / 4_000 < 0.84
    assert zlib.crc32(repr(drawn).encode()) == zlib.crc32(repr([draws(42, k) for k in range(4_000)]).encode())
