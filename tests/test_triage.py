import random

import pytest
from helpers import rows_of, text_frame
from pyspark.sql import functions as F

from sievelight.operators import triage as tr
from sievelight.sources import known
from sievelight.sources.lines import lines_from_text

PLANTED = """\
2031-03-09T08:00:00Z ses_k1 job start ok
2031-03-09T08:00:04Z ses_k1 ERROR link broken host=10.1.0.4 port=80 (timeout 300ms)
    at open (/srv/app/net/link.js:4)

    at loop (/srv/app/net/loop.js:9)
2031-03-09T08:00:09Z ses_k2 ERROR link broken host=10.1.0.9 port=81 (timeout 900ms)
    at other (/srv/app/net/other.js:1)
2031-03-09T08:00:10Z ses_k2 WARN copy stale age 40s
2031-03-09T08:00:20Z ses_k3 ERROR link broken host=10.1.7.7 port=82 (timeout 5s)
2031-03-09T08:00:30Z ses_k3 WARN copy stale age 7m
2031-03-09T08:00:31Z ses_k3 done: 0 errors, 0 failures
"""

CLEAN = """\
2031-03-09T09:00:00Z ses_k4 job start ok
2031-03-09T09:00:10Z ses_k4 WARN copy stale age 4m
2031-03-09T09:00:31Z ses_k4 done, errors=0
"""


def lines(spark, texts):
    return lines_from_text(text_frame(spark, texts))


def test_planted_patterns(spark):
    ranked = tr.rank_problems(tr.pattern_agg(lines(spark, PLANTED)), numbered=True)
    assert rows_of(ranked, "place", "severity", "count", "first_line", "first_ts", "last_ts") == [
        (1, "error", 3, 2, "2031-03-09T08:00:04", "2031-03-09T08:00:20"),
        (2, "warn", 2, 8, "2031-03-09T08:00:10", "2031-03-09T08:00:30"),
    ]
    first = ranked.filter("place = 1").first()
    assert first["pattern"] == "<sid> ERROR link broken host=<ip> port=<n> (timeout <q>)"
    assert first["sample"].startswith("2031-03-09T08:00:04Z ses_k1")
    in_order = [r["first_line"] for r in tr.rank_problems(tr.pattern_agg(lines(spark, PLANTED))).collect()]
    assert in_order == [2, 8]


def test_families_and_summary(spark):
    log = lines(spark, PLANTED)
    assert rows_of(tr.family_agg(log), "family", "severity", "lines", "first_line") == [
        ("ERROR link", "error", 3, 2),
        ("WARN copy", "warn", 2, 8),
    ]
    assert rows_of(
        tr.triage_summary(log), "lines", "patterns", "problem_patterns", "error_patterns", "families", "biggest_family"
    ) == [(7, 4, 2, 1, 2, 3)]


def test_context_and_continuations(spark):
    log = lines(spark, PLANTED)
    known = spark.createDataFrame([], "id string")
    got = {r["severity"]: r for r in tr.triage(log, known).collect()}
    assert got["error"]["stack"] == ["at open (/srv/app/net/link.js:4)", "at loop (/srv/app/net/loop.js:9)"]
    assert got["error"]["before"] == ["2031-03-09T08:00:00Z ses_k1 job start ok"]
    assert got["warn"]["stack"] == [] and len(got["warn"]["before"]) == 2
    assert got["error"]["status"] == "new"


def test_known_patterns_are_not_new(spark):
    warn = tr.pattern_agg(lines(spark, PLANTED)).filter("severity = 'warn'").select("id")
    got = tr.triage(lines(spark, CLEAN), warn).collect()
    assert [(r["severity"], r["status"]) for r in got] == [("warn", "known")]


def test_families_sharing_a_fingerprint_are_two_patterns(spark, monkeypatch):
    monkeypatch.setattr(tr.tx, "fingerprint", lambda pattern: F.lit("bt-same"))
    log = lines(spark, "ERROR red lamp\nWARN blue lamp\nERROR red lamp\n")
    assert rows_of(tr.pattern_counts(log), "id", "count", "first_line", "severity") == [("bt-same", 1, 2, "warn"), ("bt-same", 2, 1, "error")]
    assert rows_of(tr.family_agg(log), "family", "lines") == [("ERROR red", 2), ("WARN blue", 1)]


def brute_force(text, keep):
    """Stack per first line, straight from the definition."""
    stacks, last, seen = {}, None, set()
    for i, raw in enumerate(text.split("\n"), 1):
        if not raw.strip():
            continue
        if raw[0].isspace():
            if last and len(stacks[last]) < keep:
                stacks[last].append(raw.strip())
            continue
        last = None if raw in seen else i
        seen.add(raw)
        if last:
            stacks[last] = []
    return {k: v for k, v in stacks.items() if v}


@pytest.mark.parametrize("block_rows", [3, 10, 1000])
def test_continuations_do_not_depend_on_blocks(spark, block_rows):
    rng = random.Random(3)
    words = "ash birch cedar elm fir hazel".split()
    text = "\n".join(rng.choice(["", "  deep " + str(i), f"\tin {i}", f"head {rng.choice(words)} {rng.choice(words)}"]) for i in range(200))
    text = "   orphan\n" + text
    for most in (4, None):
        got = tr.attach_continuations(lines(spark, {"a": text, "b": text}).repartition(7), most, block_rows=block_rows)
        want = brute_force(text, most or 1_000)
        assert {(r["source"], r["line_no"]): r["stack"] for r in got.collect()} == {(s, k): v for s in "ab" for k, v in want.items()}


def test_patterns_with_one_short_id_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(tr.tx, "fingerprint", lambda pattern: F.concat(F.lit("bt-"), F.lit("same")))
    log = lines(spark, {"a": "ERROR red fox\nERROR blue sky\nERROR red fox"})
    assert rows_of(tr.pattern_agg(log), "id", "count", "pattern") == [("bt-same", 1, "ERROR blue sky"), ("bt-same", 2, "ERROR red fox")]


def test_texts_are_whole_unless_a_length_is_given(spark):
    log = lines(spark, {"a": "ERROR " + "word " * 100 + "end\n  " + "deep " * 80 + "end"})
    row = tr.pattern_agg(log).first()
    assert row["pattern"].endswith("end") and row["sample"].endswith("end")
    assert len(tr.pattern_agg(log, pattern_chars=10, sample_chars=20).first()["sample"]) == 20
    assert tr.attach_continuations(log).first()["stack"][0].endswith("end")


def keys_frame(spark, names, ids=None):
    rows = [(ids or f"bt-{n}", n) for n in names]
    return spark.createDataFrame(rows, "id string, name string").select("id", "name", F.unhex(F.sha1("name")).alias("key"))


def test_known_set_grows_by_new_keys_only(spark, tmp_path):
    path = str(tmp_path / "known")
    assert known.known_keys(spark, path).collect() == []
    assert known.add_known(keys_frame(spark, [f"p{k}" for k in range(50)]), path) == 50
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "known").rglob("*.parquet")}
    assert known.add_known(keys_frame(spark, ["p1", "p2", "p2", "q1"]), path) == 1
    now = set((tmp_path / "known").rglob("*.parquet"))
    assert len(now - set(files)) == 1 and all(f.stat().st_mtime_ns == at for f, at in files.items())
    got = known.mark_known(keys_frame(spark, ["p3", "q1", "q2", "q2"]), path)
    assert rows_of(got, "name", "status") == [("p3", "known"), ("q1", "known"), ("q2", "new"), ("q2", "new")]
    # Only the parts that are asked about are read.
    scans = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in x and "prefix" in x]
    assert scans and all("prefix" in x.split("PartitionFilters")[1].split("]")[0] for x in scans)
    before = rows_of(known.known_keys(spark, path), "id")
    assert known.compact_known(spark, path) == 2
    assert rows_of(known.known_keys(spark, path), "id") == before
    parts = [f.parent.name for f in (tmp_path / "known" / "version=2").rglob("*.parquet")]
    assert len(parts) == len(set(parts))


def test_patterns_that_share_a_short_id_stay_apart(spark, tmp_path):
    path = str(tmp_path / "known")
    known.add_known(keys_frame(spark, ["one"], ids="bt-same"), path)
    got = known.mark_known(keys_frame(spark, ["one", "two"], ids="bt-same"), path)
    assert rows_of(got, "name", "status") == [("one", "known"), ("two", "new")]
    assert known.add_known(keys_frame(spark, ["one", "two"], ids="bt-same"), path) == 1
