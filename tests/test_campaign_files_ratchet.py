import hashlib
import json
import random

import pytest
from helpers import details, in_order, rows_of
from pyspark.sql import functions as F

from sievelight.operators import campaign as cp
from sievelight.operators import filecorpus as fc
from sievelight.operators import ratchet as rt
from sievelight.sources import state
from sievelight.sources.campaigns import read_campaigns

UTM = "utm_source=letter&utm_medium=mail&utm_campaign=spring"


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf8")


CLEAN = {
    "campaign.json": json.dumps({"name": "s", "utm_source": "letter", "utm_medium": "mail", "utm_campaign": "spring"}),
    "posts/one.md": f"# One\nSee [boats](https://a.test/boats?{UTM}) today, 2031-03-09.\n",
    "posts/two.md": f'<a href="https://a.test/bees?{UTM}">bees</a> and [local](/x)\n',
    "visits.csv": f"URL,Visits\nhttps://a.test/boats?{UTM},30\nhttps://a.test/x?{UTM.replace('letter', 'Letter')}&utm_term=k,45\nhttps://b.test/,7\n",
    "sales.csv": f"url,amount\nhttps://a.test/boats?{UTM},3\nhttps://a.test/boats,4\n",
}
PLANTED = CLEAN | {
    "campaign.json": json.dumps({"name": "s", "utm_source": "letter", "utm_medium": "Mail"}),
    "posts/one.md": f"[plain](https://a.test/boats)\n[short](https://a.test/b?utm_source=letter&utm_medium=mail)\n"
    f"[loud](https://a.test/c?{UTM.replace('letter', 'LETTER')})\nring 050-7654321\n[name](https://a.test/c?{UTM.replace('utm_source', 'UTM_source')})\n",
}


@pytest.fixture(scope="module")
def campaigns(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("campaigns")
    write(root / "good", CLEAN)
    write(root / "bad", PLANTED)
    write(root / "none", {"posts/a.md": "no links\n"})
    return read_campaigns(spark, str(root))


def named(df):
    return df.withColumn("source", F.substring_index("source", "/", -1))


def test_only_required_fields_are_asked_for(campaigns):
    """A narrower list goes for campaign files and links alike; a wider one too."""
    found = named(cp.campaign_findings(campaigns.campaigns, campaigns.posts, required=("utm_source", "utm_medium")))
    assert rows_of(found.filter("kind LIKE 'missing%' AND source = 'bad'"), "kind", "row", "key") == [("missing-utm", 1, "posts/one.md")]
    wide = named(cp.campaign_findings(campaigns.campaigns, campaigns.posts, required=("utm_source", "utm_term")))
    assert rows_of(wide.filter("kind = 'missing-field' AND source = 'good'"), "key") == [("utm_term",)]


def test_tables_are_not_read_as_whole_files(campaigns):
    """Campaign files and posts come from readers of their own names; the listing of folders reads no contents."""
    for df in (campaigns.campaigns, campaigns.posts):
        plan = df._jdf.queryExecution().executedPlan().toString()
        reads = [line for line in plan.split("\n") if "FileScan binaryFile" in line]
        assert reads and all("Csv" not in line and "[cC][sS][vV]" not in line for line in reads)
        assert sum("content" in line.split("Batched")[0] for line in reads) == 1


def test_campaign_findings(campaigns):
    found = named(cp.campaign_findings(campaigns.campaigns, campaigns.posts))
    assert rows_of(found, "source", "kind", "row", "key") == in_order(
        [
            ("bad", "bad-utm", None, "utm_medium"),
            ("bad", "missing-field", None, "utm_campaign"),
            ("bad", "missing-utm", 1, "posts/one.md"),
            ("bad", "missing-utm", 2, "posts/one.md"),
            ("bad", "bad-utm", 3, "posts/one.md"),
            ("bad", "pii", 4, "posts/one.md"),
            ("bad", "bad-utm", 5, "posts/one.md"),
            ("none", "missing-field", None, None),
        ]
    )


def test_links_and_privacy(campaigns):
    links = named(cp.extract_links(campaigns.posts))
    assert rows_of(links.groupBy("source").count(), "source", "count") == [("bad", 5), ("good", 2)]
    assert "LETTER" not in details(cp.bad_utm(cp.extract_links(campaigns.posts)))
    assert "LETTER" in details(cp.bad_utm(cp.extract_links(campaigns.posts), include_text=True))


def test_scoreboard(campaigns):
    got = named(cp.scoreboard_join(campaigns.visits, campaigns.sales, campaigns.campaigns))
    assert rows_of(got, "source", "visits_total", "visits_joined", "sales_total", "sales_joined") == [
        ("bad", 82.0, 0.0, 2, 0),
        ("good", 82.0, 75.0, 2, 1),
        ("none", 0.0, 0.0, 0, 0),
    ]


def block_hash(files):
    """The rule in plain Python: files, blocks of files by a hash of their place, blocks."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    blocks = {}
    for position, file, text in files:
        place = f"{position}\n{file}"
        blocks.setdefault(sha(place)[:2], []).append((place, sha(f"{place}\n{text}")))
    return sha("".join(sha("".join(leaf for _, leaf in sorted(blocks[b]))) for b in sorted(blocks)))[:16]


def test_content_hash(campaigns):
    got = {r["source"]: r["digest"] for r in named(cp.content_hash(campaigns.files)).collect()}
    good = [(r["position"], r["file"], r["text"]) for r in named(campaigns.files).filter("source = 'good'").collect()]
    assert got["good"] == block_hash(good) and len(set(got.values())) == 3
    again = {r["source"]: r["digest"] for r in named(cp.content_hash(campaigns.files.repartition(3))).collect()}
    assert again == got


def test_content_hash_is_one_rule_for_all_sizes(spark):
    """More files than any former limit; one more file, another order or another text each change the digest."""
    files = [(f"{k:06}", f"f{k}", "x" * (k % 7)) for k in range(12_000)]
    digests = []
    for rows in (files, files[:-1], [("9", "f0", ""), *files[1:]], [("000000", "f0", "y"), *files[1:]]):
        df = spark.createDataFrame([("s", *r) for r in rows], "source string, position string, file string, text string")
        digests.append(cp.content_hash(df).first()["digest"])
        assert digests[-1] == block_hash(rows)
    assert len(set(digests)) == 4


GOOD = {
    "SKILL.md": "---\nname: cook\ndescription: Cooks soup.\n---\n# Cook\n",
    "agent.md": "---\ndescription: Cooks.\n---\ntools: read, stir\n",
    "run.mjs": 'import { soup } from "./soup.mjs";\nawait fetch("http://127.0.0.1:3000/ok");\n',
    "test.mjs": "check(soup);\n",
    "mcp.json": '{"ok": true}',
}


def corpus(spark, **dirs):
    rows = [(d, n, t) for d, files in dirs.items() for n, t in files.items()]
    return spark.createDataFrame(rows, "source string, name string, text string")


def test_scaffolds(spark):
    bad = {"SKILL.md": "# Cook\n", "agent.md": "tools: *\n", "run.mjs": 'ok();\nawait fetch("https://far.test");\neval(x)\n'}
    odd = GOOD | {"mcp.json": "{nope", "run.mjs": 'const k = "sk-abcdefgh12345678";\n', "a.md": "api_key: 'abcdefgh'"}
    found = fc.scaffold_findings(corpus(spark, good=GOOD, bad=bad, odd=odd))
    assert rows_of(found, "source", "kind", "key") == [
        ("bad", "bad-frontmatter", "SKILL.md"),
        ("bad", "missing-file", "test.mjs"),
        ("bad", "overbroad-scope", "agent.md"),
        ("bad", "unsafe-capability", "run.mjs"),
        ("odd", "broken-manifest", "mcp.json"),
        ("odd", "secret-leak", "a.md"),
    ]
    assert found.filter("kind = 'unsafe-capability'").first()["row"] == 2
    every = fc.secret_leak(corpus(spark, odd=odd), first_only=False)
    assert rows_of(every, "key") == [("a.md",), ("run.mjs",)]


def test_agent_card_in_either_spelling(spark):
    files = {k: v for k, v in GOOD.items() if k != "agent.md"}
    assert rows_of(fc.missing_file(corpus(spark, a=files, b=files | {"AGENT.md": "tools: read"})), "source", "key") == [("a", "agent.md")]


def test_test_kinds(spark):
    paths = {
        "node": ["test/a.test.js", "src/x.js"],
        "both": ["tests/a.test.mjs", "tests/test_a.py"],
        "deep": ["tests/sub/a.test.js", "lib/Cargo.toml"],
        "more": ["Cargo.toml", "all.sln", "pytest.ini"],
    }
    df = spark.createDataFrame([(k, p) for k, v in paths.items() for p in v], "source string, path string")
    assert rows_of(fc.detect_test_kind(df), "source", "id") == [
        ("both", "node-test"), ("both", "pytest"), ("more", "cargo-test"), ("more", "dotnet-test"), ("more", "pytest"), ("node", "node-test"),
    ]


def test_counts(spark):
    df = spark.createDataFrame([("3 passed\n5 passed",), ("none",), (None,)], "x string")
    got = df.select(
        rt.extract_counts(F.col("x"), rt.COUNT_PATTERNS["pytest"]).alias("last"), rt.extract_counts(F.col("x"), r"(\d+) passed", how="sum").alias("sum")
    )
    assert [tuple(r) for r in got.collect()] == [(5, 8), (None, None), (None, None)]


RUNS = [(3, False, 0), (3, False, 0), (2, False, 0), (4, False, 0), (9, True, 0), (3, False, 1), (4, False, 0), (3, False, 0), (None, False, 1)]
VERDICTS = [
    (None, "PASS", None, 3), (3, "PASS", None, 3), (3, "FAIL", "ratchet", 3), (3, "PASS", None, 4), (4, "FAIL", "failing step", 4),
    (4, "PASS", None, 4), (4, "PASS", None, 4), (4, "FAIL", "ratchet", 4), (4, "PASS", None, 4),
]


@pytest.mark.parametrize("block_rows", [2, 5, 1000])
def test_ratchet(spark, block_rows):
    rows = [(s, t, *r) for s in ("a", "b") for t, r in enumerate(RUNS)]
    df = spark.createDataFrame(rows, "suite string, run_ts int, value long, failed boolean, uncounted int").repartition(5)
    got = rt.metric_ratchet(df, block_rows=block_rows).orderBy("suite", "run_ts").collect()
    assert [(r["baseline"], r["verdict"], r["reason"], r["baseline_after"]) for r in got] == VERDICTS * 2


def metric_runs(seed, count):
    rng = random.Random(seed)
    return [(rng.choice("abc"), k, rng.choice([None, *range(20)]), rng.random() < 0.2, rng.choice([0, 0, 0, 1])) for k in range(count)]


METRIC_RUNS = "suite string, run_ts long, value long, failed boolean, uncounted int"


def test_ratchet_over_runs_equals_the_whole_history(spark, tmp_path):
    """Batches of any size, one of them judged twice, give what one pass over all runs gives."""
    rows, path = metric_runs(3, 60), str(tmp_path / "baseline")
    want = rows_of(rt.metric_ratchet(spark.createDataFrame(rows, METRIC_RUNS)), "run_ts", "baseline", "verdict", "reason", "baseline_after")
    got, at = [], 0
    for size in (1, 7, 20, 32):
        batch = spark.createDataFrame(rows[at : at + size], METRIC_RUNS)
        got += rows_of(rt.ratchet_runs(batch, path), "run_ts", "baseline", "verdict", "reason", "baseline_after")
        at += size
    assert in_order(got) == want
    before = rows_of(state.read_state(spark, path, "suite string, baseline long"), "suite", "baseline")
    rt.ratchet_runs(spark.createDataFrame(rows[-5:], METRIC_RUNS), path)
    assert rows_of(state.read_state(spark, path, "suite string, baseline long"), "suite", "baseline") == before
    assert len(list((tmp_path / "baseline").glob("version=*"))) == state.KEPT + 1


def test_a_crash_before_the_swap_keeps_the_old_baseline(spark, tmp_path):
    path = str(tmp_path / "baseline")
    rt.ratchet_runs(spark.createDataFrame([("a", 1, 5, False, 0)], METRIC_RUNS), path)
    torn = spark.range(4, numPartitions=4).selectExpr("'a' AS suite", "CASE WHEN id = 3 THEN raise_error('lost') ELSE 99 END AS baseline")
    with pytest.raises(Exception, match="lost"):
        state.write_state(torn, path)
    # What a lost driver leaves: files of a version that was never marked.
    half = tmp_path / "baseline" / "version=7"
    spark.createDataFrame([("a", 99)], "suite string, baseline long").write.parquet(str(half))
    (half / "_SUCCESS").unlink()
    (judged,) = rt.ratchet_runs(spark.createDataFrame([("a", 2, 4, False, 0)], METRIC_RUNS), path).collect()
    assert (judged["baseline"], judged["verdict"], judged["reason"]) == (5, "FAIL", "ratchet")
    assert rows_of(state.read_state(spark, path, "suite string, baseline long"), "suite", "baseline") == [("a", 5)]
    assert state.write_state(spark.createDataFrame([("a", 6)], "suite string, baseline long"), path) == 9


def test_no_state_is_an_empty_table(spark, tmp_path):
    assert state.read_state(spark, str(tmp_path / "none"), "suite string, baseline long").collect() == []
    assert rt.ratchet_runs(spark.createDataFrame([], METRIC_RUNS), str(tmp_path / "new")).collect() == []
