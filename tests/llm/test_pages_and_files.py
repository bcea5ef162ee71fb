"""Main text, URL filters, shards and archive revisits."""

import os
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from helpers_llm import documents, hostile_rows  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sievelight.llm.queries import QUERIES, RULES, op7_sharding  # noqa: E402
from sievelight.llm.sharding import hilbert_index, hilbert_shards  # noqa: E402
from sievelight.llm.urls import url_filter  # noqa: E402
from sievelight.llm.warc import canonical_url, resolve_revisits  # noqa: E402
from sievelight.llm.wrappers import extract_main_text, main_text  # noqa: E402


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "reference", "constant", "text", "slot", "path", "verdict"):
        df = df.withColumn(name, F.lit(1))
    return df


@pytest.mark.parametrize(
    "html, want",
    [
        ("<article><h1>T &amp; U</h1><p>a\n <b>b</b>&nbsp;c<p>d<br>e</article>", "T & U\na b c\nd e"),
        ("<nav>x</nav><article><p>a</p><div class='ad'>buy</div><form>f</form><aside>s</aside><p>b</p></article><footer>z</footer>", "a\nb"),
        ("<body><header>h</header><main><p>a</p><section id=comments><p>nice</p></section></main></body>", "a"),
        ("<p>a</p><script>if (1<2) '</p>'</script><style>p{}</style><!-- c --><p>b &lt;i&gt;", "a\nb <i>"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
        ("", ""), ("plain & simple", "plain & simple"), ("<a title='x > y'>t</a>", "t"), ("<p>open <b", "open <b"),
    ],
)
def test_main_text_of_one_page(html, want):
    assert main_text(html) == want


def templated(k, body):
    return f"<body><div><ul><li>Home</ul></div><div><h2>News</h2>{body}<p>Read more here</p></div><div><p>All rights kept</p></div></body>"


def test_constant_nodes_are_template(spark):
    """Pages without any telling names: what all pages of a host share goes, other hosts keep theirs."""
    rows = [(k, "http://a.org/x", templated(k, "".join(f"<p>part {k} {j}</p>" for j in range(1 + k % 3)))) for k in range(8)]
    rows += [(20, "http://b.org/y", templated(0, "<p>lone</p>")), (21, None, None), (22, "nonsense", ""), (0, "http://a.org/x", rows[0][2])]
    got = {r["page_id"]: r["text"] for r in extract_main_text(pages(spark, rows)).collect()}
    for k in range(8):
        assert got[k] == "\n".join(f"part {k} {j}" for j in range(1 + k % 3))
    assert got[20] == "Home\nNews\nlone\nRead more here\nAll rights kept" and got[21] == got[22] == ""
    assert extract_main_text(pages(spark, rows)).count() == len(rows)
    assert extract_main_text(pages(spark, [])).collect() == []


def test_copies_of_a_page_are_no_template(spark):
    """A host of one page stored often keeps its text, and so do the copies among a few other pages."""
    page = "<body><article><h1>Title</h1><p>All of it</p></article></body>"
    rows = [(k, "http://a.org/x", page if k else page.replace("<body>", "<body >")) for k in range(7)]
    rows += [(20 + k, "http://b.org/x", templated(0, "<p>stored often</p>")) for k in range(60)] + [(90 + k, "http://b.org/x", templated(k, f"<p>part {k}</p>")) for k in range(5)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(pages(spark, rows)).collect()}
    assert {got[k] for k in range(7)} == {"Title\nAll of it"}
    assert {got[20 + k] for k in range(60)} == {"stored often"} and [got[90 + k] for k in range(5)] == [f"part {k}" for k in range(5)]


@pytest.mark.parametrize("stub", ["", "gone", "<p>gone</p>"])
def test_a_stub_is_no_reference(spark, stub):
    rows = [(k, "http://a.org/x", templated(k, f"<p>part {k}</p>")) for k in range(8)] + [(20 + k, "http://a.org/x", stub) for k in range(9)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(pages(spark, rows)).collect()}
    assert [got[k] for k in range(8)] == [f"part {k}" for k in range(8)]


def test_rules_and_reputation(spark):
    rows = [(1, "http://WWW.Example.com/en/1"), (2, "https://a.example.com/en/2?x"), (3, "http://b.net/es/3"), (4, "http://b.net/de/4"), (5, None), (6, "no scheme")]
    rows += [(7, "http://x.com"), (8, "http://notexample.com/en/"), (9, "http://bad.org/a"), (10, "http://new.org/a"), (11, "HTTP://x.com?p=/en/#/")]
    rows += [(100 + k, "http://bad.org/q") for k in range(60)] + [(200 + k, "http://fine.org/q") for k in range(200)]
    df = pages(spark, [(i, u, None) for i, u in rows])
    good = F.when(F.col("page_id").between(100, 199), 0).when(F.col("page_id") >= 200, 1)
    got = {r["page_id"]: r for r in url_filter(df, RULES, good).collect()}
    assert len(got) == len(rows)
    assert [got[k]["rule"] for k in (1, 2, 3, 4, 5, 6, 7, 8, 11)] == ["www.example.com/en/", "example.com/en/", "net/es/", None, None, None, None, "com/", None]
    assert (got[1]["verdict"], got[2]["verdict"], got[3]["verdict"]) == ("allow", "block", "block")
    assert (got[5]["host"], got[5]["path"], got[6]["host"], got[2]["path"], got[11]["path"]) == ("", "", "", "/en/2", "")
    assert got[9]["verdict"] == "block" and got[200]["verdict"] == "allow"
    assert got[9]["lower"] < got[10]["lower"] < got[200]["lower"]
    assert url_filter(df.limit(0), RULES, good).collect() == []


def test_hilbert_curve_visits_neighbours(spark):
    """Every cell once, and each step goes to a cell one apart."""
    cells = spark.range(4096).select(*[F.shiftright("id", 4 * k).bitwiseAND(15).cast("int").alias(n) for k, n in enumerate("xyz")])
    rows = cells.withColumn("h", hilbert_index([F.col("x"), F.col("y"), F.col("z")], 4)).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(4096))
    assert all(sum(abs(a[n] - b[n]) for n in "xyz") == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_shards_are_even_and_in_curve_order(spark):
    rows = hostile_rows() + [(5, "twice"), (5, "twice"), (None, None)]
    docs = documents(spark, rows).withColumn("x", F.coalesce(F.length("text"), F.lit(0)) % 16)
    for shards in (4, 40):
        got = hilbert_shards(docs, [F.col("x"), F.lit(0), F.lit(3)], shards, "doc_id").collect()
        assert len(got) == len(rows)
        sizes = [sum(r["shard"] == s for r in got) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1
        for s in range(shards):
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
        ordered = [r["curve"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
        assert ordered == sorted(ordered)
    assert hilbert_shards(docs.limit(0), [F.col("x"), F.lit(0), F.lit(3)], 4, "doc_id").collect() == []


def test_shard_query(spark):
    got = op7_sharding(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "rows")


def test_canonical_urls(spark):
    urls = ["http://A.org:80/x/?b=2&a=1&utm_x=3#f", "https://a.org/x?a=1&b=2", "http://a.org", "a", None, "http://a.org/?utm_a=1"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(canonical_url(F.col("u"))).collect()] == ["a.org/x?a=1&b=2", "a.org/x?a=1&b=2", "a.org", "", None, "a.org"]


RECORD = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>, canonical string"


def test_revisits(spark):
    u = "http://a.org/x"
    rows = [
        (1, u, 10, "response", 200, '"e1"', "m1", "d1", {"etag": '"e1"', "date": "10", "content-length": "5"}, None),
        (2, u, 20, "response", 200, '"e2"', "m2", "d2", None, None),
        (3, u, 25, "response", 500, '"e3"', "m3", "d3", {}, None),
        (4, "https://A.org/x/#f", 15, "revisit", 304, 'W/"e1"', None, None, {"date": "15", "content-length": "0", "set-cookie": "c"}, None),
        (5, u, 30, "revisit", 304, None, "m2", None, None, None), (6, u, 30, "revisit", 304, None, "m1", None, {}, None), (7, u, 30, "revisit", 304, None, None, "d2", {}, None),
        (8, u, 30, "revisit", 304, None, None, None, {}, None), (9, u, 10, "revisit", 304, '"e1"', None, None, {}, None), (10, None, 30, "revisit", 304, '"e1"', None, None, {}, None),
        (11, u, None, "revisit", 304, '"e1"', None, None, {}, None), (12, u, 20, "response", 200, '"e4"', None, None, {}, None), (13, u, 20, "revisit", 304, '"e1"', None, None, {}, None),
    ]
    got = {r["record_id"]: r for r in resolve_revisits(spark.createDataFrame(rows, RECORD), blocks=3).collect()}
    outcome = {k: (r["original_id"], r["outcome"]) for k, r in got.items()}
    assert outcome == {
        4: (1, "resolved"), 5: (12, "mismatch"), 6: (12, "mismatch"), 7: (12, "mismatch"), 8: (12, "unvalidated"), 9: (None, "orphan"),
        10: (None, "orphan"), 11: (None, "orphan"), 13: (1, "resolved"),
    }
    assert got[4]["headers"] == {"etag": '"e1"', "date": "15", "content-length": "5"} and got[5]["headers"] is None
    for blocks in (1, 1024):
        again = resolve_revisits(spark.createDataFrame(rows, RECORD), blocks=blocks).collect()
        assert {r["record_id"]: (r["original_id"], r["outcome"]) for r in again} == outcome
    assert resolve_revisits(spark.createDataFrame([], RECORD)).collect() == []


def test_queries_are_named():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
