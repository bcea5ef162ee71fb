import re
import time

import pytest
from pyspark.sql import functions as F

from sievelight.functions import compat, links
from sievelight.functions import text as tx
from sievelight.functions.html import match_spans
from sievelight.functions.stats import wilson_interval


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(fn(F.col("x")).alias("y")).first()["y"]


def many(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_boundaries_are_ascii(spark):
    assert one(spark, "éof of", lambda c: F.regexp_count(c, F.lit(compat.regex(r"\bof\b")))) == 2


def test_space_class_and_end_anchor(spark):
    assert many(spark, ["a b", "a\u00a0b", "ab"], lambda c: c.rlike(compat.regex(r"a\sb"))) == [True, True, False]
    assert many(spark, ["ab", "ab\n"], lambda c: c.rlike(compat.regex(r"^ab$"))) == [True, False]
    assert many(spark, ["x@y.z", "a b@c.d", "a\u00a0b@c.d"], lambda c: c.rlike(compat.regex(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"))) == [
        True,
        False,
        False,
    ]


def test_trim_takes_every_space(spark):
    assert one(spark, "\t\u00a0\ufeffa b \r\n", compat.trim) == "a b"


def test_numbers(spark):
    got = many(spark, ["0x10", "", " 12.5 ", "1d", "-3e2", "abc", "0b101", ".5", "5.", "1,000"], compat.number)
    assert got == [16.0, 0.0, 12.5, None, -300.0, None, 5.0, 0.5, 5.0, None]


def test_half_up(spark):
    df = spark.sql("select * from values (-2.5D), (2.5D), (2.4D) as t(x)")
    assert [r[0] for r in df.select(compat.half_up(F.col("x"))).collect()] == [-2, 3, 2]


@pytest.mark.parametrize(
    "body, valid",
    [
        ('{"a":1}', True),
        ('{"a":1} x', False),
        ("{a", False),
        ("[1,2]", True),
        ("1,2", False),
        ("NaN", False),
        ('{"a":1,"a":2}', True),
        (" true ", True),
        ("", False),
        ("9" * 5000, True),
    ],
)
def test_strict_json(spark, body, valid):
    assert one(spark, body, compat.is_json) is valid


def test_stamps(spark):
    good = "2031-03-09T08:00:00.250Z hello"
    assert many(spark, [good, "2031-13-09T08:00:00Z x", "2031-03-09 08:00:00 x", " " + good], tx.stamp_ms) == [
        1930809600250,
        None,
        None,
        None,
    ]


def test_shape_folds_stamp_numbers_and_hex(spark):
    a = one(spark, "2031-03-09T08:00:00Z GET /User/17 ab12cd99 (x)", tx.shape_of)
    assert a == "get /user/# # x"


def test_normalize_keeps_meaning_only(spark):
    a = "2031-03-09T08:00:00Z ses_q1 ERROR link down host=10.1.2.3 port=80 try 4 (timeout 20ms) at 12:30:11"
    b = "2031-04-01T18:10:59Z ses_zz9 ERROR link down host=10.9.9.1 port=8443 try 19 (timeout 5000ms) at 9:01"
    got = many(spark, [a, b, "ERROR link down", "ERROR disk down"], tx.normalize_line)
    assert got[0] == got[1] == "<sid> ERROR link down host=<ip> port=<n> try <n> (timeout <q>) at <t>"
    assert got[2] != got[3]


def test_normalize_marks(spark):
    cases = {
        "id 3f2504e0-4f89-11d3-9a0c-0305e82c3301 ok": "id <uuid> ok",
        "ptr 0xDEADbeef hash 00aa11bb22cc": "ptr <hex> hash <hex>",
        "open C:\\logs\\a.txt now": "open <path> now",
        "read /srv/app/logs/today.txt": "read <path>",
        "build 12-r7 ticket #45 3x slower by 12 %": "build <n>-r<n> ticket #<n> <n>x slower by <q>",
        "defaced facade stays": "defaced facade stays",
    }
    assert many(spark, list(cases), tx.normalize_line) == list(cases.values())


def test_severity_words(spark):
    quiet = ["run over: 0 errors, 0 failures", "done, errors=0", "error_count=0", "no warnings left", "all good"]
    loud = {"link failed": "error", "FATAL stop": "error", "cache is stale": "warn", "call timed out": "warn"}
    assert many(spark, quiet, tx.severity) == ["info"] * len(quiet)
    assert many(spark, list(loud), tx.severity) == list(loud.values())


def test_norm_text(spark):
    assert one(spark, "  Zoë's  Café -- 7 ", tx.norm_text) == "zo s caf 7"
    assert one(spark, "  Zoë's  Café -- 7 ", lambda c: tx.norm_text(c, keep_all_scripts=True)) == "zoë s café 7"
    assert one(spark, "שלום, World", tx.norm_text) == "שלום world"


def test_tokenize_any_script(spark):
    assert one(spark, "Été-2031: Ärger_ß", tx.tokenize) == ["été", "2031", "ärger", "ß"]


def test_url_params_and_utm(spark):
    url = "https://a.test/p?UTM_Source=One&utm_source=two+three&x&utm_medium=%zz&utm_campaign=a%20b?utm_x=1"
    pairs = one(spark, url, links.url_params)
    assert [(p["name"], p["value"]) for p in pairs] == [
        ("UTM_Source", "One"),
        ("utm_source", "two three"),
        ("x", ""),
        ("utm_medium", None),
        ("utm_campaign", "a b"),
    ]
    utm = one(spark, url, links.link_utm)
    assert utm["utm_source"]["value"] == "two three" and utm["utm_source"]["name"] == "utm_source"
    assert set(utm) == {"utm_source", "utm_medium", "utm_campaign"}


def test_links_of_a_line(spark):
    line = 'see [a](https://a.test/x) and [b](/local) <a HREF="http://b.test/y?z=1">b</a> [c](HTTPS://c.test)'
    assert one(spark, line, links.links_in_line) == ["https://a.test/x", "HTTPS://c.test", "http://b.test/y?z=1"]


def test_personal_data(spark):
    lines = ["held on 2031-03-09 only", "mail zoe@b.test now", "ring 050-7654321", "ring 12345678", "id 1234567890"]
    assert many(spark, lines, links.is_pii_line) == [False, True, True, False, True]


def test_match_spans_give_offsets_and_lines(spark):
    body = "ab\n<i>x</i>\n\n <i>\n</i>"
    spans = one(spark, body, lambda c: match_spans(c, "<i>"))
    want = [(m.start() + 1, body[: m.start()].count("\n") + 1) for m in re.finditer("<i>", body)]
    assert [(s["start"], s["line"]) for s in spans] == want


def test_match_spans_of_many_matches(spark):
    """Runs of matches join without a seam; ten times the matches cost about ten times the work."""
    bodies = [("é<i>\n" * n + "\n<i><i>" * (n % 7) + "tail") for n in (0, 1, 255, 256, 257, 700)] + ["", "<i>", "none\n"]
    for body, spans in zip(bodies, many(spark, bodies, lambda c: match_spans(c, "<i>\n?")), strict=True):
        want = [(m.group(), m.start() + 1, body[: m.start()].count("\n") + 1) for m in re.finditer("<i>\n?", body)]
        assert [tuple(s) for s in spans] == want
    assert one(spark, None, lambda c: match_spans(c, "<i>")) is None
    times = []
    for n in (10_000, 100_000):
        df = spark.createDataFrame([("ab\nc<i>" * n,)], "body string").select(F.element_at(match_spans(F.col("body"), "<i>"), -1).alias("last"))
        start = time.time()
        assert df.first()["last"]["line"] == n + 1
        times.append(time.time() - start)
    assert times[1] < 40 * max(times[0], 0.1)


def test_wilson_values(spark):
    df = spark.sql("select * from values (48, 50), (0, 0), (10, 10) as t(p, n)")
    got = [r[0] for r in df.select(wilson_interval(F.col("p"), F.col("n"))).collect()]
    assert abs(got[0]["low"] - 0.865) < 0.01 and abs(got[0]["high"] - 0.989) < 0.01
    assert (got[1]["rate"], got[1]["low"], got[1]["high"]) == (0.0, 0.0, 0.0)
    assert got[2]["high"] == 1.0
