import random
import re

import pytest
from helpers import details, kinds_at, rows_of, stamp, text_frame
from pyspark.sql import functions as F

from sievelight.operators import abuse
from sievelight.operators.findings import by_kind, kinds
from sievelight.plans import sizing
from sievelight.plans.windows import dealt
from sievelight.sources.lines import log_lines_from_text

NAMES = "ash birch cedar elm fir hazel larch maple oak pine rowan spruce yew willow".split()


def planted():
    out = [(i * 5, f"pulse from node {i} seen") for i in range(10)]
    at = 200
    for i, name in enumerate(NAMES):
        out.append((at, f"note about {name} tree"))
        at += [1, 6, 2, 5, 3, 4][i % 6]
    out += [(s, "GET /list by visitor") for s in (400, 421, 437, 470, 499, 531)]
    out += [(s, "401 for visitor") for s in (900, 908, 921, 940)]
    out += [(s, f"GET /item/{700 + i} card") for i, s in enumerate((1500, 1504, 1509, 1516, 1521, 1530, 1534, 1543))]
    return "\n".join(f"{stamp(s)} {t}" for s, t in out) + "\n"


CLEAN = "\n".join(
    f"{stamp(s)} {t}"
    for s, t in [(0, "service up"), (40, "first page shown"), (95, "mail drafted"), (300, "owner asked"), (420, "all kept")]
)


def lines(spark, text):
    return log_lines_from_text(text_frame(spark, text))


def test_planted_log_has_each_signal_once(spark):
    found = abuse.abuse_findings(lines(spark, planted()))
    assert kinds_at(found) == {
        "machine-rhythm": [1],
        "rate-burst": [11],
        "template-reuse": [25],
        "auth-burst": [31],
        "sweep": [35],
    }
    text = details(found)
    assert "/item/" not in text and "pulse" not in text
    assert rows_of(kinds(found), "source")[0] == ("log",)
    assert {r["kind"]: r["findings"] for r in by_kind(found).collect()} == {k: 1 for k in kinds_at(found)}


def test_clean_log_is_silent(spark):
    assert abuse.abuse_findings(lines(spark, CLEAN)).count() == 0


def test_row_numbers_skip_blank_lines(spark):
    got = lines(spark, f"{stamp(0)} a\n\n{stamp(1)} b\r\n")
    assert rows_of(got, "line_no", "n", "line") == [(1, 1, f"{stamp(0)} a"), (3, 2, f"{stamp(1)} b")]


def many(spark, times, word):
    return lines(spark, "\n".join(f"{stamp(s)} {word(i)}" for i, s in enumerate(times)))


def test_rhythm_needs_even_gaps(spark):
    even = many(spark, [i * 2 for i in range(9)], lambda i: NAMES[i])
    assert abuse.machine_rhythm(even).count() == 1
    uneven = many(spark, [0, 2, 11, 14, 28, 32, 53, 58, 88], lambda i: NAMES[i])
    assert abuse.abuse_findings(uneven).count() == 0


def test_rhythm_refuses_time_running_back(spark):
    back = many(spark, [0, 2, 4, 6, 5.9, 8, 10, 12, 14, 16], lambda i: NAMES[i])
    assert abuse.machine_rhythm(back).count() == 0


def test_thresholds_at_and_below(spark):
    three = many(spark, [0, 20, 40], lambda i: "403 forbidden here")
    four = many(spark, [0, 20, 40, 300], lambda i: "403 forbidden here")
    far = many(spark, [0, 20, 40, 300.001], lambda i: "403 forbidden here")
    assert [abuse.auth_burst(x).count() for x in (three, four, far)] == [0, 1, 0]
    one_minute = many(spark, [2, 9, 21, 33, 47], lambda i: "GET /list by visitor")
    two_minutes = many(spark, [2, 21, 44, 75, 102], lambda i: "GET /list by visitor")
    assert [abuse.template_reuse(x).count() for x in (one_minute, two_minutes)] == [0, 1]
    seven = many(spark, [i * 7 for i in range(7)], lambda i: f"GET /item/{301 + i}")
    eight = many(spark, [i * 7 for i in range(8)], lambda i: f"GET /item/{301 + i}")
    assert [abuse.id_sweep(x).count() for x in (seven, eight)] == [0, 1]
    eleven = many(spark, [i * 5.5 for i in range(11)], lambda i: NAMES[i])
    twelve = many(spark, [0] + [i * 5.5 for i in range(1, 11)] + [60], lambda i: NAMES[i])
    late = many(spark, [0] + [i * 5.5 for i in range(1, 11)] + [60.001], lambda i: NAMES[i])
    assert [abuse.rate_burst(x).count() for x in (eleven, twelve, late)] == [0, 1, 0]


def test_unstamped_lines_count_for_templates_only(spark):
    text = "\n".join([f"{stamp(0)} job 1 ran", "job 2 ran", "job 3 ran", "job 4 ran", f"{stamp(70)} job 5 ran"])
    got = abuse.template_reuse(lines(spark, text)).first()
    assert (got["row"], got["lines"], got["minutes"]) == (1, 5, 2)
    assert rows_of(abuse.scan_totals(lines(spark, text)), "rows", "events") == [(5, 2)]


@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_windows_equal_brute_force(spark, partitions):
    rng = random.Random(5)
    rows = []
    for source in ("a", "b"):
        at = 0
        for n in range(1, 301):
            # Source b holds many lines on the same stamps.
            at += rng.choice([0, 0, 1, 40, 900, 5000]) if source == "b" else rng.randrange(4000)
            rows.append((source, n, at, f"x {rng.randrange(10, 60)} y {rng.randrange(10, 60)}"))
    width = 7000
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "source string, n long, ts_ms long, line string").repartition(partitions)
    counts, distinct = {}, {}
    for source, n, at, _ in rows:
        if (source, at) in counts:
            continue
        inside = [r for r in rows if r[0] == source and at <= r[2] <= at + width]
        counts[source, at] = (n, len(inside))
        distinct[source, at] = (n, len({t for r in inside for t in r[3].split() if t.isdigit()}))
    got = {(r["source"], r["ts_ms"]): (r["row"], r["events"]) for r in abuse.rate_burst(df, 1, width).collect()}
    assert got == counts
    got = {(r["source"], r["ts_ms"]): (r["row"], r["ids"]) for r in abuse.id_sweep(df, 1, width).collect()}
    assert got == distinct


@pytest.mark.parametrize("partitions", [1, 5])
def test_one_pass_gives_the_rows_of_the_single_signals(spark, partitions):
    """Three windows of different widths, stamps shared by many lines, lines without stamps, tokens used again and again."""
    rng, rows, at = random.Random(8), [], 0
    for n in range(1, 500):
        at += rng.choice([0, 0, 1, 700, 20_000, 90_000]) if n % 60 else 2_000_000
        word = rng.choice(["denied 403", "served", "served", "401 unauthorized"])
        rows.append((rng.choice("ab"), n, None if n % 17 == 0 else at, f"{word} user {rng.randrange(20)} item {rng.randrange(10, 40)}"))
    df = spark.createDataFrame(rows, "source string, n long, ts_ms long, line string").repartition(partitions)
    asked = {"rate": (3, 4_000), "auth": (2, 60_000), "sweep": (3, 25_000)}
    found = abuse.window_findings(df, **asked)
    got = {(r["kind"], r["source"], r["row"], r["detail"]) for r in found.collect()}
    want = set()
    for kind, single, column, words in (
        ("rate-burst", abuse.rate_burst(df, *asked["rate"]), "events", "timestamped lines"),
        ("auth-burst", abuse.auth_burst(df, *asked["auth"]), "events", "denied lines"),
        ("sweep", abuse.id_sweep(df, *asked["sweep"]), "ids", "distinct id tokens"),
    ):
        span = {"rate-burst": "4s", "auth-burst": "60s", "sweep": "25s"}[kind]
        mine = {(kind, r["source"], r["row"], f"line {r['row']} starts a {span} window with {r[column]} {words}") for r in single.collect()}
        assert mine
        want |= mine
    assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") <= 4 and plan.count("Scan ExistingRDD") == 1


@pytest.mark.parametrize("block_rows", [10, 64, 1000])
def test_rhythm_does_not_depend_on_blocks(spark, block_rows):
    rng = random.Random(9)
    at, rows = 0, []
    for n in range(1, 400):
        at += 1000 + rng.randrange(450)
        rows.append(("s", n, at if n % 41 else None, "x"))
    df = spark.createDataFrame(rows, "source string, n long, ts_ms long, line string").repartition(5)
    stamped = [r for r in rows if r[2] is not None]
    want = []
    for i in range(len(stamped) - 8):
        gaps = [stamped[j + 1][2] - stamped[j][2] for j in range(i, i + 8)]
        mean = sum(gaps) / 8
        if (sum((g - mean) ** 2 for g in gaps) / 8) ** 0.5 / mean < 0.15:
            want.append(stamped[i][1])
    got = abuse.machine_rhythm(df, block_rows=block_rows)
    assert sorted(r["row"] for r in got.collect()) == want
    assert want


def test_tasks_of_window_counts_grow_with_the_lines(spark, monkeypatch):
    said = many(spark, range(200), lambda i: f"GET /item/{10 + i % 70} by visitor {i % 7}").repartition(2)
    for count in (abuse.rate_burst, abuse.id_sweep, abuse.window_findings):
        whole = rows_of(count(said), "source", "row")
        assert whole
        with monkeypatch.context() as patch:
            patch.setattr(sizing, "TASK_ROWS", 10)
            got = count(said)
            assert got.rdd.getNumPartitions() >= 20
            assert rows_of(got, "source", "row") == whole


def test_lines_of_one_stamp_are_dealt_out(spark):
    said = many(spark, [0] * 400 + [1800 * k for k in range(4)], lambda i: f"403 for {100 + i}")
    assert rows_of(abuse.rate_burst(said, 2, 1000), "row", "events") == [(1, 401)]
    assert rows_of(abuse.auth_burst(said, 2, 1_800_000), "row", "events") == [(1, 402), (402, 2), (403, 2)]
    assert rows_of(abuse.id_sweep(said, 3, 1_800_000), "row", "ids") == [(1, 402), (402, 3), (403, 3)]
    parts = dealt(said, 40).groupBy(F.spark_partition_id()).count().collect()
    assert max(p["count"] for p in parts) < 200


def test_shuffles_of_shapes_and_gaps_grow_with_the_lines(spark, monkeypatch):
    """Shapes are counted and gaps searched in as many partitions as the lines need; a minute's lines of a shape are dealt out."""
    monkeypatch.setattr("sievelight.plans.sizing.TASK_ROWS", 10)
    rows = [("s", k, 1000 * k, f"GET /page{k % 3} ok") for k in range(1, 371)]
    lines = spark.createDataFrame(rows, "source string, n long, ts_ms long, line string")

    def dealt_by(found):
        plan = found._jdf.queryExecution().executedPlan().toString()
        return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"hashpartitioning\(([^)]*)\), REPARTITION_BY_NUM", plan)]

    shapes, gaps = abuse.template_reuse(lines), abuse.machine_rhythm(lines)
    assert {"source, shape, minute, deal, 37", "source, shape, minute, 37"} <= set(dealt_by(shapes))
    assert {"source, _block, 37", "source, block, 37"} <= set(dealt_by(gaps))
    assert [(r["row"], r["lines"], r["minutes"]) for r in shapes.collect()] == [(1, 370, 7)]
    assert sorted(r["row"] for r in gaps.collect()) == list(range(1, 363))
