import random
import time

from helpers import details, kinds_at, rows_of, text_frame
from pyspark.sql import functions as F

from sievelight.operators import board as bd
from sievelight.operators import requirements as rq
from sievelight.operators import textaudit as ta
from sievelight.sources.corpus import read_md_table
from sievelight.sources.lines import lines_from_text

RUNBOOK = "# Runbook: move the buoy\n\n# purpose\nSafe water.\n\n### STEPS\n1. Row out.\n\n## Rollback\nRow back.\n"


def lines(spark, texts):
    return lines_from_text(text_frame(spark, texts))


def test_planted_runbook(spark):
    bad = RUNBOOK.replace("Safe water.", "We Leverage the buoy.").replace("## Rollback", "Rollback").replace("Row out.", "z" * 121)
    found = ta.text_findings(lines(spark, bad))
    assert kinds_at(found) == {"jargon": [4], "long-line": [7], "missing-section": [None]}
    assert "buoy" not in details(found)
    assert "the buoy" in details(ta.jargon(lines(spark, bad), include_text=True))


def test_clean_runbook_and_notes_are_silent(spark):
    assert ta.text_findings(lines(spark, {"a": RUNBOOK, "b": "# Notes\nshort\n" + "x" * 120})).count() == 0


def test_phrases(spark):
    found = ta.jargon(lines(spark, "Please CIRCLE   back\nrobustness\na robust, seamless deep dive\nstate-of-the-art"))
    assert rows_of(found, "row", "key") == [(1, "circle back"), (3, "deep dive"), (3, "robust"), (3, "seamless"), (4, "state-of-the-art")]


def test_long_lists_of_phrases_give_the_same_rows(spark, monkeypatch):
    """Hyphens, spaces, marks at the ends, other scripts, phrases inside phrases and inside words, and a sign that lower-cases to k."""
    rng = random.Random(6)
    words = ["deep", "dive", "Deep", "state-of", "the", "art", "c++", "+x", "m\u00fcll", "caf\u00e9", "\u05e9\u05dc", "\u212aeel", "keel", "a_b", "9"]
    phrases = ["deep dive", "deep", "state-of-the-art", "state of the art", "c++", "+x", "m\u00fcll", "\u05e9\u05dc", "eel", "keel", "a_b 9", "dive deep dive", "caf\u00e9", "the", "++"]
    joints = [" ", "  ", "-", ", ", "\t", "\u00a0", "", "."]
    text = "\n".join("".join(rng.choice(words) + rng.choice(joints) for _ in range(rng.randrange(1, 9))) for _ in range(400))
    df = lines(spark, text)
    want = rows_of(ta.jargon(df, phrases, True), "row", "key", "detail")
    assert len({w[1] for w in want}) > 9
    monkeypatch.setattr(ta, "FEW", 3)
    assert rows_of(ta.jargon(df, phrases, True), "row", "key", "detail") == want
    assert rows_of(ta.text_findings(df, phrases=phrases).filter("kind = 'jargon'"), "row", "key") == [w[:2] for w in want]


def test_thousands_of_phrases_cost_little_more_than_a_few(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(3_000)]
    phrases = list(dict.fromkeys(" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3]))) + " zz" for _ in range(5_000)))
    rows = [("s", n, " ".join(rng.choices(vocabulary, k=12)) + (f" {rng.choice(phrases)}" if n % 50 == 0 else "")) for n in range(20_000)]
    df = spark.createDataFrame(rows, "source string, line_no long, line string")

    def seconds(some):
        start = time.time()
        assert ta.jargon(df, some).count() >= 0
        return time.time() - start

    seconds(phrases[:16]), seconds(phrases)
    # The least of three: other work on the machine only adds.
    assert min(seconds(phrases) for _ in range(3)) < 2 * min(seconds(phrases[:16]) for _ in range(3)) + 1.5
    got = {(r["row"], r["key"]) for r in ta.jargon(df, phrases).collect()}
    want = {(n, p) for _, n, line in rows if n % 50 == 0 for p in [" ".join(line.split()[k:]) for k in range(13)] if p in set(phrases)}
    assert want <= got and len(want) >= 400


HEADER = "| ID | Status | Scorecard row | What | Done when | Owner role | Evidence |\n|---|---|---|---|---|---|---|\n"
PROOFS = "F2P: a fails. P2P: b passes"


def board(spark, *rows):
    return read_md_table(lines(spark, "# Board\nBLOCKED talk\n" + HEADER + "".join(f"| {' | '.join(r)} |\n" for r in rows)))


def test_planted_board(spark):
    items = board(
        spark,
        ("K-1", "READY", "Speed", "a", PROOFS, "cook", ""),
        ("K-2", "READY", "Speed", "b", "P2P: b", "cook", ""),
        ("K-3", "READY", "Speed", "c", "F2P: a", "cook", ""),
        ("K-4", "done", "Speed", "d", PROOFS, "cook", ""),
        ("K-5", "BLOCKED", "", "e", PROOFS, "", ""),
        ("", "READY", "", "", "", "", ""),
    )
    assert items.count() == 5
    assert rows_of(bd.board_findings(items), "kind", "key", "row") == [
        ("blocked-without-next", "K-5", 9),
        ("done-without-evidence", "K-4", 8),
        ("missing-f2p", "K-2", 6),
        ("missing-owner", "K-5", 9),
        ("missing-p2p", "K-3", 7),
        ("missing-scorecard", "K-5", 9),
    ]


def test_clean_board_is_silent(spark):
    items = board(
        spark,
        ("K-1", "READY", "Speed", "a", PROOFS, "cook", ""),
        ("K-2", "DONE", "Speed", "b", PROOFS, "cook", "seen in log 4"),
        ("K-3", "BLOCKED", "Speed", "c", PROOFS, "cook", "waits for paint; next: ask"),
    )
    assert bd.board_findings(items).count() == 0


SPEC = """\
# Spec: label printer

- A batch must hold at most 40 labels per page.
- Printing must be quick.
- The user can upload a logo of up to 3 MB.
* A jam is retried 2 times before the lamp turns red.
- The panel should be intuitive.
- Existing templates must stay unchanged.

F2P: print --batch 41 fails
P2P: pytest tests/print
"""


def plan(spark, text):
    log = lines(spark, text)
    reqs = rq.parse_requirements(log)
    return reqs, rq.plan_cases(reqs), rq.parse_proofs(log)


def test_planted_spec(spark):
    reqs, cases, proofs = plan(spark, SPEC)
    assert rows_of(reqs, "position", "id", "line_no")[:2] == [(1, "R1", 3), (2, "R2", 4)]
    assert rows_of(rq.requirement_flags(reqs), "kind", "key") == [("untestable", "R2"), ("untestable", "R5")]
    row = rq.coverage(reqs, cases, proofs).first()
    assert (row["requirements"], row["boundary"], row["regression"], row["flagged"], row["uncovered"], row["proof_lines"]) == (6, 9, 1, 2, 0, 2)
    # Six positive, five or six negative, nine boundary and one regression case.
    assert row["cases"] == 6 + row["negative"] + 9 + 1
    by_case = {r["case"]: r for r in cases.collect()}
    assert by_case["T2.1"]["expect"].startswith("blocked")
    assert [by_case[f"T1.b{i}"]["expect"] for i in (1, 2, 3)] == ["accepted", "accepted", "rejected or flagged"]
    assert by_case["T3.b3"]["check"].startswith("Use 4 MB (above the limit 3): ")
    assert by_case["T1.b1"]["check"].startswith("Use 39 (below the limit 40): ")
    assert by_case["T4.b2"]["check"].startswith("Use 2 times (at the limit 2): ")


def test_clean_spec_labels_and_years(spark):
    text = (
        "1. The page answers HTTP 204 for a known cookie.\n"
        "2) The list loads within 1.5 seconds for up to 900 rows.\n"
        '- The heading reads "Print queue".\n'
        "Requirement: A scrapped label never returns (rule 7, since 2019).\n"
        "| AB-1 | Five kits are ready | `n >= 5` |\n| AB-2 | Reply time TBD | none |\n| x | y | z |\n"
        "- n <= 5 files\n"
    )
    reqs, cases, _ = plan(spark, text)
    assert rows_of(reqs, "position", "id", "proof") == [
        (1, "R1", ""), (2, "R2", ""), (3, "R3", ""), (4, "R4", ""), (5, "AB-1", "n >= 5"), (6, "AB-2", "none"), (7, "R7", ""),
    ]
    assert rows_of(rq.requirement_flags(reqs), "kind", "key") == [("incomplete", "AB-2")]
    limits = cases.filter("type = 'boundary'").groupBy("req").count()
    assert rows_of(limits, "req", "count") == [("R2", 6), ("R4", 3), ("R7", 3)]
    checks = {r["case"]: r["check"].split(":")[0] for r in cases.collect()}
    assert checks["T2.b1"] == "Use 1.4 seconds (below the limit 1.5)"
    assert checks["T2.b6"] == "Use 901 rows (above the limit 900)"
    last = {r["case"]: r["expect"] for r in cases.filter("req = 'R7'").collect()}
    assert last["T7.b3"] == "rejected or flagged"


def test_positions_do_not_depend_on_blocks(spark):
    text = "\n".join(f"- item {i}" if i % 3 else "talk" for i in range(100))
    log = lines(spark, {"a": text, "b": text}).repartition(6)
    want = rows_of(rq.parse_requirements(log), "source", "position", "line_no")
    assert rows_of(rq.parse_requirements(log, block_rows=7), "source", "position", "line_no") == want
    assert [r[1] for r in want if r[0] == "a"] == list(range(1, 67))


def test_uncovered_requirements_are_counted(spark):
    reqs, cases, _ = plan(spark, SPEC)
    assert rq.coverage(reqs, cases.filter(F.col("req") != "R4")).first()["uncovered"] == 1


def test_flags_count_ids_and_block_later_requirements(spark):
    rows = [("s", 1, "AB-1", "Be fast", "", 1), ("s", 2, "AB-1", "Be quick", "", 2), ("s", 3, "AB-1", "Add a name of 5 signs", "", 3)]
    reqs = spark.createDataFrame(rows, "source string, position long, id string, text string, proof string, line_no long")
    cases = rq.plan_cases(reqs)
    assert rq.coverage(reqs, cases).first()["flagged"] == 1
    expect = {r["case"]: r["expect"] for r in cases.collect()}
    assert expect["T3.1"] == expect["T1.1"] != "requirement holds"
