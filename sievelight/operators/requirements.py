"""Requirement mining over spec lines `source, line_no, line`; `source` is the spec."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.compat import extracted, half_up, matches, regex, trim
from sievelight.functions.html import match_spans
from sievelight.functions.text import collapse
from sievelight.operators.findings import as_findings
from sievelight.plans.blocks import BLOCK_ROWS, dense_index

# Line shapes, word lists, units and expectations.
HEADING = r"^#{1,6}\s"
PROOF_LINE = r"^(?:[-*•]\s*)?(F2P|P2P)\s*:\s*(.+)$"
ITEM_LINE = r"^(?:[-*•]|\d+[.)]|REQ[-\w]*:|Requirement:)\s*(.+)$"
TABLE_ID = r"^[A-Z]{1,4}-?\d+$"
VAGUE = (
    r"\b(fast|quick(?:ly)?|slow|easy|easily|simple|user[- ]friendly|intuitive|robust|scalable|flexible"
    r"|appropriate(?:ly)?|reasonable|as needed|if necessary|etc\.?|and so on|some|several|many|few|good|better|best"
    r"|efficient(?:ly)?|seamless(?:ly)?|modern|clean|properly|correctly|sufficient|minimal|every day|regularly|soon)\b"
)
INCOMPLETE = r"\b(tbd|todo|to be decided|to be defined|fill me)\b"
INPUTY = (
    r"\b(input|enter|submit|upload|accept|validate|create|add|set|type|paste|select|import|send|login|log in|search"
    r"|filter|name|value|field|form|file)\b"
)
REGRESSION = (
    r"\b(existing|still|unchanged|keep|keeps|retain|preserve|without breaking|no longer|stay|stays|remains?)\b"
)
AT_MOST = (
    r"\b(at most|no more than|up to|max(?:imum)?|not exceed|under|below|within|less than|fewer than)\b|(<=?|≤)\s*\d"
)
AT_LEAST = r"\b(at least|no fewer than|min(?:imum)?|more than|over|above|greater than)\b|(>=?|≥)\s*\d"
EXACT = r"\b(exactly|only|precisely)\b"
QUOTES = "\"'“”‘’"
QUOTED = rf"[{QUOTES}][^{QUOTES}]{{2,}}[{QUOTES}]"
MEASURED_PROOF = r"\d|>=|<=|===?|\btrue\b"
NUMBER = r"(\d+(?:\.\d+)?)\s*(%|[A-Za-z]{1,12})?"
LABEL_BEFORE = r"(?:http|status|code|error|version|v|id|#)\s*$"
LABEL_REACH = 8
UNITS = (
    r"^(mb|kb|gb|ms|s|sec|seconds?|minutes?|min|hours?|h|days?|items?|times|rows?|chars?|characters|%|px|pages?"
    r"|retries|attempts|users?|files?|lines?)$"
)
YEARS = (1900, 2100)
ACCEPTED, REJECTED, NEAREST = "accepted", "rejected or flagged", "behaves as the nearest valid case"
EXPECTED = {
    "atmost": (ACCEPTED, ACCEPTED, REJECTED),
    "atleast": (REJECTED, ACCEPTED, ACCEPTED),
    "exact": (REJECTED, ACCEPTED, REJECTED),
    "around": (NEAREST, ACCEPTED, NEAREST),
}
BLOCKED = "blocked: the requirement needs a measurable criterion first"
HOLDS = "requirement holds"
FAILS_CLEANLY = "fails cleanly: clear message, nothing half-done"
SAME_RESULTS = "same results as before the change (P2P)"


def _says(col: Column, pattern: str) -> Column:
    return matches(col, pattern, "i")


def _plain(col: Column) -> Column:
    """Text without code and bold marks, spacing collapsed."""
    return collapse(F.regexp_replace(col, r"`|\*\*", ""))


def _cells(line: Column) -> Column:
    parts = F.split(line, r"\|", -1)
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.transform(inner, trim)


def _trimmed(lines: DataFrame) -> DataFrame:
    kept = lines.select("source", "line_no", trim(F.col("line")).alias("line"))
    return kept.filter((F.col("line") != "") & ~F.col("line").rlike(regex(HEADING)))


def parse_proofs(lines: DataFrame) -> DataFrame:
    """`source, line_no, kind, text` of F2P and P2P lines."""
    line = F.col("line")
    return _trimmed(lines).filter(_says(line, PROOF_LINE)).select(
        "source",
        "line_no",
        F.upper(extracted(line, PROOF_LINE, "i", 1)).alias("kind"),
        _plain(extracted(line, PROOF_LINE, "i", 2)).alias("text"),
    )


def parse_requirements(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`source, position, id, text, line_no, proof` from bullets, numbered lines, REQ lines and table rows.

    Lines without an id of their own are named `R<position>`; positions count per spec.
    """
    line = F.col("line")
    table = line.startswith("|")
    cells = _cells(line)
    is_row = table & (F.size(cells) >= 2) & F.get(cells, F.lit(0)).rlike(regex(TABLE_ID))
    parsed = (
        _trimmed(lines)
        .filter(is_row | (~table & _says(line, ITEM_LINE) & ~_says(line, PROOF_LINE)))
        .select(
            "source",
            "line_no",
            F.when(table, F.get(cells, F.lit(0))).alias("own_id"),
            F.when(table, _plain(F.get(cells, F.lit(1)))).otherwise(_plain(extracted(line, ITEM_LINE, "i", 1))).alias("text"),
            F.when(table, _plain(F.coalesce(F.get(cells, F.lit(2)), F.lit("")))).otherwise("").alias("proof"),
        )
    )
    placed = dense_index(parsed, ["source"], "line_no", "at", block_rows).withColumn("position", F.col("at") + 1)
    own = F.coalesce("own_id", F.concat(F.lit("R"), F.col("position")))
    return placed.select("source", "position", own.alias("id"), "text", "line_no", "proof")


def flag_kind(text: Column, proof: Column) -> Column:
    """incomplete, untestable, or NULL for a requirement that can be tested as written."""
    measurable = text.rlike(r"\d") | text.rlike(QUOTED) | F.coalesce(proof, F.lit("")).rlike(regex(MEASURED_PROOF))
    return F.when(_says(text, INCOMPLETE), "incomplete").when(_says(text, VAGUE) & ~measurable, "untestable")


def requirement_flags(reqs: DataFrame) -> DataFrame:
    """Findings for requirements nobody can test as written; the detail names the listed word that was used."""
    body = F.col("text")
    kind = flag_kind(body, F.col("proof"))
    word = F.when(F.col("flag") == "incomplete", extracted(body, INCOMPLETE, "i", 0)).otherwise(
        extracted(body, VAGUE, "i", 0)
    )
    flagged = reqs.withColumn("flag", kind).filter(F.col("flag").isNotNull())
    detail = F.when(F.col("flag") == "incomplete", F.concat(F.lit('says "'), word, F.lit('"'))).otherwise(
        F.concat(F.lit('"'), word, F.lit('" with no number or example'))
    )
    return as_findings(flagged, F.col("flag"), detail, F.col("line_no"), F.col("id"))


def _case(suffix: str | Column, kind: str, check: Column, expect: Column) -> Column:
    suffix = F.lit(suffix) if isinstance(suffix, str) else suffix
    case_id = F.concat(F.lit("T"), F.col("position").cast("string"), F.lit("."), suffix)
    return F.struct(case_id.alias("case"), F.lit(kind).alias("type"), check.alias("check"), expect.alias("expect"))


def _exploded(reqs: DataFrame, cases: Column) -> DataFrame:
    return reqs.select("source", "position", F.col("id").alias("req"), F.explode(cases).alias("c")).select(
        "source", "position", "req", "c.*"
    )


def expand_cases(reqs: DataFrame) -> DataFrame:
    """`source, position, req, case, type, check, expect`: positive, negative and regression cases.

    A requirement is blocked by a flag of its own or of an earlier one with its id.
    """
    own = F.when(flag_kind(F.col("text"), F.col("proof")).isNotNull(), F.col("position"))
    first = Window.partitionBy("source", "id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reqs = reqs.withColumn("_blocked", F.min(own).over(first).isNotNull())
    body = F.col("text")
    inputy, regression = _says(body, INPUTY), _says(body, REGRESSION)
    blocked = F.col("_blocked")
    setting = F.when(inputy, "With empty, malformed or oversized input, verify: ").otherwise(
        "With the precondition missing, verify: "
    )
    cases = F.array(
        _case("1", "positive", F.concat(F.lit("With a typical valid input, verify: "), body), F.when(blocked, BLOCKED).otherwise(HOLDS)),
        F.when(inputy | ~regression, _case("2", "negative", F.concat(setting, body), F.lit(FAILS_CLEANLY))),
        F.when(
            regression,
            _case(
                "r",
                "regression",
                F.concat(F.lit("Re-run the checks that guarded this area before the change and compare: "), body),
                F.lit(SAME_RESULTS),
            ),
        ),
    )
    return _exploded(reqs, F.filter(cases, lambda c: c.isNotNull()))


def _shown(value: Column, digits: int) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(value.cast(f"decimal(38,{digits})").cast("string"), r"\.?0+\z", "")


def _limits(body: Column) -> Column:
    """Numbers of a requirement that are limits: struct(value, unit)."""

    def read(m: Column) -> Column:
        unit = F.regexp_extract(m["match"], NUMBER, 2)
        reach = F.greatest(m["start"] - LABEL_REACH, F.lit(1))
        return F.struct(
            F.regexp_extract(m["match"], NUMBER, 1).cast("double").alias("value"),
            unit.alias("unit"),
            F.substring(body, reach, m["start"] - reach).alias("lead"),
        )

    def is_limit(m: Column) -> Column:
        year = (m["value"] > YEARS[0]) & (m["value"] < YEARS[1]) & (m["unit"] == "")
        return ~year & ~_says(m["lead"], LABEL_BEFORE)

    return F.filter(F.transform(match_spans(body, NUMBER), read), is_limit)


def boundary_cases(reqs: DataFrame) -> DataFrame:
    """Below, at and above every limit, with the same columns as `expand_cases`."""
    body = F.col("text")
    relation = (
        F.when(_says(body, AT_MOST), "atmost").when(_says(body, AT_LEAST), "atleast").when(_says(body, EXACT), "exact").otherwise("around")
    )
    table = F.create_map(*[x for k, v in EXPECTED.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))])
    expected = F.col("expected")

    def around(m: Column, at: Column) -> Column:
        step = F.when(m["value"] == F.floor(m["value"]), 1.0).otherwise(0.1)
        unit = F.when(_says(m["unit"], UNITS), F.concat(F.lit(" "), m["unit"])).otherwise("")
        rows = []
        for i, where in enumerate(("below", "at", "above")):
            shown = _shown(half_up((m["value"] + (i - 1) * step) * 100) / 100, 2)
            check = F.concat(
                F.lit("Use "), shown, unit, F.lit(f" ({where} the limit "), _shown(m["value"], 10), F.lit("): "), body
            )
            number = F.concat(F.lit("b"), (at * 3 + i + 1).cast("string"))
            rows.append(_case(number, "boundary", check, F.get(expected, F.lit(i))))
        return F.array(*rows)

    prepared = reqs.withColumn("expected", F.element_at(table, relation))
    return _exploded(prepared, F.flatten(F.transform(_limits(body), around)))


def plan_cases(reqs: DataFrame) -> DataFrame:
    return expand_cases(reqs).unionByName(boundary_cases(reqs))


def coverage(reqs: DataFrame, cases: DataFrame, proofs: DataFrame | None = None) -> DataFrame:
    """`source, requirements, cases, negative, boundary, regression, flagged, uncovered, proof_lines` per spec."""
    types = ("negative", "boundary", "regression")
    per_req = cases.groupBy("source", F.col("req").alias("id")).agg(
        F.count("*").alias("cases"), *[F.count_if(F.col("type") == t).alias(t) for t in types]
    )
    flagged = flag_kind(F.col("text"), F.col("proof")).isNotNull()
    facts = reqs.select(
        "source",
        "id",
        F.lit(1).alias("requirements"),
        flagged.cast("int").alias("flagged"),
        (F.col("proof") != "").cast("int").alias("proof_lines"),
    )
    # An id can name several requirements; its cases are counted once.
    per_id = facts.groupBy("source", "id").agg(F.sum("requirements").alias("requirements"), F.max("flagged").alias("flagged"), F.sum("proof_lines").alias("proof_lines"))
    parts = per_id.join(per_req, ["source", "id"], "left").withColumn(
        "uncovered", F.when(F.col("cases").isNull(), F.col("requirements"))
    )
    if proofs is not None:
        parts = parts.unionByName(proofs.select("source", F.lit(1).alias("proof_lines")), allowMissingColumns=True)
    names = ("requirements", "cases", *types, "flagged", "uncovered", "proof_lines")
    return parts.groupBy("source").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
