"""Text corpus audit over `lines(source, line_no, line)`; `source` is the document."""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.compat import ascii_regex, is_ascii, matches, regex, trim
from sievelight.operators.findings import HITS_TYPE, as_findings, from_hits, hit, hits, text, union_findings
from sievelight.plans.spread import explode_once

# Phrases, line limit, and the sections a runbook needs.
JARGON = (
    "leverage",
    "utilize",
    "synergy",
    "synergies",
    "paradigm",
    "seamless",
    "robust",
    "cutting-edge",
    "state-of-the-art",
    "circle back",
    "deep dive",
    "bandwidth",
    "move the needle",
    "learnings",
    "ideate",
    "disruptive",
)
#: Phrases that are matched one by one at most.
FEW = 64
LONG_LINE = 120
RUNBOOK = "runbook"
SECTIONS = ("Purpose", "Steps", "Rollback")


def _literal(words: str) -> str:
    """Pattern of a phrase with flexible spacing."""
    return r"\s+".join(re.escape(w).replace(r"\-", "-") for w in words.split())


def _jargon_hits(phrases: Sequence[str], include_text: bool) -> Column:
    """The phrases are part of the expression, not a table to join; most lines end at the first test."""
    line = F.col("line")
    any_of = "|".join(_literal(p) for p in phrases)
    checks = []
    for phrase in phrases:
        detail = text("line ", F.col("line_no"), f' uses banned jargon "{phrase}"')
        if include_text:
            detail = F.concat(detail, F.lit(": "), trim(line))
        found = hit("jargon", detail, F.col("line_no"), F.lit(phrase))
        checks.append((matches(line, rf"\b{_literal(phrase)}\b", "i"), found))
    return F.when(matches(line, any_of, "i"), hits(*checks)).otherwise(F.array().cast(HITS_TYPE))


def _long_hits(limit: int) -> Column:
    size = F.length("line")
    detail = text("line ", F.col("line_no"), " is ", size, f" chars (limit {limit})")
    return hits((size > limit, hit("long-line", detail, F.col("line_no"))))


def _runs(phrase: str) -> list[str]:
    """The runs of ASCII word characters of a phrase, lower-cased. Where the phrase occurs, each is a whole run of the line."""
    return re.findall("[a-z0-9_]+", re.sub("[A-Z]", lambda m: m.group().lower(), phrase))


def _quoted(keys: Iterable[str]) -> str:
    return ", ".join(f"'{k}'" for k in sorted(set(keys)))


def _phrase_hits(lines: DataFrame, phrases: Sequence[str], include_text: bool) -> DataFrame:
    """The same findings for long lists: what a line costs does not depend on the number of phrases.

    A line's word runs are looked up in the set of first runs, the few that are in it start n-grams as long as phrases are,
    and those are looked up in the set of phrases. Only phrases that pass are matched against their line.
    """
    keyed = [(" ".join(runs), p, rf"\b{_literal(p)}\b") for p in phrases if (runs := _runs(p))]
    lengths = ", ".join(str(n) for n in sorted({len(_runs(p)) for _, p, _ in keyed}))
    words = F.regexp_extract_all(F.translate("line", string.ascii_uppercase, string.ascii_lowercase), F.lit("[a-z0-9_]+"), F.lit(0))
    worded = lines.select("source", "line_no", "line", words.alias("words"))
    # Keys hold letters, digits, lines and spaces only. As one text they reach Spark in one call, and a long list is a hash set there.
    heads = f"filter(sequence(1, greatest(size(words), 1)), k -> get(words, k - 1) IN ({_quoted(k.split(' ', 1)[0] for k, _, _ in keyed)}))"
    grams = f"flatten(transform({heads}, k -> transform(array({lengths}), n -> array_join(slice(words, k, n), ' '))))"
    known = F.expr(f"array_distinct(filter({grams}, g -> g IN ({_quoted(k for k, _, _ in keyed)})))")
    table = lines.sparkSession.createDataFrame([(k, p, ascii_regex(r, "i"), regex(r, "i")) for k, p, r in keyed], "gram string, phrase string, plain string, wide string")
    met = explode_once(worded, known, "gram", "source", "line_no", "line").join(F.broadcast(table), "gram")
    met = met.filter(F.when(is_ascii(F.col("line")), F.rlike("line", F.col("plain"))).otherwise(F.rlike("line", F.col("wide"))))
    detail = text("line ", F.col("line_no"), ' uses banned jargon "', F.col("phrase"), '"')
    detail = F.concat(detail, F.lit(": "), trim(F.col("line"))) if include_text else detail
    return as_findings(met, "jargon", detail, F.col("line_no"), F.col("phrase"))


def jargon(lines: DataFrame, phrases: Sequence[str] = JARGON, include_text: bool = False) -> DataFrame:
    """One finding per banned phrase per line. Lists longer than FEW are looked up instead of matched one by one."""
    if len(phrases) <= FEW:
        return from_hits(lines, _jargon_hits(phrases, include_text))
    # A phrase without a word run can't be looked up.
    odd = [p for p in phrases if not _runs(p)]
    found = _phrase_hits(lines, [p for p in phrases if _runs(p)], include_text)
    return union_findings([found, from_hits(lines, _jargon_hits(odd, include_text))]) if odd else found


def long_line(lines: DataFrame, limit: int = LONG_LINE) -> DataFrame:
    return from_hits(lines, _long_hits(limit))


def _heading(section: str) -> Column:
    return matches(F.col("line"), rf"^#{{1,3}}\s*{_literal(section)}\b", "i")


def missing_section(lines: DataFrame, trigger: str = RUNBOOK, required: Sequence[str] = SECTIONS) -> DataFrame:
    """Documents that mention the trigger word need a heading, level 1 to 3, for each required section."""
    found = [F.bool_or(_heading(s)).alias(f"s{i}") for i, s in enumerate(required)]
    docs = lines.groupBy("source").agg(F.bool_or(matches(F.col("line"), _literal(trigger), "i")).alias("asked"), *found)
    lacking = F.filter(
        F.array(*[F.when(~F.col(f"s{i}"), F.lit(s)) for i, s in enumerate(required)]), lambda s: s.isNotNull()
    )
    missing = docs.filter("asked").select("source", F.explode(lacking).alias("section"))
    return as_findings(missing, "missing-section", text("runbook is missing a ", F.col("section"), " section"), key=F.col("section"))


def text_findings(
    lines: DataFrame,
    include_text: bool = False,
    phrases: Sequence[str] = JARGON,
    limit: int = LONG_LINE,
    trigger: str = RUNBOOK,
    required: Sequence[str] = SECTIONS,
) -> DataFrame:
    """All three checks; the two within a line share a scan, unless the list of phrases is long."""
    if len(phrases) > FEW:
        return union_findings([jargon(lines, phrases, include_text), long_line(lines, limit), missing_section(lines, trigger, required)])
    in_line = F.concat(_jargon_hits(phrases, include_text), _long_hits(limit))
    return union_findings([from_hits(lines, in_line), missing_section(lines, trigger, required)])
