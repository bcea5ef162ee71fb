"""Log triage: fingerprint, cluster, rank. `lines` has `source, line_no, line`, every physical line including blanks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievelight.functions import text as tx
from sievelight.functions.compat import trim
from sievelight.plans.blocks import BLOCK_ROWS, global_rank, max_before
from sievelight.plans.session import stored
from sievelight.plans.sizing import broadcast_if_small

# Lines above an entry that are shown with it.
BEFORE_LINES = 2
SEVERITIES = ("error", "warn", "info")


def head_lines(lines: DataFrame) -> DataFrame:
    """Lines that start an entry: `source, line_no, line, pattern, id, severity, key`.

    `id` is the short form that people read; `key`, the whole digest, is what patterns are told apart by.
    """
    line = F.col("line")
    return (
        lines.filter(tx.filled(line) & ~tx.is_continuation(line))
        .select("source", "line_no", "line", tx.normalize_line(line).alias("pattern"), tx.severity(line).alias("severity"))
        .withColumn("id", tx.fingerprint(F.col("pattern")))
        .withColumn("key", F.unhex(F.sha1(F.col("pattern"))))
    )


def entry_counts(lines: DataFrame) -> DataFrame:
    """One row per source, fingerprint and family: what patterns and families both count, from one pass over the lines.

    Numbers and the short family name only, so the counts stay in a hash aggregate. The family follows from the
    pattern; the severity does not, since it looks at the line as written.
    """
    level = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    stamped = F.when(tx.stamp_text(F.col("line")).isNotNull(), F.col("line_no"))
    problem = F.col("severity") != "info"
    return (
        head_lines(lines)
        .groupBy("source", "key", "id", tx.family_of(F.col("pattern")).alias("family"))
        .agg(
            F.count("*").alias("count"),
            F.min("line_no").alias("first_line"),
            F.max(stamped).alias("last_stamped"),
            F.min_by(level, "line_no").alias("level"),
            F.count_if(problem).alias("problem_lines"),
            F.min(F.when(problem, F.col("line_no"))).alias("first_problem"),
            F.count_if(F.col("severity") == "error").alias("error_lines"),
        )
    )


def _patterns(entries: DataFrame) -> DataFrame:
    """Entries by the whole digest of their pattern."""
    severity = F.get(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("level"))
    return (
        entries.groupBy("source", "key", "id")
        .agg(
            F.sum("count").alias("count"),
            F.min_by("level", "first_line").alias("level"),
            F.max("last_stamped").alias("last_stamped"),
            F.min("first_line").alias("first_line"),
        )
        .select("source", "id", "count", "first_line", "last_stamped", severity.alias("severity"), "key")
    )


def _families(entries: DataFrame) -> DataFrame:
    return (
        entries.filter(F.col("problem_lines") > 0)
        .groupBy("source", "family")
        .agg(
            F.sum("problem_lines").alias("lines"),
            F.min("first_problem").alias("first_line"),
            F.sum("error_lines").alias("errors"),
        )
        .select("source", "family", F.when(F.col("errors") > 0, "error").otherwise("warn").alias("severity"), "lines", "first_line")
    )


def pattern_counts(lines: DataFrame) -> DataFrame:
    """`source, id, count, first_line, last_stamped, severity, key`; the severity is the one of the first line."""
    return _patterns(entry_counts(lines))


def _cut(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.left(text, F.lit(chars))


def pattern_agg(
    lines: DataFrame, counts: DataFrame | None = None, pattern_chars: int | None = None, sample_chars: int | None = None
) -> DataFrame:
    """`source, id, severity, count, pattern, first_line, first_ts, last_ts, sample` per pattern.

    Texts are fetched once per pattern by line number, which is unique per source. The numbers wanted are broadcast when
    they are few, so that the log stays where it is. Patterns and samples are whole unless a number of characters is given.
    """
    counts = stored(pattern_counts(lines)) if counts is None else counts
    wanted = counts.select(
        "source",
        "key",
        F.explode(
            F.array(
                F.struct(F.lit("first").alias("role"), F.col("first_line").alias("line_no")),
                F.struct(F.lit("last").alias("role"), F.col("last_stamped").alias("line_no")),
            )
        ).alias("w"),
    ).select("source", "key", "w.role", "w.line_no")
    texts = (
        lines.join(broadcast_if_small(wanted.filter("line_no IS NOT NULL")), ["source", "line_no"])
        .groupBy("source", "key")
        .agg(
            F.max(F.when(F.col("role") == "first", F.col("line"))).alias("first_text"),
            F.max(F.when(F.col("role") == "last", F.col("line"))).alias("last_text"),
        )
    )
    first = F.col("first_text")
    return counts.join(texts, ["source", "key"]).select(
        "source",
        "id",
        "severity",
        "count",
        _cut(tx.normalize_line(first), pattern_chars).alias("pattern"),
        "first_line",
        tx.stamp_text(first).alias("first_ts"),
        tx.stamp_text(F.col("last_text")).alias("last_ts"),
        _cut(trim(first), sample_chars).alias("sample"),
    )


def attach_continuations(
    lines: DataFrame,
    max_lines: int | None = None,
    counts: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
    chars: int | None = None,
) -> DataFrame:
    """`source, line_no, stack`: continuation lines of the first entry of each pattern, `max_lines` at most if given.

    Entries without continuation lines are left out. A continuation belongs to the nearest entry above it;
    blank lines do not break the chain.
    """
    counts = stored(pattern_counts(lines)) if counts is None else counts
    line = F.col("line")
    continued = tx.is_continuation(line)
    slim = lines.filter(tx.filled(line)).select(
        "source",
        "line_no",
        F.when(continued, _cut(trim(line), chars)).alias("text"),
        continued.alias("continued"),
    )
    heads = F.when(~F.col("continued"), F.col("line_no"))
    tied = max_before(slim, ["source"], "line_no", heads, "head", block_rows).filter(
        F.col("continued") & F.col("head").isNotNull()
    )
    nth = F.row_number().over(Window.partitionBy("source", "head").orderBy("line_no"))
    firsts = counts.select("source", F.col("first_line").alias("head"))
    kept = tied.join(broadcast_if_small(firsts), ["source", "head"], "left_semi").withColumn("nth", nth)
    return (
        (kept if max_lines is None else kept.filter(F.col("nth") <= max_lines))
        .groupBy("source", "head")
        .agg(F.array_sort(F.collect_list(F.struct("nth", "text"))).alias("all"))
        .select("source", F.col("head").alias("line_no"), F.transform("all", lambda s: s["text"]).alias("stack"))
    )


def line_context(lines: DataFrame, before: int = BEFORE_LINES, anchors: DataFrame | None = None, chars: int | None = None) -> DataFrame:
    """`source, line_no, before`: the physical lines above each anchor, blanks removed.

    `anchors` is `source, line_no`, by default the first line of every pattern.
    """
    if anchors is None:
        anchors = stored(pattern_counts(lines).select("source", F.col("first_line").alias("line_no")))
    above = anchors.select(
        "source",
        F.col("line_no").alias("anchor"),
        F.explode(F.sequence(F.col("line_no") - before, F.col("line_no") - 1)).alias("line_no"),
    )
    texts = (
        lines.join(broadcast_if_small(above), ["source", "line_no"])
        .filter(tx.filled(F.col("line")))
        .groupBy("source", F.col("anchor").alias("line_no"))
        .agg(F.array_sort(F.collect_list(F.struct("line_no", _cut(trim(F.col("line")), chars).alias("text")))).alias("all"))
        .select("source", "line_no", F.transform("all", lambda s: s["text"]).alias("before"))
    )
    empty = F.array().cast("array<string>")
    return anchors.join(texts, ["source", "line_no"], "left").withColumn("before", F.coalesce("before", empty))


def family_agg(lines: DataFrame) -> DataFrame:
    """`source, family, severity, lines, first_line` of problem lines by the first two words of their pattern."""
    return _families(entry_counts(lines)).orderBy("source", F.desc("lines"), "first_line")


def rank_problems(patterns: DataFrame, numbered: bool = False) -> DataFrame:
    """Patterns that are no info: errors before warnings, then by count, then by first line.

    `numbered` adds `place` within the source.
    """
    problems = patterns.filter(F.col("severity") != "info").withColumn("_level", F.when(F.col("severity") == "error", 0).otherwise(1))
    keyed = problems.withColumn("_fewer", -F.col("count"))
    order = ["source", "_level", "_fewer", "first_line"]
    if not numbered:
        return keyed.orderBy(*order).drop("_level", "_fewer")
    ranked = global_rank(keyed, order, "_rank")
    starts = ranked.groupBy("source").agg(F.min("_rank").alias("_start"))
    placed = ranked.join(broadcast_if_small(starts), "source").withColumn("place", F.col("_rank") - F.col("_start") + 1)
    return placed.drop("_level", "_fewer", "_rank", "_start")


def new_vs_known(problems: DataFrame, known: DataFrame) -> DataFrame:
    """Adds `status`, known or new, by the id."""
    seen = known.select("id").distinct().withColumn("_seen", F.lit(True))
    status = F.when(F.col("_seen"), "known").otherwise("new")
    return problems.join(seen, "id", "left").withColumn("status", status).drop("_seen")


def triage(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Problem patterns with status, the lines above their first line and its continuation lines."""
    # Counted once and kept: the table is short, and three branches below start from it.
    counts = stored(pattern_counts(lines).filter(F.col("severity") != "info"))
    problems = new_vs_known(pattern_agg(lines, counts), known)
    anchors = counts.select("source", F.col("first_line").alias("line_no"))
    context = line_context(lines, anchors=anchors).withColumnRenamed("line_no", "first_line")
    stacks = attach_continuations(lines, counts=counts).withColumnRenamed("line_no", "first_line")
    joined = problems.join(context, ["source", "first_line"], "left").join(stacks, ["source", "first_line"], "left")
    empty = F.array().cast("array<string>")
    return joined.withColumn("stack", F.coalesce("stack", empty))


def triage_summary(lines: DataFrame) -> DataFrame:
    """`source, lines, patterns, problem_patterns, error_patterns, families, biggest_family` per log."""
    entries = stored(entry_counts(lines))
    patterns = _patterns(entries).groupBy("source").agg(
        F.sum("count").alias("lines"),
        F.count("*").alias("patterns"),
        F.count_if(F.col("severity") != "info").alias("problem_patterns"),
        F.count_if(F.col("severity") == "error").alias("error_patterns"),
    )
    families = _families(entries).groupBy("source").agg(F.count("*").alias("families"), F.max("lines").alias("biggest_family"))
    return patterns.join(families, "source", "left").na.fill(0, ["families", "biggest_family"])
