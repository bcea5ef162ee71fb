"""Abuse signals in event logs: `lines` has `source, n, ts_ms, line`, one row per non-blank line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions import text as tx
from sievelight.operators.findings import as_findings, first_per_kind, text, union_findings
from sievelight.plans.blocks import BLOCK_ROWS, dense_index
from sievelight.plans.sizing import tasks_for
from sievelight.plans.spread import explode_once
from sievelight.plans.windows import DEALS, dealt, forward_counts, forward_distinct, tagged_counts

# Default thresholds.
RATE_EVENTS, RATE_WINDOW_MS = 12, 60_000
RHYTHM_GAPS, RHYTHM_CV = 8, 0.15
TEMPLATE_LINES, TEMPLATE_MINUTES = 5, 2
AUTH_LINES, AUTH_WINDOW_MS = 4, 300_000
SWEEP_IDS, SWEEP_WINDOW_MS = 8, 120_000


def rate_burst(lines: DataFrame, n: int = RATE_EVENTS, window_ms: int = RATE_WINDOW_MS) -> DataFrame:
    """Stamps whose following window holds `n` or more stamped lines: `source, row, ts_ms, events`.

    `row` is the first line on the stamp.
    """
    return _burst(lines, n, window_ms, tasks_for(lines))


def _burst(lines: DataFrame, n: int, window_ms: int, tasks: int) -> DataFrame:
    counted = forward_counts(lines, window_ms, tasks)
    return counted.filter(F.col("total") >= n).select("source", "row", "ts_ms", F.col("total").alias("events"))


def auth_burst(
    lines: DataFrame, n: int = AUTH_LINES, window_ms: int = AUTH_WINDOW_MS, pattern: str = tx.DENIED
) -> DataFrame:
    """The same for denied lines only: `source, row, ts_ms, events`."""
    return _burst(lines.filter(tx.is_denied(F.col("line"), pattern)), n, window_ms, tasks_for(lines))


def id_sweep(lines: DataFrame, n: int = SWEEP_IDS, window_ms: int = SWEEP_WINDOW_MS) -> DataFrame:
    """Stamps whose following window shows `n` or more distinct id tokens: `source, row, ts_ms, ids`."""
    tokens = explode_once(lines, tx.id_tokens(F.col("line")), "token", "source", "n", "ts_ms")
    counted = forward_distinct(tokens, window_ms, tasks_for(lines))
    return counted.filter(F.col("total") >= n).select("source", "row", "ts_ms", F.col("total").alias("ids"))


def machine_rhythm(
    lines: DataFrame, run: int = RHYTHM_GAPS, max_cv: float = RHYTHM_CV, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Lines that start `run` near-identical gaps, in line order: `source, row, mean_gap, cv`.

    A gap back in time disqualifies its runs. Stamped lines are numbered densely, cut into blocks, and
    each block also sees the first lines of the next one. Blocks are dealt to as many partitions as the lines need.
    """
    tasks = tasks_for(lines)
    stamped = lines.filter(F.col("ts_ms").isNotNull()).select("source", "n", "ts_ms")
    indexed = dense_index(stamped, ["source"], "n", "idx", block_rows, tasks)
    home = F.floor(F.col("idx") / F.lit(block_rows))
    blocks = F.when(F.col("idx") % block_rows <= run, F.array(home, home - 1)).otherwise(F.array(home))
    in_order = Window.partitionBy("source", "block").orderBy("idx")
    ahead = in_order.rowsBetween(Window.currentRow, run - 1)
    gap = F.col("gap")
    return (
        indexed.withColumn("block", F.explode(blocks))
        .repartition(tasks, "source", "block")
        .withColumn("gap", F.lead("ts_ms").over(in_order) - F.col("ts_ms"))
        .withColumn("gaps", F.count(gap).over(ahead))
        .withColumn("smallest", F.min(gap).over(ahead))
        .withColumn("mean_gap", F.avg(gap).over(ahead))
        .withColumn("spread", F.stddev_pop(gap).over(ahead))
        .filter(F.col("block") == home)
        .filter((F.col("gaps") == run) & (F.col("smallest") >= 0) & (F.col("mean_gap") > 0))
        .withColumn("cv", F.col("spread") / F.col("mean_gap"))
        .filter(F.col("cv") < max_cv)
        .select("source", F.col("n").alias("row"), "mean_gap", "cv")
    )


def template_reuse(lines: DataFrame, n: int = TEMPLATE_LINES, min_buckets: int = TEMPLATE_MINUTES) -> DataFrame:
    """Shapes used by `n` or more lines over enough minutes: `source, row, lines, minutes`.

    Unstamped lines are members of a shape but name no minute. Lines are counted in as many partitions as they need, so
    what a task counts doesn't grow with the input; a minute's lines of one shape are dealt out before they meet.
    """
    tasks = tasks_for(lines)
    shapes = lines.select(
        "source",
        "n",
        tx.shape_of(F.col("line")).alias("shape"),
        F.floor(F.col("ts_ms") / 60_000).alias("minute"),
        F.pmod(F.xxhash64("n"), F.lit(DEALS)).alias("deal"),
    )
    keys = ["source", "shape", "minute"]
    dealt_out = shapes.filter(F.col("shape") != "").repartition(tasks, *keys, "deal").groupBy(*keys, "deal")
    parts = dealt_out.agg(F.count("*").alias("lines"), F.min("n").alias("row")).repartition(tasks, *keys)
    per_minute = parts.groupBy(*keys).agg(F.sum("lines").alias("lines"), F.min("row").alias("row"))
    return (
        per_minute.groupBy("source", "shape")
        .agg(F.min("row").alias("row"), F.sum("lines").alias("lines"), F.count("minute").alias("minutes"))
        .filter((F.col("lines") >= n) & (F.col("minutes") >= min_buckets))
        .select("source", "row", "lines", "minutes")
    )


def _span(window_ms: int) -> str:
    seconds = window_ms // 1000
    return f"{seconds // 60}min" if seconds >= 120 and seconds % 60 == 0 else f"{seconds}s"


def window_findings(
    lines: DataFrame,
    rate: tuple[int, int] = (RATE_EVENTS, RATE_WINDOW_MS),
    auth: tuple[int, int] = (AUTH_LINES, AUTH_WINDOW_MS),
    sweep: tuple[int, int] = (SWEEP_IDS, SWEEP_WINDOW_MS),
) -> DataFrame:
    """Rate bursts, denial bursts and id sweeps as findings, from one pass over the lines.

    A line counts under each signal that it belongs to; all signals share the shuffles of `tagged_counts`.
    """
    line, no_token = F.col("line"), F.lit(None).cast("string").alias("token")

    def mark(tag: str) -> Column:
        return F.struct(F.lit(tag).alias("tag"), no_token)

    plain = F.array(mark("rate-burst"), F.when(tx.is_denied(line), mark("auth-burst")))
    tokens = F.transform(tx.id_tokens(line), lambda t: F.struct(F.lit("sweep").alias("tag"), t.alias("token")))
    marks = F.filter(F.concat(plain, F.coalesce(tokens, F.array().cast("array<struct<tag:string,token:string>>"))), lambda m: m.isNotNull())
    tasks = tasks_for(lines)
    rows = explode_once(dealt(lines, tasks), marks, "mark", "source", "n", "ts_ms", "deal")
    rows = rows.select("source", "n", "ts_ms", "deal", "mark.tag", "mark.token")
    asked = {"rate-burst": (*rate, " timestamped lines"), "auth-burst": (*auth, " denied lines"), "sweep": (*sweep, " distinct id tokens")}
    counted = tagged_counts(rows, {tag: window for tag, (_, window, _) in asked.items()}, tasks)
    enough, words = F.lit(False), F.lit(None).cast("string")
    for tag, (least, window, what) in asked.items():
        here = F.col("tag") == tag
        enough = enough | (here & (F.col("total") >= least))
        words = F.when(here, text("line ", F.col("row"), f" starts a {_span(window)} window with ", F.col("total"), what)).otherwise(words)
    return as_findings(counted.filter(enough), F.col("tag"), words, F.col("row"))


def abuse_findings(
    lines: DataFrame,
    first_only: bool = True,
    rate: tuple[int, int] = (RATE_EVENTS, RATE_WINDOW_MS),
    rhythm: tuple[int, float] = (RHYTHM_GAPS, RHYTHM_CV),
    template: tuple[int, int] = (TEMPLATE_LINES, TEMPLATE_MINUTES),
    auth: tuple[int, int] = (AUTH_LINES, AUTH_WINDOW_MS),
    sweep: tuple[int, int] = (SWEEP_IDS, SWEEP_WINDOW_MS),
) -> DataFrame:
    """All five signals, each with its two thresholds. Details carry numbers only, never log text.

    The three that count inside time windows come from one pass (see `window_findings`).
    """
    row = F.col("row")
    parts = [
        window_findings(lines, rate, auth, sweep),
        as_findings(machine_rhythm(lines, *rhythm), "machine-rhythm", text("line ", row, f" starts {rhythm[0]} even gaps"), row),
        as_findings(
            template_reuse(lines, *template),
            "template-reuse",
            text("line ", row, " shape repeats ", F.col("lines"), " times across ", F.col("minutes"), " minutes"),
            row,
        ),
    ]
    found = union_findings(parts)
    return first_per_kind(found) if first_only else found


def scan_totals(lines: DataFrame) -> DataFrame:
    """`source, rows, events`: lines and stamped lines."""
    return lines.groupBy("source").agg(F.count("*").alias("rows"), F.count("ts_ms").alias("events"))
