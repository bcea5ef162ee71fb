"""Monotonic quality gate over a metric history `suite, <order>, value, failed, uncounted`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.compat import regex
from sievelight.plans.blocks import BLOCK_ROWS, global_rank, max_before
from sievelight.plans.session import stored
from sievelight.plans.sizing import broadcast_if_small
from sievelight.sources.state import read_state, write_state

# Count patterns of the known test tools.
COUNT_PATTERNS = {
    "node-test": r"ℹ tests (\d+)",
    "pytest": r"(\d+) passed",
    "cargo-test": r"test result: ok\. (\d+) passed",
    "dotnet-test": r"Passed!.*?Total:\s+(\d+)",
}


def extract_counts(col: Column, pattern: str, how: str = "last") -> Column:
    """Last or summed count a pattern finds in an output; NULL without a match, never a guess."""
    found = F.regexp_extract_all(col, F.lit(regex(pattern)), F.lit(1))
    if how == "last":
        return F.get(found, F.size(found) - 1).cast("long")
    if how != "sum":
        raise ValueError("how is last or sum")
    total = F.aggregate(found, F.lit(0).cast("long"), lambda seen, x: seen + x.cast("long"))
    return F.when(F.size(found) > 0, total)


def metric_ratchet(
    history: DataFrame, order: Sequence[str] = ("run_ts",), block_rows: int = BLOCK_ROWS, stored_baseline: DataFrame | None = None
) -> DataFrame:
    """Adds `baseline`, `verdict`, `reason` and `baseline_after` to every run.

    The baseline is the highest value of the runs before that did not fail. A run below it that dropped is no
    higher than it, so the rule needs no run-by-run state. A step without a count disables the check for its run.
    Where runs before `history` are not at hand, `stored_baseline` (`suite, baseline`, one row each) stands for them.
    """
    ranked = global_rank(history, ["suite", *order], "_rank")
    value, baseline = F.col("value"), F.col("baseline")
    with_base = max_before(ranked, ["suite"], "_rank", F.when(~F.col("failed"), value), "baseline", block_rows)
    if stored_baseline is not None:
        held = stored_baseline.select("suite", F.col("baseline").alias("_held"))
        with_base = with_base.join(broadcast_if_small(held), "suite", "left").withColumn("baseline", F.greatest(baseline, "_held")).drop("_held")
    dropped = F.coalesce((value < baseline) & (F.col("uncounted") == 0), F.lit(False))
    reason = F.when(F.col("failed"), "failing step").when(dropped, "ratchet")
    return (
        with_base.withColumn("reason", reason)
        .withColumn("verdict", F.when(F.col("reason").isNull(), "PASS").otherwise("FAIL"))
        .withColumn("baseline_after", F.when(F.col("verdict") == "PASS", F.greatest(baseline, value)).otherwise(baseline))
        .drop("_rank")
    )


def ratchet_runs(runs: DataFrame, path: str, order: Sequence[str] = ("run_ts",)) -> DataFrame:
    """Judges new runs against the baseline kept at `path`, and keeps what they raise it to.

    Only the new runs are read. The baseline of a suite is one number, so folding the runs' own highest value on it gives
    what the whole history would. Verdicts are stored before the new baseline takes the old one's place; a run that dies
    in between changes nothing and can be repeated, and so can a run that came through, since a maximum doesn't grow twice.
    Suites without new runs keep theirs.
    """
    spark = runs.sparkSession
    kind = dict(runs.dtypes)
    held = read_state(spark, path, f"suite {kind['suite']}, baseline {kind['value']}")
    judged = stored(metric_ratchet(runs, order, stored_baseline=held))
    raised = judged.filter(~F.col("failed") & F.col("value").isNotNull()).select("suite", F.col("value").alias("baseline"))
    write_state(held.unionByName(raised).groupBy("suite").agg(F.max("baseline").alias("baseline")), path)
    return judged
