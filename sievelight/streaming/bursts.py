"""Bursts on streams of log lines: the rows of the batch operators, as soon as the watermark has passed their window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievelight.functions import text as tx
from sievelight.operators.abuse import AUTH_LINES, AUTH_WINDOW_MS, RATE_EVENTS, RATE_WINDOW_MS
from sievelight.plans.windows import BUCKET_WINDOWS

_OUT = "source string, row long, ts_ms long, events long"
_STATE = "stamps array<bigint>, counts array<bigint>, rows array<bigint>"


def stream_rate_burst(lines: DataFrame, n: int = RATE_EVENTS, window_ms: int = RATE_WINDOW_MS, delay: str = "1 minute") -> DataFrame:
    """`source, row, ts_ms, events` of `rate_burst`, from a stream `source, n, ts_ms, line`.

    State is kept per source and time bucket, so that a source's load is not one task's, and holds one entry per
    millisecond at most. A bucket needs its own lines and those of the window behind it; an event-time timer closes it
    when the watermark, `delay` behind the latest stamp seen, has passed both. Lines later than that are dropped by Spark;
    all others count, in whatever order they come. Lines without a stamp don't take part.
    """
    size = window_ms * BUCKET_WINDOWS
    stamped = lines.filter(F.col("ts_ms").isNotNull()).withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", delay)
    bucket = F.floor(F.col("ts_ms") / size)
    homes = F.when(F.pmod(F.col("ts_ms"), F.lit(size)) < window_ms, F.array(bucket, bucket - 1)).otherwise(F.array(bucket))
    placed = stamped.select("source", "n", "ts_ms", "at", F.explode(homes).alias("home"))

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        source, home = key
        seen = {s: [c, r] for s, c, r in zip(*state.get, strict=True)} if state.exists else {}
        if state.hasTimedOut:
            state.remove()
            yield _bursts(source, seen, int(home) * size, size, window_ms, n)
            return
        for frame in frames:
            for stamp, row in zip(frame["ts_ms"].tolist(), frame["n"].tolist(), strict=True):
                entry = seen.setdefault(stamp, [0, row])
                entry[0] += 1
                entry[1] = min(entry[1], row)
        state.update((list(seen), [c for c, _ in seen.values()], [r for _, r in seen.values()]))
        state.setTimeoutTimestamp((int(home) + 1) * size + window_ms)

    return placed.groupBy("source", "home").applyInPandasWithState(keep, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _bursts(source: str, seen: dict[int, list[int]], start: int, size: int, window_ms: int, n: int) -> pd.DataFrame:
    """The stamps of [start, start + size) whose following window holds `n` lines or more; two marks move over the stamps once."""
    stamps = sorted(seen)
    found, end, total = [], 0, 0
    for stamp in stamps:
        while end < len(stamps) and stamps[end] <= stamp + window_ms:
            total += seen[stamps[end]][0]
            end += 1
        if stamp < start + size and total >= n:
            found.append((source, seen[stamp][1], stamp, total))
        total -= seen[stamp][0]
    return pd.DataFrame(found, columns=["source", "row", "ts_ms", "events"])


def stream_auth_burst(
    lines: DataFrame, n: int = AUTH_LINES, window_ms: int = AUTH_WINDOW_MS, pattern: str = tx.DENIED, delay: str = "1 minute"
) -> DataFrame:
    """The same for denied lines only, as `auth_burst`."""
    return stream_rate_burst(lines.filter(tx.is_denied(F.col("line"), pattern)), n, window_ms, delay)
