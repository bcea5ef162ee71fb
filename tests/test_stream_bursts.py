"""Bursts on bounded streams give the rows of the batch operators."""

import os
import random

import pytest
from helpers import rows_of

from sievelight.operators import abuse
from sievelight.streaming.bursts import stream_auth_burst, stream_rate_burst

LINES = "source string, n long, ts_ms long, line string"


def event_rows(seed):
    """Two sources over many buckets: stamps shared by lines, gaps, stamps on bucket edges, lines without a stamp."""
    rng, rows, at = random.Random(seed), [], 1_000_000
    for n in range(1, 260):
        at += rng.choice([0, 0, 1, 200, 900, 4_000]) if n % 50 else 60_000
        stamp = at - at % 4_000 if n % 9 == 0 else at
        rows.append((rng.choice("ab"), n, None if n % 23 == 0 else stamp, rng.choice(["denied 403", "served", "401 unauthorized"])))
    return rows


def streamed(spark, folder, batches, build):
    """The rows of a query over one file per batch; two far-off lines at the end move the watermark past all others."""
    end = 10**12
    for k, rows in enumerate([*batches, [("end", 1, end, "denied")], [("end", 2, 2 * end, "denied")]]):
        spark.createDataFrame(rows, LINES).coalesce(1).write.json(str(folder / "in" / f"batch={k:03}"))
    files = sorted((folder / "in").glob("batch=*/part-*.json"))
    (folder / "flat").mkdir()
    for k, file in enumerate(files):
        (folder / "flat" / f"{k:03}.json").write_bytes(file.read_bytes())
        # Spark takes files in the order of their times.
        os.utime(folder / "flat" / f"{k:03}.json", (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).json(str(folder / "flat"))
    out = str(folder / "out")
    query = build(stream).writeStream.format("parquet").option("checkpointLocation", str(folder / "state")).option("path", out).trigger(availableNow=True)
    query.start().awaitTermination()
    return rows_of(spark.read.parquet(out).filter("source != 'end'"), "source", "row", "ts_ms", "events")


@pytest.mark.parametrize(("stream", "batch"), [(stream_rate_burst, abuse.rate_burst), (stream_auth_burst, abuse.auth_burst)])
def test_streams_give_the_rows_of_the_batch(spark, tmp_path, stream, batch):
    """Lines come up to eight seconds late and in any order, within the watermark."""
    rows = event_rows(4)
    rng = random.Random(5)
    late = sorted(rows, key=lambda r: (r[2] or 0) + rng.randrange(8_000))
    batches = [late[k : k + 70] for k in range(0, len(late), 70)]
    want = rows_of(batch(spark.createDataFrame(rows, LINES), 3, 1_000), "source", "row", "ts_ms", "events")
    assert len(want) > 20
    assert streamed(spark, tmp_path, batches, lambda df: stream(df, 3, 1_000, delay="10 seconds")) == want


def test_lines_behind_the_watermark_do_not_count(spark, tmp_path):
    near = [("a", n, 1_000_000 + n, "x") for n in range(1, 4)]
    far = [("a", 9, 9_000_000, "x")]
    stale = [("a", 5, 1_000_001, "x")]
    got = streamed(spark, tmp_path, [near, far, far, stale], lambda df: stream_rate_burst(df, 3, 1_000, delay="1 second"))
    assert got == [("a", 1, 1_000_001, 3)]
