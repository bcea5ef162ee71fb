"""Structured Streaming: audits within a row run on streams unchanged, and this is their sink; `bursts` has windows with state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_findings(findings: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Appends the findings of a stream to a Parquet table, each input once.

    Meant for checks that look at one row at a time, such as missing fields, bad mails, personal data, jargon,
    long lines, page and board checks. Duplicates and rankings need the whole table and stay batch jobs.
    """
    writer = findings.writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)
