"""Text sources: lines of large files in order, and whole small files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelight.functions.compat import is_blank, split_lines
from sievelight.functions.text import stamp_ms


#: File blocks whose places are broadcast at most; more meet their lines in Spark's own choice of join.
BLOCKS = 1_000_000


def read_numbered_lines(
    spark: SparkSession, path: str, keep: Column | None = None, glob: str | None = None, kept_only: bool = False
) -> DataFrame:
    """`source, line_no, n, line` of text files of any size.

    `line_no` counts physical lines from 1, `n` the lines for which `keep` (over `line`) holds, NULL for others, which are
    left out with `kept_only`. `glob` takes the files of that name anywhere below the path. Lines are UTF-8; a
    file that starts with a UTF-16 mark is an error, since its lines can't be told apart here (see `read_text_files`).

    Lines stay in the task that reads them. A task counts its lines twice, before and after the filter; both counts less
    their value at the start of the line's file block are places inside the block, and blocks start where the blocks
    before them end. Two numbers per block are all that meets the lines, as a broadcast.
    """
    keep = ~is_blank(F.col("line")) if keep is None else keep
    reader = spark.read.option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    files = reader.text(path)
    raw = files.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        F.regexp_replace("value", "\r\\z", "").alias("line"),
    ).withColumn("_keep", F.coalesce(keep, F.lit(False)))
    counts = raw.groupBy("source", "_block").agg(
        F.min("_at").alias("_first"), F.count("*").alias("_lines"), F.count_if("_keep").alias("_kept")
    )
    file_order = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # A task may read blocks of many files; its count of kept lines goes on from one to the next.
    task = F.shiftright("_first", 33)
    task_order = Window.partitionBy(task).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)

    def before(count: str, order: Window) -> Column:
        return F.coalesce(F.sum(count).over(order), F.lit(0))

    starts = counts.select(
        "source",
        "_block",
        (before("_lines", file_order) - F.col("_first") + 1).alias("_shift"),
        (before("_kept", file_order) - before("_kept", task_order) - F.shiftleft(task, 33) + 1).alias("_kept_shift"),
    )
    if len(files.inputFiles()) + files.rdd.getNumPartitions() <= BLOCKS:
        starts = F.broadcast(starts)
    kept = raw.filter("_keep").withColumn("_nth", F.monotonically_increasing_id())
    rows = kept if kept_only else kept.unionByName(raw.filter("NOT _keep").withColumn("_nth", F.lit(None).cast("long")))
    line_no = F.col("_at") + F.col("_shift")
    marked = F.left("line", F.lit(2)) == "\ufffd\ufffd"
    utf16 = F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("source"))).cast("string")
    return rows.join(starts, ["source", "_block"]).select(
        "source",
        line_no.alias("line_no"),
        (F.col("_nth") + F.col("_kept_shift")).alias("n"),
        F.when((line_no == 1) & marked, utf16).when(line_no == 1, F.regexp_replace("line", "^﻿", "")).otherwise(F.col("line")).alias("line"),
    )


def with_stamps(lines: DataFrame, keep_blank: bool) -> DataFrame:
    kept = lines if keep_blank else lines.filter(F.col("n").isNotNull())
    return kept.withColumn("ts_ms", stamp_ms(F.col("line")))


def read_log_lines(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    """`source, line_no, n, line, ts_ms`; `n` counts non-blank lines. Blank lines stay with `keep_blank`."""
    return with_stamps(read_numbered_lines(spark, path, kept_only=not keep_blank), keep_blank)


def log_lines_from_text(files: DataFrame, keep_blank: bool = False) -> DataFrame:
    """The same from whole texts `source, text`, each within one row."""
    return with_stamps(lines_from_text(files), keep_blank)


def lines_from_text(files: DataFrame) -> DataFrame:
    """`source, line_no, n, line` of `source, text`."""
    lines = F.transform(split_lines(F.col("text")), lambda line, i: F.struct((i + 1).cast("long").alias("line_no"), line.alias("line")))
    kept = F.filter("lines", lambda x: ~is_blank(x["line"]))
    blank = F.filter("lines", lambda x: is_blank(x["line"]))
    numbered = F.transform(
        "kept", lambda x, i: F.struct(x["line_no"].alias("line_no"), (i + 1).cast("long").alias("n"), x["line"].alias("line"))
    )
    unnumbered = F.transform(
        "blank", lambda x: F.struct(x["line_no"].alias("line_no"), F.lit(None).cast("long").alias("n"), x["line"].alias("line"))
    )
    return (
        files.select("source", lines.alias("lines"))
        .select("source", kept.alias("kept"), blank.alias("blank"))
        .select("source", F.explode(F.concat(numbered, unnumbered)).alias("x"))
        .select("source", "x.line_no", "x.n", "x.line")
    )


def decode_bytes(content: Column) -> Column:
    """Text of a file: UTF-16LE when its byte order mark says so, else UTF-8 without a mark."""

    def rest(start: int) -> Column:
        return F.substr(content, F.lit(start))

    return (
        F.when(F.hex(F.substring(content, 1, 2)) == "FFFE", F.decode(rest(3), "UTF-16LE"))
        .when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.decode(rest(4), "UTF-8"))
        .otherwise(F.decode(content, "UTF-8"))
    )


def read_text_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """`source, modified, size, text` of whole files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        F.col("path").alias("source"),
        F.col("modificationTime").alias("modified"),
        F.col("length").alias("size"),
        decode_bytes(F.col("content")).alias("text"),
    )
