"""Recursive text corpora, evaluation suites, judge replies, pipe tables and known ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions.compat import regex, trim
from sievelight.operators.evaluation import CHECKS_TYPE
from sievelight.sources.lines import decode_bytes, read_text_files

# What a corpus takes in, reply layout, and table layout.
TEXT_ENDINGS = (".md", ".mjs", ".js", ".cjs", ".json", ".txt", ".py", ".cs", ".rs", ".yaml", ".yml")
SKIP_DIRS = ("node_modules", ".git", "archive")
REPLY_NAME = r"^\d+-judge.*\.md$"
RESULT_HEADING = "## Result"
RESULT_OPEN, RESULT_CLOSE = r"^[\s\S]*?<task_result>\s*", r"\s*<\/task_result>[\s\S]*$"
VERDICT = "(?i)VERDICT"
TABLE_COLUMNS = ("id", "status", "scorecard", "what", "done_when", "owner", "evidence")


def read_corpus(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """`source, doc, text`: text files below `root` by ending; `doc` is the relative path.

    With `max_bytes`, larger files stay in the table with a null text, so that what was left out can be seen.
    """
    base = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # The folder's own spelling of its path, as the reader gives it, is what all paths start with.
    plain = root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    rel = F.substr(F.col("path"), F.instr("path", plain) + F.lit(len(plain)))
    ending = F.lower(F.regexp_extract("doc", r"(\.[^.]*)\z", 1))
    text = decode_bytes(F.col("content"))
    skipped = F.exists(F.split(F.col("doc"), "/", -1), lambda part: part.isin(*SKIP_DIRS))
    return (
        base.withColumn("doc", rel)
        .filter(ending.isin(*TEXT_ENDINGS) & ~skipped)
        .select(F.lit(root).alias("source"), "doc", (text if max_bytes is None else F.when(F.col("length") <= max_bytes, text)).alias("text"))
    )


def read_eval_suite(spark: SparkSession, cases_path: str, answers_path: str) -> tuple[DataFrame, DataFrame]:
    """`cases(case, checks)` and `answers(case, run, text)` from nested JSON files."""
    reader = spark.read.option("multiLine", True)
    cases = reader.schema(f"cases array<struct<id:string,checks:{CHECKS_TYPE}>>").json(cases_path)
    answers = reader.schema("answers array<struct<case:string,run:int,text:string>>").json(answers_path)
    return (
        cases.select(F.explode("cases").alias("c")).select(F.col("c.id").alias("case"), "c.checks"),
        answers.select(F.explode("answers").alias("a")).select("a.case", "a.run", "a.text"),
    )


def read_judge_replies(spark: SparkSession, path: str, name: str = REPLY_NAME) -> DataFrame:
    """`reply, modified, text`: the result part of reply files that name a verdict. Order by `modified, reply`."""
    files = read_text_files(spark, path, recursive=False)
    part = F.coalesce(F.get(F.split("text", regex(RESULT_HEADING), 2), F.lit(1)), F.lit(""))
    cleaned = F.regexp_replace(F.regexp_replace(part, regex(RESULT_OPEN), ""), regex(RESULT_CLOSE), "")
    return (
        files.withColumn("reply", F.substring_index("source", "/", -1))
        .filter(F.col("reply").rlike(regex(name)))
        .select("reply", "modified", trim(cleaned).alias("text"))
        .filter(F.col("text").rlike(VERDICT))
    )


def read_md_table(lines: DataFrame) -> DataFrame:
    """`source, id, status, scorecard, what, done_when, owner, evidence, line` from pipe table lines."""
    parts = F.split(trim(F.col("line")), r"\|", -1)
    inner = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), trim)
    rows = (
        lines.filter(trim(F.col("line")).startswith("|"))
        .select("source", F.col("line_no").cast("int").alias("line"), inner.alias("cells"))
        .filter(F.size("cells") >= len(TABLE_COLUMNS))
    )
    first = F.get("cells", F.lit(0))
    named = rows.filter((first != "") & ~first.rlike(r"(?i)^ID\z") & ~first.rlike(r"^-+\z"))
    return named.select("source", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(TABLE_COLUMNS)], "line")


def read_known(spark: SparkSession, path: str) -> DataFrame:
    """`id`: known ids from a JSON array or the keys of an object; unreadable files give none."""
    body = trim(F.col("text"))
    listed = F.when(body.startswith("["), F.from_json(body, "array<string>")).otherwise(F.json_object_keys(body))
    return read_text_files(spark, path).select(F.explode(listed).alias("id")).distinct()
