"""Writers. Each writes a new path and leaves its inputs alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_IF_EXISTS = "errorifexists"


def write_clean(clean: DataFrame, path: str, form: str = "csv", mode: str = ERROR_IF_EXISTS) -> None:
    """Defect-free rows: CSV with its header, any JSON form as JSON lines. Order columns are not data.

    JSON rows keep only the keys they came with. Files hold the rows by `source` and `n`, from first file to last.
    """
    if {"source", "n"} <= set(clean.columns):
        clean = clean.orderBy("source", "n")
    if form == "csv":
        clean.drop("source", "n").write.mode(mode).option("header", True).csv(path)
    else:
        clean.drop("source", "n", "fields").write.mode(mode).option("ignoreNullFields", True).json(path)


def save_known(problems: DataFrame, path: str, mode: str = ERROR_IF_EXISTS) -> None:
    problems.select("id").distinct().write.mode(mode).parquet(path)


def save_baseline(gate: DataFrame, path: str, mode: str = ERROR_IF_EXISTS) -> None:
    """`n, pass` of every suite, to compare later runs with."""
    suite = F.col("suite") if "suite" in gate.columns else F.lit("").alias("suite")
    gate.select(suite, "n", "pass").write.mode(mode).parquet(path)


def write_findings(findings: DataFrame, path: str, mode: str = ERROR_IF_EXISTS) -> None:
    findings.write.mode(mode).json(path)
