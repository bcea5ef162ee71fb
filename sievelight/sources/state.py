"""Tables that live between runs: every change is a new version, and a version counts once it is complete.

A version is a folder `version=<number>` below the table's path. Spark marks a folder when its whole job is committed;
readers take the highest marked version, so a run that dies while it writes leaves the version before in force, and what
it wrote is passed over by the next one. Two writers of one version: the second is refused and starts again from what it
finds then. On stores where a marker appears at once, as on file systems, the change is atomic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Complete versions that stay behind the current one, for readers that have begun.
KEPT = 2


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """Numbers of all versions, and whether each is complete."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at(path)):
        return []
    named = [s.getPath().getName() for s in fs.listStatus(at(path))]
    numbers = [int(n.removeprefix("version=")) for n in named if n.startswith("version=") and n.removeprefix("version=").isdigit()]
    return sorted((n, fs.exists(at(f"{path}/version={n}/_SUCCESS"))) for n in numbers)


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the current version."""
    done = [n for n, complete in _versions(spark, path) if complete]
    return f"{path}/version={done[-1]}" if done else None


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The current version, or a table without rows where there is none yet."""
    folder = current_version(spark, path)
    return spark.read.schema(schema).parquet(folder) if folder else spark.createDataFrame([], schema)


def write_state(df: DataFrame, path: str, keep: int = KEPT, partition_by: Sequence[str] = ()) -> int:
    """Writes the rows as the next version and gives its number; versions older than the `keep` before it are removed.

    `df` may be derived from the current version, which is not touched.
    """
    spark = df.sparkSession
    before = _versions(spark, path)
    number = before[-1][0] + 1 if before else 1
    df.write.mode("errorifexists").parquet(f"{path}/version={number}", partitionBy=list(partition_by) or None)
    fs, at = _file_system(spark, path)
    for old in [n for n, complete in before if complete][: -keep or None]:
        fs.delete(at(f"{path}/version={old}"), True)
    return number
