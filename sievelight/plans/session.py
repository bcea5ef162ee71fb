"""Session settings the library relies on, and reliable checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", partitions: int = 8, **settings: str) -> SparkSession:
    """A single-machine session for tests and the bench. A cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sievelight")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        # Small inputs can still be heavy per row; keep all cores at work on them.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder where it names one.

    Where it names none, a local session gets a temporary folder that goes when the process ends. On a cluster that is
    an error: executors would each write to a disk of their own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getConf().get(CHECKPOINT_SETTING)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sievelight-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, for inputs that several branches of a plan read.

    Each branch then scans only the columns it needs instead of deriving the rows again.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written once to shared storage and survive a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
