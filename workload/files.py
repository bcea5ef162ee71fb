"""Where queries that write and read back keep their files: below the session's checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from sievelight.plans.session import ensure_checkpoint_dir


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; nothing is written here yet."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
