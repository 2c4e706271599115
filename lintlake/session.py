"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "lintlake", scratch: str | None = None) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own. ``scratch``: where stored
    tables go."""
    builder = SparkSession.builder
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch).config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
    return (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    Where that is unset the folder lies in the warehouse, which every executor can reach as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return os.path.join(root.rstrip("/"), f"lintlake-{label}-{uuid.uuid4().hex}")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The table written to the shared folder and read back: computed once, however often it is
    used afterwards, and safe from lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
