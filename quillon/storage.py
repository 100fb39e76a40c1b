"""Cutting lineage through the storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where the session names none, as in tests."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillon-core-"))
        got = spark.sparkContext.getCheckpointDir()
    return got.rstrip("/")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key over as many tasks as a shuffle has, for work that a row costs more than its bytes.

    A reader's tasks follow a file's bytes and row groups, so a small file of many rows is one task or two.
    Joins, windows and groups by these keys need no further exchange.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write once and read back: computed once, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
