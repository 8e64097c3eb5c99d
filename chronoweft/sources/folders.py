"""Folders that the driver and every executor reach."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on a local master without it, as in tests, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="chronoweft-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return (named if "://" in named else f"file://{named}").rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A new path there."""
    return f"{shared(spark)}/{label}-{uuid.uuid4().hex}"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{path}")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write rows to the shared folder and read them again, so that nothing before is run twice and a lost executor costs nothing before."""
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many tasks as the session shuffles to, however few bytes they are: for work that takes long for its size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
