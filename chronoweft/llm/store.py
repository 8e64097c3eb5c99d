"""Files that every executor and the driver can reach, and lineage cuts through them."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where that is unset on a local master, as in tests, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="chronoweft-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return (named if "://" in named else f"file://{named}").rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str, numbered: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here and a lost executor costs nothing before it.

    ``numbered`` adds a unique long (partition number and row number in it) under that name.
    """
    spark = df.sparkSession
    if numbered:
        df = df.withColumn(numbered, F.monotonically_increasing_id())
    path = fresh(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._settled_at = path
    return back


def forget(*frames: DataFrame) -> None:
    """Delete what ``settle`` wrote for these frames, once nothing reads them any more."""
    for df in frames:
        path = getattr(df, "_settled_at", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI and the path in it; executors write and range-read binary files with it."""
    return pafs.FileSystem.from_uri(uri)
