"""Distributed ranks: gapless numbers within groups without gathering any group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.llm.store import settle


def parts_for(df: DataFrame) -> int:
    """Range partitions: Spark's own number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, group: list[str], order: list[str], rank: str, label: str = "ranked") -> DataFrame:
    """Add ``rank``: 0, 1, ... within each ``group`` in ``order`` (nulls first; equal rows in any order).

    Rows are range-partitioned on group and order together, so that a group of any size is spread over
    many tasks.  Each row gets its number in its partition; a table with a row for each partition and group
    (at most partitions + groups of them) turns these into ranks.
    """
    # the row number in a partition has 33 bits in monotonically_increasing_id
    spread = df.repartitionByRange(parts_for(df), *[F.col(c) for c in [*group, *order]]).sortWithinPartitions(*group, *order)
    kept = settle(spread, label, numbered="_at")
    kept = kept.withColumn("_part", F.shiftright("_at", 33))
    sums = kept.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("_part").alias("_p"),
        *[F.col(c).alias(f"_g_{c}") for c in group],
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    on = kept["_part"] == sums["_p"]
    for c in group:
        on = on & kept[c].eqNullSafe(sums[f"_g_{c}"])
    return kept.join(sums, on).withColumn(rank, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_p", "_shift", *[f"_g_{c}" for c in group])


def running(df: DataFrame, order: list[str], weight: str, total: str, label: str = "running") -> DataFrame:
    """Add ``total``: the sum of ``weight`` (long) over all rows before, in ``order`` (nulls first). ``df``: settled, as its rows are read twice.

    Rows are range-partitioned and summed up in their partitions; a table with a row for each partition gives
    what the partitions before sum to.
    """
    spread = df.repartitionByRange(parts_for(df), *[F.col(c) for c in order]).sortWithinPartitions(*order)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, so_far = TaskContext.get().partitionId(), 0
        for part in parts:
            own = part.column(weight).to_numpy()
            after = so_far + np.cumsum(own)
            so_far = int(after[-1]) if len(after) else so_far
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(own), task, np.int32)), pa.array(after - own)], names=[*part.schema.names, "_part", "_sum"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    kept = settle(spread.mapInArrow(run, names + ", _part int, _sum long"), label)
    sums = kept.groupBy(F.col("_part").alias("_p")).agg(F.max(F.col("_sum") + F.col(weight)).alias("_all"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition
    sums = sums.select("_p", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_base"))
    return kept.join(F.broadcast(sums), F.col("_part") == F.col("_p")).withColumn(total, F.col("_sum") + F.col("_base")).drop("_part", "_p", "_sum", "_base")
