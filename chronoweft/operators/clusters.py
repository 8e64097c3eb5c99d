"""Rows that are alike within tolerances, each with the first one kept that it is alike to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.sources.folders import settle


def first_kept(rows: DataFrame, keys: list[str], order: list[str], near: dict[str, float]) -> DataFrame:
    """Adds ``leader``: the struct of ``order`` of the first kept row of its keys that a row differs from by less than the tolerances; a kept row is its own.

    Rows are gone through in ``order``, which must tell rows of unlike values apart: one that is near a row kept so
    far goes with the first such row, any other is kept.  Being near is not transitive, so what is kept depends on
    what was kept before.  Rows of equal keys and values are one here, values meet in cells as wide as the first
    tolerance, and a step decides all rows at once whose earlier neighbours are decided; a chain of neighbours takes
    as many steps as it is long at most.  Null keys are equal, and so are null values, which are near nothing else.
    """
    values = list(near)
    at = F.struct(*order)
    same = [*keys, *values]
    whole = rows.groupBy(*same).agg(F.min(at).alias("_at"))
    # one number for each row that can be kept
    whole = settle(whole.select(*same, "_at", F.xxhash64(*[F.col(k).cast("string") for k in keys]).alias("_k")), "distinct")
    first, wide = values[0], near[values[0]]
    cell = F.floor(F.col(first) / wide).cast("long")
    left = whole.select("_k", *[F.col(c).alias(f"q_{c}") for c in same], F.col("_at").alias("q"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    right = whole.select("_k", *[F.col(c).alias(f"p_{c}") for c in same], F.col("_at").alias("p"), cell.alias("_cell"))
    close = [F.col(f"q_{k}").eqNullSafe(F.col(f"p_{k}")) for k in keys] + [F.abs(F.col(f"q_{v}") - F.col(f"p_{v}")) < t for v, t in near.items()]
    met = left.join(right, ["_k", "_cell"]).filter(reduce(lambda a, b: a & b, close) & (F.col("q") < F.col("p")))
    group = [F.col(f"p_{k}").alias(k) for k in keys]
    pairs = settle(met.select("_k", *group, "q", "p"), "pairs")
    # earlier neighbours that are kept or not yet decided
    open_, kept = pairs, None
    undecided = pairs.select("_k", "p").distinct()
    fresh = pairs.select("_k", F.col("q").alias("p")).distinct().join(undecided, ["_k", "p"], "left_anti")
    while True:
        kept = fresh if kept is None else settle(kept.unionByName(fresh), "kept")
        gone = settle(open_.join(fresh.select("_k", F.col("p").alias("q")), ["_k", "q"]).select("_k", "p").distinct(), "gone")
        undecided = settle(undecided.join(gone, ["_k", "p"], "left_anti").join(fresh, ["_k", "p"], "left_anti"), "undecided")
        if undecided.isEmpty():
            break
        left_over = open_.join(gone, ["_k", "p"], "left_anti").join(gone.select("_k", F.col("p").alias("q")), ["_k", "q"], "left_anti")
        open_ = settle(left_over, "open")
        fresh = settle(undecided.join(open_.select("_k", "p").distinct(), ["_k", "p"], "left_anti"), "fresh")
    led = pairs.join(kept.select("_k", F.col("p").alias("q")), ["_k", "q"]).groupBy("_k", "p").agg(F.min("q").alias("_leader"))
    # a kept row has no leader, though it may be near one that is kept after it
    led = led.join(kept, ["_k", "p"], "left_anti")
    found = whole.join(led.withColumnRenamed("p", "_at"), ["_k", "_at"], "left").select(*same, F.coalesce("_leader", "_at").alias("leader"))
    on = [rows[c].eqNullSafe(found[c]) for c in same]
    return rows.join(found, reduce(lambda a, b: a & b, on)).select(*[rows[c] for c in rows.columns], found["leader"])
