"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.store import forget, settle


def _roots(parents: DataFrame) -> DataFrame:
    """Each node's root, by jumping to the parent's parent until nothing changes."""
    while True:
        up = parents.select(F.col("node").alias("_n"), F.col("label").alias("_up"))
        jumped = settle(parents.join(up, F.col("label") == F.col("_n")).select("node", F.col("label").alias("_old"), F.col("_up").alias("label")), "roots")
        changed = jumped.filter("label <> _old").limit(1).count()
        forget(parents)
        parents = jumped.select("node", "label")
        parents._settled_at = jumped._settled_at
        if not changed:
            return parents


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, label for every node of an edge between two nodes: label is the smallest node of its component.

    In a round every node takes its smallest neighbour, if smaller, for its parent; trees become single nodes
    and edges inside them go.  At least half of the nodes with edges disappear each time.  Every aggregate is
    partial before it shuffles, and no node's neighbours are gathered.
    """
    left = settle(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y"), "edges")
    labels = None
    while True:
        both = left.select(F.col("x").alias("node"), F.col("y").alias("near")).union(left.select("y", "x"))
        roots = _roots(settle(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label")), "parents"))
        if labels is None:
            labels = roots
        else:
            last = labels
            to = roots.select(F.col("node").alias("_n"), F.col("label").alias("_root"))
            labels = settle(labels.join(to, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_root", "label").alias("label")), "labels")
            forget(last)
        x, y = roots.select(F.col("node").alias("x"), F.col("label").alias("_x")), roots.select(F.col("node").alias("y"), F.col("label").alias("_y"))
        rest = settle(left.join(x, "x").join(y, "y").filter("_x <> _y").select(F.col("_x").alias("x"), F.col("_y").alias("y")).distinct(), "edges")
        forget(left)
        left = rest
        if left.isEmpty():
            return labels
