"""Connected components of links within recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.sources.folders import settle

KEY = "rec_id"


def components(links: DataFrame) -> DataFrame:
    """rec_id, p and g, the least number linked with it, for every number in a link. links: rec_id, a, b; a <> b.

    A round gives every number the least label among its own and its neighbours' and then the label of that label;
    it is over when no label changes.  Every aggregate is partial before it shuffles, and rounds grow with the
    logarithm of the longest chain.
    """
    both = settle(links.select(KEY, F.col("a").alias("p"), F.col("b").alias("to")).unionByName(links.select(KEY, F.col("b").alias("p"), F.col("a").alias("to"))).distinct(), "links")
    labels = settle(both.groupBy(KEY, "p").agg(F.least("p", F.min("to")).alias("g")), "labels")
    while True:
        of = labels.select(KEY, F.col("p").alias("to"), F.col("g").alias("_g"))
        near = both.join(of, [KEY, "to"]).groupBy(KEY, "p").agg(F.min("_g").alias("_g"))
        least = labels.join(near, [KEY, "p"]).select(KEY, "p", F.col("g").alias("_old"), F.least("g", "_g").alias("_g"))
        jump = labels.select(KEY, F.col("p").alias("_g"), F.col("g").alias("_up"))
        after = settle(least.join(jump, [KEY, "_g"]).select(KEY, "p", "_old", F.least("_g", "_up").alias("g")), "labels")
        labels = after.select(KEY, "p", "g")
        if after.filter("g <> _old").isEmpty():
            return labels
