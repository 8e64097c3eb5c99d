"""Named queries of timelines within timelines, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweft.operators import timeline
from chronoweft.plans import adapters as A
from chronoweft.plans.catalog import _query

#: A user's events as the clips of a sequence, one behind the other in eighths of a second; a purchase plays another user's sequence, and every fifth clip plays at twice its speed.
_CLIPS = """SELECT user_id AS seq, (n % 2)::INTEGER AS track, event_id AS clip, CASE WHEN event_type = 'purchase' THEN (user_id * 7 + 3) % 20 END AS nest,
    n * 2::DOUBLE AS s, n * 2::DOUBLE + (1 + n % 7) / 4::DOUBLE AS e, (event_id % 16) / 8::DOUBLE AS i, CASE WHEN n % 5 = 0 THEN 2::DOUBLE ELSE 1::DOUBLE END AS v, n % 11 = 3 AS r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)"""


@_query(f"""WITH RECURSIVE c AS ({_CLIPS}),
    f AS (SELECT seq, 0 AS depth, [seq] AS path, track, clip, nest, s, e, i, v, r FROM c
      UNION ALL SELECT f.seq, f.depth + 1, list_append(f.path, c.seq), c.track, c.clip, c.nest, f.s + (greatest(c.s, f.i) - f.i) / f.v, f.s + (least(c.e, f.i + (f.e - f.s) * f.v) - f.i) / f.v, c.i + (greatest(c.s, f.i) - c.s) * c.v, f.v * c.v, f.r OR c.r
      FROM f JOIN c ON c.seq = f.nest AND c.e > f.i AND c.s < f.i + (f.e - f.s) * f.v WHERE f.depth < 4 AND NOT list_contains(f.path, f.nest) AND least(c.e, f.i + (f.e - f.s) * f.v) - greatest(c.s, f.i) > 0.01)
    SELECT seq AS rec_id, depth, array_to_string(path, '/') AS path, track, clip AS clip_id, s AS start, e AS "end", i AS in_point, i + (e - s) * v AS out_point, v AS speed, r AS reversed FROM f WHERE nest IS NULL""")
def nested_clips(spark, d):
    """What each user's sequence plays, through the sequences that it plays, to a depth of four and never round in circles."""
    e = A.table(spark, d, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = e.withColumn("n", n)
    nested = F.col("event_type") == "purchase"
    clips = rows.select(
        F.col("user_id").cast("string").alias("sequence_id"), (F.col("n") % 2).cast("int").alias("track"), F.lit("audio").alias("kind"), F.col("event_id").cast("string").alias("clip_id"),
        F.when(~nested, F.lit("take.wav")).alias("media"), F.when(nested, ((F.col("user_id") * 7 + 3) % 20).cast("string")).alias("nested_id"), (F.col("n") * 2.0).alias("start"), (F.col("n") * 2.0 + (1 + F.col("n") % 7) / 4.0).alias("end"),
        ((F.col("event_id") % 16) / 8.0).alias("in_point"), F.lit(None).cast("double").alias("out_point"), F.when(F.col("n") % 5 == 0, 2.0).otherwise(1.0).alias("speed"), (F.col("n") % 11 == 3).alias("reversed"), F.lit(False).alias("disabled"),
    )
    tracks = clips.select("sequence_id", "track", "kind").distinct().withColumn("muted", F.lit(False))
    found = timeline.flatten_nests(clips, tracks)
    return found.select(F.col("sequence_id").cast("long").alias("rec_id"), "depth", F.array_join("path", "/").alias("path"), "track", F.col("clip_id").cast("long").alias("clip_id"), "start", "end", "in_point", "out_point", "speed", "reversed")
