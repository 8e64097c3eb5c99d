"""Named queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweft.functions import text as X
from chronoweft.functions import timecode as T
from chronoweft.functions import words as lists
from chronoweft.operators import captions, chapters, highlights, intervals, joins, sequences, signal, takes
from chronoweft.operators import retakes as retakes_
from chronoweft.plans import adapters as A
from chronoweft.sources.folders import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MERGED = f"""SELECT rec_id, min(start) AS start, max("end") AS "end", count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY rec_id ORDER BY start, "end") AS g FROM (
    SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY rec_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {{gap}} THEN 0 ELSE 1 END AS fresh FROM ({{of}}))) GROUP BY rec_id, g"""
HOUR = 3_600_000_000


def _merged(of: str = A.SQL["ranges"], gap: int = 0) -> str:
    return MERGED.format(gap=gap, of=of)


def _query(oracle: str | None = None):
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def _totals(r: DataFrame) -> DataFrame:
    """Every recording's end."""
    return r.groupBy("rec_id").agg(F.max("end").alias("total"))


TOTALS = f'SELECT rec_id, max("end") AS total FROM ({A.SQL["ranges"]}) GROUP BY rec_id'
KEEPS = f"""SELECT rec_id, f AS start, start AS "end" FROM (
  SELECT rec_id, start, coalesce(max("end") OVER (PARTITION BY rec_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM ({_merged()})) WHERE start > f AND start - f >= {HOUR}"""


@_query(_merged())
def merge_ranges(spark, d):
    return intervals.merge(A.ranges(spark, d))


@_query(_merged(gap=HOUR))
def merge_ranges_gap(spark, d):
    return intervals.merge(A.ranges(spark, d), HOUR)


@_query(KEEPS)
def complement_ranges(spark, d):
    r = A.ranges(spark, d)
    return intervals.complement(r, _totals(r), HOUR)


@_query(f'SELECT rec_id, CAST(sum("end" - start) AS BIGINT) AS total FROM ({_merged()}) GROUP BY rec_id')
def total_duration(spark, d):
    return intervals.total(intervals.merge(A.ranges(spark, d)))


SHORT = f"""SELECT rec_id, start - coalesce(sum(gone) OVER (PARTITION BY rec_id ORDER BY start), 0) AS new_start, "end" - start AS length, CAST(coalesce(sum(gone) OVER (PARTITION BY rec_id ORDER BY start), 0) AS BIGINT) AS removed FROM (
  SELECT *, CASE WHEN start - p >= {HOUR} THEN start - p ELSE 0 END AS gone FROM (SELECT *, coalesce(max("end") OVER (PARTITION BY rec_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM ({_merged()})))"""


@_query(f"SELECT rec_id, CAST(new_start AS BIGINT) AS new_start, CAST(length AS BIGINT) AS length, removed FROM ({SHORT})")
def shortened_timeline(spark, d):
    """What is left when every stretch of an hour or more without activity is cut: each active stretch on the new clock."""
    r = A.ranges(spark, d)
    # no cut reaches into an active stretch, so that both its ends slide alike, and one of no length between two cuts stays
    moved = intervals.removed_before(intervals.merge(r), intervals.complement(r, _totals(r), HOUR), "start")
    return moved.select("rec_id", (F.col("start") - F.col("removed")).cast("long").alias("new_start"), (F.col("end") - F.col("start")).cast("long").alias("length"), F.col("removed").cast("long").alias("removed"))


@_query(f"""WITH r AS ({A.SQL['ranges']}), k AS ({_merged(f"SELECT * FROM ({A.SQL['ranges']}) WHERE lane = 'click'")}), c AS (SELECT * FROM r WHERE lane <> 'click'),
 b AS (SELECT c.ord, c.rec_id, c.start, c."end", k.start AS ks, k."end" AS ke FROM c LEFT JOIN k ON k.rec_id = c.rec_id AND k.start < c."end" AND k."end" > c.start),
 p AS (SELECT ord, rec_id, coalesce(max(ke) OVER w, start) AS f0, start AS s0, ks AS t FROM b WHERE ks IS NOT NULL WINDOW w AS (PARTITION BY ord ORDER BY ks ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
   UNION ALL SELECT ord, rec_id, coalesce(max(ke), min(start)), min(start), min("end") FROM b GROUP BY ord, rec_id)
 SELECT rec_id, ord, greatest(f0, s0) AS start, t AS "end" FROM p WHERE t > greatest(f0, s0)""")
def subtract_ranges(spark, d):
    r = A.ranges(spark, d)
    return intervals.subtract(r.filter("lane <> 'click'"), r.filter("lane = 'click'")).select("rec_id", "ord", "start", "end")


@_query(f"""WITH m AS (SELECT *, coalesce(sum("end" - start) OVER (PARTITION BY rec_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM ({_merged(f"SELECT * FROM ({A.SQL['ranges']}) WHERE lane = 'click'")})),
 i AS (SELECT * FROM ({A.SQL['ranges']}) WHERE lane <> 'click'),
 x AS (SELECT i.*, coalesce(max(least(m."end", i.start) - m.start + m.gone) FILTER (m.start < i.start), 0) AS rs, coalesce(max(least(m."end", i."end") - m.start + m.gone) FILTER (m.start < i."end"), 0) AS re, coalesce(bool_or(m.start < i.start AND i.start < m."end"), false) AS inside
   FROM i LEFT JOIN m ON m.rec_id = i.rec_id AND m.start < i."end" GROUP BY ALL)
 SELECT rec_id, ord, CAST(start - rs AS BIGINT) AS start, CAST("end" - re AS BIGINT) AS "end" FROM x
 WHERE CASE WHEN "end" <= start THEN NOT inside ELSE ("end" - start) - (re - rs) >= ("end" - start) / 2.0 END""")
def ripple_items(spark, d):
    r = A.ranges(spark, d)
    return intervals.ripple(r.filter("lane <> 'click'"), r.filter("lane = 'click'"), floor=0, slack=0).select("rec_id", "ord", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@_query(f"""WITH k AS (SELECT *, coalesce(sum("end" - start) OVER (PARTITION BY rec_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tm FROM ({_merged(f"SELECT * FROM ({A.SQL['ranges']}) WHERE lane = 'view'")})),
 i AS (SELECT * FROM ({A.SQL['ranges']}) WHERE lane <> 'view'),
 x AS (SELECT i.rec_id, i.ord, k.tm + least(k."end" - k.start, greatest(0, i.start - k.start)) AS s, k.tm + least(k."end" - k.start, greatest(0, i."end" - k.start)) AS e, k.tm + k."end" - k.start AS top
   FROM i JOIN k ON k.rec_id = i.rec_id AND (i.start + i."end") / 2.0 >= k.start AND (i.start + i."end") / 2.0 < k."end")
 SELECT rec_id, ord, CAST(s AS BIGINT) AS start, CAST(CASE WHEN e <= s THEN least(top, s + 1) ELSE e END AS BIGINT) AS "end" FROM x""")
def remap_through_keeps(spark, d):
    r = A.ranges(spark, d)
    keeps = intervals.merge(r.filter("lane = 'view'"))
    return intervals.remap_through_keeps(r.filter("lane <> 'view'"), keeps, 0, 1).select("rec_id", "ord", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@_query(f"SELECT rec_id, CAST(i AS INTEGER) AS i, CAST(i * {24 * HOUR} AS BIGINT) AS start, CAST(least((i + 1) * {24 * HOUR}, total) AS BIGINT) AS \"end\" FROM (SELECT rec_id, total, unnest(range(0, CAST(ceil(total / {24 * HOUR}.0) AS BIGINT))) AS i FROM (SELECT rec_id, CAST(sum(\"end\" - start) AS BIGINT) AS total FROM ({_merged()}) GROUP BY rec_id))")
def segments_by_interval(spark, d):
    return intervals.by_interval(intervals.total(intervals.merge(A.ranges(spark, d))), 24 * HOUR, 0).select("rec_id", "i", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@_query(f"""WITH b AS (SELECT rec_id, start AS tm FROM ({A.SQL['ranges']}) WHERE lane = 'purchase'), t AS ({TOTALS}),
 p AS (SELECT b.rec_id, tm FROM b JOIN t USING (rec_id) WHERE tm > 1 AND tm < total - 1 UNION ALL SELECT rec_id, 0 FROM t UNION ALL SELECT rec_id, total FROM t)
 SELECT rec_id, tm AS start, n AS "end" FROM (SELECT rec_id, tm, lead(tm) OVER (PARTITION BY rec_id ORDER BY tm) AS n FROM p) WHERE n - tm > 1""")
def segments_from_boundaries(spark, d):
    r = A.ranges(spark, d)
    return intervals.from_boundaries(r.filter("lane = 'purchase'").select("rec_id", F.col("start").alias("at")), _totals(r), 1)


@_query(f'SELECT rec_id, e AS start, n AS "end" FROM (SELECT rec_id, "end" AS e, lead(start) OVER (PARTITION BY rec_id ORDER BY start, "end") AS n FROM ({A.SQL["ranges"]})) WHERE n - e >= {HOUR}')
def gaps(spark, d):
    return intervals.gaps(A.ranges(spark, d), HOUR)


@_query(f"""WITH s AS (SELECT *, "end" - start >= {6 * HOUR} OR row_number() OVER o = 1 AS long FROM ({_merged()}) WINDOW o AS (PARTITION BY rec_id ORDER BY start, "end")),
 g AS (SELECT *, sum(long::INT) OVER (PARTITION BY rec_id ORDER BY start, "end") AS grp FROM s),
 h AS (SELECT rec_id, grp, min(start) AS start, max("end") AS "end" FROM g GROUP BY rec_id, grp),
 m AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY grp) AS r, count(*) OVER (PARTITION BY rec_id) AS n, first_value("end" - start) OVER (PARTITION BY rec_id ORDER BY grp) < {6 * HOUR} AS short, lag(start) OVER (PARTITION BY rec_id ORDER BY grp) AS p FROM h)
 SELECT rec_id, CASE WHEN r = 2 AND short THEN p ELSE start END AS start, "end" FROM m WHERE NOT (r = 1 AND short AND n > 1)""")
def hold_segments(spark, d):
    return intervals.hold(intervals.merge(A.ranges(spark, d)), 6 * HOUR)


@_query(f"""WITH c AS (SELECT rec_id, count(*) AS total FROM ({A.SQL['levels']}) GROUP BY rec_id),
 k AS (SELECT rec_id, total, unnest(range(0, CASE WHEN total <= 20 THEN 1 ELSE CAST(ceil((total - 20) / 14.0) AS BIGINT) + 1 END)) AS chunk FROM c),
 r AS (SELECT rec_id, total, chunk, chunk * 14 AS from_i, least(chunk * 14 + 20, total) AS to_i FROM k)
 SELECT rec_id, CAST(chunk AS INTEGER) AS chunk, from_i, to_i, coalesce((from_i + lag(to_i) OVER w) // 2, 0) AS own_from, coalesce((lead(from_i) OVER w + to_i) // 2, total) AS own_to FROM r WINDOW w AS (PARTITION BY rec_id ORDER BY chunk)""")
def chunk_plan(spark, d):
    return intervals.plan_chunks(A.levels(spark, d).groupBy("rec_id").agg(F.count(F.lit(1)).alias("total")), 20, 6)


# ---- sequences -----------------------------------------------------------------------

LOUD = f"""SELECT rec_id, i, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS loud FROM (
  SELECT *, CASE WHEN i = 0 THEN db > -60 WHEN db > -40 THEN true WHEN db < -60 THEN false END AS ev FROM ({A.SQL['levels']}))"""


def _loud(spark, d):
    return sequences.hysteresis(A.levels(spark, d), F.lit(-60), 20)


@_query(LOUD)
def hysteresis_flags(spark, d):
    return _loud(spark, d).select("rec_id", "i", "loud")


@_query(f"""SELECT rec_id, min(i) * 1.0 AS start, (max(i) + 1) * 1.0 AS "end" FROM (SELECT *, i - row_number() OVER (PARTITION BY rec_id, loud ORDER BY i) AS g FROM ({LOUD})) WHERE NOT loud GROUP BY rec_id, g HAVING count(*) >= 3""")
def quiet_runs(spark, d):
    return sequences.quiet_runs(_loud(spark, d), 1.0, 3.0).select("rec_id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))


ORACLES["quiet_runs"] = ORACLES["quiet_runs"].replace("min(i) * 1.0", "CAST(min(i) AS DOUBLE)").replace("(max(i) + 1) * 1.0", "CAST(max(i) + 1 AS DOUBLE)")


def _rank_sql(at: str) -> str:
    return f"SELECT rec_id, db FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY db) - 1 AS k, count(*) OVER (PARTITION BY rec_id) AS n FROM ({A.SQL['levels']})) WHERE k = {at}"


@_query(_rank_sql("floor(0.1 * (n - 1))"))
def nearest_rank_silence(spark, d):
    return sequences.nearest_rank(A.levels(spark, d), "db", 0.1)


@_query(_rank_sql("least(n - 1, floor(n * 0.4))"))
def nearest_rank_grid(spark, d):
    return sequences.nearest_rank(A.levels(spark, d), "db", 0.4, "exclusive")


@_query(f"""WITH l AS (SELECT rec_id, db AS v FROM ({A.SQL['levels']}) WHERE db > -90),
 f AS (SELECT rec_id, v AS floor FROM (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY rec_id) AS n FROM l WINDOW w AS (PARTITION BY rec_id ORDER BY v)) WHERE k = floor(0.1 * (n - 1))),
 a AS (SELECT l.rec_id, v, row_number() OVER (PARTITION BY l.rec_id ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY l.rec_id) AS n FROM l JOIN f USING (rec_id) WHERE v > floor + 6),
 s AS (SELECT rec_id, v AS voice FROM a WHERE n >= 10 AND k = floor(0.6 * (n - 1))),
 c AS (SELECT rec_id, count(*) AS n FROM l GROUP BY rec_id), u AS (SELECT DISTINCT rec_id FROM ({A.SQL['levels']})),
 x AS (SELECT u.rec_id, floor, coalesce(voice, floor + 6) AS speech, coalesce(c.n, 0) < 10 AS digital FROM u LEFT JOIN f USING (rec_id) LEFT JOIN s USING (rec_id) LEFT JOIN c USING (rec_id))
 SELECT rec_id, CASE WHEN NOT digital THEN floor END AS floor, CASE WHEN NOT digital THEN speech END AS speech, NOT digital AND speech - floor < 10 AS continuous, digital FROM x""")
def mic_levels(spark, d):
    return signal.mic_levels(A.levels(spark, d), least=10).select("rec_id", "floor", F.col("speech").cast("long").alias("speech"), "continuous", "digital")


@_query(f"SELECT rec_id, CAST(round(sum(CASE WHEN n >= 3 THEN n ELSE 0 END) * 1000000.0 / max(total)) AS BIGINT) AS share_ppm FROM (SELECT l.rec_id, count(*) AS total FROM ({A.SQL['levels']}) l GROUP BY l.rec_id) t LEFT JOIN (SELECT rec_id, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY rec_id, loud ORDER BY i) AS g FROM ({LOUD})) WHERE NOT loud GROUP BY rec_id, g) q USING (rec_id) GROUP BY rec_id".replace("-40", "-57"))
def pause_share(spark, d):
    l = A.levels(spark, d)  # noqa: E741
    t = l.select("rec_id").distinct().withColumn("threshold", F.lit(-60))
    return signal.pause_share(l, t, 3.0, 1.0).select("rec_id", F.round(F.col("share") * 1000000).cast("long").alias("share_ppm"))


@_query(f"SELECT CAST(0 AS BIGINT) AS rec_id, CAST(max(w) + 1 AS BIGINT) AS windows, CAST(count(*) FILTER (h > 0) AS BIGINT) AS any_n, CAST(count(*) FILTER (h = 5) AS BIGINT) AS all_n FROM (SELECT w, count(*) FILTER (db > -99) AS h FROM ({A.SQL['grid']}) GROUP BY w)")
def grid_coverage(spark, d):
    c = signal.coverage(A.grid(spark, d), 1.0)
    return c.select("rec_id", "windows", F.round(F.col("any_share") * F.col("windows")).cast("long").alias("any_n"), F.round(F.col("all_share") * F.col("windows")).cast("long").alias("all_n"))


def _pct_sql(p: float) -> str:
    return f"max(d) FILTER (k = least(n - 1, floor(n * {p})))"


@_query(f"""WITH g AS ({A.SQL['grid']}), x AS (SELECT abs(a.db - b.db) AS d FROM g a JOIN g b USING (w) WHERE a.mic = 'click' AND b.mic = 'view' AND a.db > -99 AND b.db > -99),
 r AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k, count(*) OVER () AS n FROM x)
 SELECT CAST(0 AS BIGINT) AS rec_id, CAST(count(*) AS BIGINT) AS n, CAST({_pct_sql(0.5)} AS BIGINT) AS p50, CAST({_pct_sql(0.75)} AS BIGINT) AS p75, CAST({_pct_sql(0.9)} AS BIGINT) AS p90 FROM r HAVING count(*) > 0""")
def mic_separation(spark, d):
    return signal.separation(A.grid(spark, d), "click", "view")


@_query(f"""SELECT rec_id, ord, CAST(sum(b) OVER (PARTITION BY rec_id ORDER BY start, "end", ord) AS BIGINT) AS phrase FROM (
  SELECT *, CASE WHEN ord = 0 OR start - lag("end") OVER w > 450 OR regexp_matches(lag(text) OVER w, '[.!?।॥۔؟？！…]["''”’)\\]]*$') OR lag(speaker) OVER w <> speaker THEN 1 ELSE 0 END AS b FROM ({A.SQL['words']}) WINDOW w AS (PARTITION BY rec_id ORDER BY start, "end", ord))""")
def session_phrases(spark, d):
    return sequences.phrases(A.words(spark, d), 450).select("rec_id", "ord", "phrase")


@_query(f"""WITH h AS (SELECT *, sum(b) OVER (PARTITION BY rec_id ORDER BY ord) AS g FROM (SELECT *, CASE WHEN ord = 0 OR regexp_matches(lag(text) OVER w, '[.!?।॥۔؟…]["''”’)\\]]*$') OR start - lag("end") OVER w > 700 THEN 1 ELSE 0 END AS b FROM ({A.SQL['words']}) WINDOW w AS (PARTITION BY rec_id ORDER BY ord))),
 p AS (SELECT *, (row_number() OVER (PARTITION BY rec_id, g ORDER BY ord) - 1) // 16 AS part FROM h)
 SELECT rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY g, part) AS INTEGER) AS cue, min(start) AS start, max("end") AS "end", string_agg(text, ' ' ORDER BY ord) AS text, count(*) AS n FROM p GROUP BY rec_id, g, part""")
def cues_from_words(spark, d):
    return sequences.word_cues(A.words(spark, d), 700)


EXPLODED = f"""WITH c AS (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS ws FROM ({A.SQL['cues']})),
 e AS (SELECT rec_id, ord AS cue, start AS s, "end" AS e, generate_subscripts(ws, 1) - 1 AS word, unnest(ws) AS text FROM c),
 w AS (SELECT *, greatest(2, length(text)) AS wt FROM e)
 SELECT rec_id, cue, CAST(word AS INTEGER) AS word, text, sum(wt) OVER (PARTITION BY rec_id, cue ORDER BY word) AS upto, sum(wt) OVER (PARTITION BY rec_id, cue) AS total FROM w"""


@_query(f"WITH x AS ({EXPLODED}) SELECT rec_id, cue, word, text, CAST(floor(upto * 1000000.0 / total + 0.3) AS BIGINT) AS end_ppm FROM x")
def explode_words(spark, d):
    c = A.cues(spark, d).withColumn("start", F.lit(0.0)).withColumn("end", F.lit(1.0))
    return sequences.explode_words(c, min_duration=None).select("rec_id", "cue", "word", "text", F.floor(F.col("end") * 1000000 + 0.3).cast("long").alias("end_ppm"))


@_query(f"SELECT rec_id, cue, CAST(word AS INTEGER) AS word, string_agg(text, ' ') OVER (PARTITION BY rec_id, cue ORDER BY word) AS text FROM ({EXPLODED})")
def typewriter_accumulate(spark, d):
    return sequences.typewriter(sequences.explode_words(A.cues(spark, d), min_duration=None)).select("rec_id", "cue", "word", "text")


@_query(f"""SELECT rec_id, ord, start, coalesce(lead(start) OVER w, "end") AS "end", array_to_string(list_filter([lag(text) OVER w, text, lead(text) OVER w], lambda t: t IS NOT NULL), ' ') AS words, CAST(CASE WHEN ord = 0 THEN 0 ELSE 1 END AS INTEGER) AS active FROM ({A.SQL['words']}) WINDOW w AS (PARTITION BY rec_id ORDER BY start, ord)""")
def caption_window(spark, d):
    return sequences.spoken_windows(A.words(spark, d)).withColumn("words", F.array_join("words", " "))


@_query(f"""SELECT rec_id, ord, CAST(s AS BIGINT) AS start, CAST(greatest("end", s + 400) AS BIGINT) AS "end" FROM (SELECT *, max(start - p) OVER (PARTITION BY rec_id ORDER BY start, ord) + p AS s FROM (SELECT *, (row_number() OVER (PARTITION BY rec_id ORDER BY start, ord) - 1) * 400 AS p FROM ({A.SQL['words']})))""")
def sanitize_words(spark, d):
    return sequences.sanitize_words(A.words(spark, d), 400).select("rec_id", "ord", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@_query(f"""SELECT rec_id, ord, CAST(floor(start * 30000 / 1001000.0 + 0.5) AS BIGINT) AS first_frame, CAST(floor("end" * 30000 / 1001000.0 + 0.5) AS BIGINT) AS last_frame FROM ({A.SQL['words']})""")
def frame_snap(spark, d):
    w = A.words(spark, d)
    return w.select("rec_id", "ord", *[T.half_up(F.col(c) * 30000 / 1001000.0).alias(n) for c, n in (("start", "first_frame"), ("end", "last_frame"))])


# ---- joins -----------------------------------------------------------------------------


@_query(f"""WITH r AS ({A.SQL['ranges']}) SELECT a.rec_id, a.ord AS a, b.ord AS b, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end" FROM r a JOIN r b ON a.rec_id = b.rec_id AND a.lane = 'click' AND b.lane = 'view' AND a.start < b."end" AND a."end" > b.start""")
def interval_overlap_join(spark, d):
    r = A.ranges(spark, d)
    b = r.filter("lane = 'view'").select("rec_id", F.col("ord").alias("b"), F.col("start").alias("bs"), F.col("end").alias("be"))
    return joins.overlap(r.filter("lane = 'click'"), b, ("start", "end"), ("bs", "be")).select("rec_id", F.col("ord").alias("a"), "b", F.greatest("start", "bs").alias("start"), F.least("end", "be").alias("end"))


@_query(f"""WITH r AS ({A.SQL['ranges']}) SELECT p.rec_id, p.ord, max(q.start) AS run FROM (SELECT * FROM r WHERE lane = 'click') p LEFT JOIN (SELECT * FROM r WHERE lane = 'view') q ON q.rec_id = p.rec_id AND q.start <= p.start GROUP BY p.rec_id, p.ord""")
def asof_run(spark, d):
    r = A.ranges(spark, d)
    return joins.as_of(r.filter("lane = 'click'").select("rec_id", "ord", F.col("start").alias("t")), r.filter("lane = 'view'").select("rec_id", F.col("start").alias("run")), "t", "run", ["run"]).select("rec_id", "ord", "run")


@_query(f"""WITH r AS ({A.SQL['ranges']}), e AS (SELECT rec_id, start AS tm FROM r WHERE lane = 'view' UNION ALL SELECT rec_id, "end" FROM r WHERE lane = 'view')
 SELECT p.rec_id, p.ord, coalesce(min(abs(tm - p.start)), 0) AS distance FROM (SELECT * FROM r WHERE lane = 'click') p LEFT JOIN e ON e.rec_id = p.rec_id GROUP BY p.rec_id, p.ord""")
def nearest_edge(spark, d):
    r = A.ranges(spark, d)
    p = r.filter("lane = 'click'").select("rec_id", "ord", F.col("start").alias("t"))
    return joins.nearest_edge(p, r.filter("lane = 'view'")).select("rec_id", "ord", F.abs(F.col("edge") - F.col("t")).alias("distance"))


@_query(f"""WITH r AS ({A.SQL['ranges']}), s AS (SELECT rec_id, start AS tm, 0 AS side FROM r WHERE lane = 'view' UNION ALL SELECT rec_id, "end", 1 FROM r WHERE lane = 'view'),
 c AS (SELECT rec_id, ord, start, "end", (SELECT tm FROM s WHERE s.rec_id = r.rec_id AND abs(tm - r.start) <= {6 * HOUR} ORDER BY abs(tm - r.start), tm LIMIT 1) AS ns, (SELECT tm FROM s WHERE s.rec_id = r.rec_id AND side = 1 AND abs(tm - r."end") <= {6 * HOUR} ORDER BY abs(tm - r."end"), tm LIMIT 1) AS ne FROM r WHERE lane = 'click')
 SELECT rec_id, ord, CASE WHEN coalesce(ne, "end") > coalesce(ns, start) THEN coalesce(ns, start) ELSE start END AS start, CASE WHEN coalesce(ne, "end") > coalesce(ns, start) THEN coalesce(ne, "end") ELSE "end" END AS "end" FROM c""")
def snap_cuts(spark, d):
    r = A.ranges(spark, d)
    return intervals.snap_cuts(r.filter("lane = 'click'"), r.filter("lane = 'view'"), 6 * HOUR, 0).select("rec_id", "ord", "start", "end")


# ---- text ------------------------------------------------------------------------------

_IN = lambda ws: ", ".join("'" + w.replace("'", "''") + "'" for w in ws)
TFIDF = f"""WITH t AS (SELECT source AS rec_id, doc_id, unnest(list_filter(list_transform(regexp_split_to_array(translate(lower(text), '‘’ʼ`', ''''''''''), '[^a-z0-9''ऀ-ॣ०-ॿ]+'), lambda x: trim(x, '''')), lambda x: x <> '')) AS word FROM documents),
 k AS (SELECT * FROM t WHERE word NOT IN ({_IN(lists.STOP)}) AND (regexp_matches(word, '^[0-9]') OR length(replace(word, '''', '')) >= 3)),
 n AS (SELECT source AS rec_id, count(*) AS n FROM documents GROUP BY source)
 SELECT k.rec_id, word, count(*) AS tf, count(DISTINCT doc_id) AS df, CAST(round(count(*) * ln(1 + max(n) / count(DISTINCT doc_id)) * 1000000) AS BIGINT) AS score_u FROM k JOIN n USING (rec_id) GROUP BY k.rec_id, word"""


def _tfidf(spark, d):
    return chapters.keyword_scores(A.documents(spark, d)).select("rec_id", "word", "tf", "df", F.round(F.col("score") * 1000000).cast("long").alias("score_u"))


@_query(TFIDF)
def tfidf_keywords(spark, d):
    return _tfidf(spark, d)


@_query(f"SELECT rec_id, word, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY score_u DESC, word) AS rank FROM ({TFIDF})) WHERE rank <= 12")
def top_keywords(spark, d):
    return chapters.top_keywords(_tfidf(spark, d).withColumnRenamed("score_u", "score")).select("rec_id", "word", "rank")


@_query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{label}'" for p, label in lists.HOOK_PATTERNS) + " END AS label FROM documents")
def hook_markers(spark, d):
    return A.table(spark, d, "documents").select("doc_id", X.hook_label("text").alias("label"))


@_query(f"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w IN ({_IN([w for w in lists.FILLERS if w.isascii()])}))) AS INTEGER) AS n FROM documents WHERE lang = 'en'")
def filler_words(spark, d):
    parts = F.split(F.lower("text"), "[^a-z]+")
    return A.table(spark, d, "documents").filter("lang = 'en'").select("doc_id", F.size(F.filter(parts, lambda w: X.is_filler(w))).alias("n"))


@_query(f"SELECT rec_id, ord, CASE WHEN regexp_replace(lower(text), '[^a-z]', '', 'g') IN ({_IN([w for w in lists.PROFANITY])}) THEN 1 ELSE 0 END AS listed FROM ({A.SQL['words']})")
def censor_words(spark, d):
    w = A.words(spark, d)
    return w.select("rec_id", "ord", F.when(X.censor("text") != F.col("text"), 1).otherwise(0).alias("listed"))


@_query("SELECT label, CAST(round(1000000 * corr(x, y)) AS BIGINT) AS r_ppm FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings) GROUP BY label HAVING count(*) >= 3")
def pearson_pairs(spark, d):
    e = A.table(spark, d, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return e.groupBy("label").agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n")).filter("n >= 3").select("label", F.round(F.col("r") * 1000000).cast("long").alias("r_ppm"))


@_query(f"SELECT rec_id, speaker, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY first, speaker) AS INTEGER) AS place, CAST(talk AS BIGINT) AS talk FROM (SELECT rec_id, speaker, min(start) AS first, sum(\"end\" - start) AS talk FROM ({A.SQL['cues']}) GROUP BY rec_id, speaker)")
def voice_order(spark, d):
    from chronoweft.operators import speakers

    return speakers.voice_order(A.cues(spark, d)).select("rec_id", "speaker", "place", F.col("talk").cast("long").alias("talk"))


# ---- kernels over whole recordings: no SQL form, tested against brute force and literal cases -------------


def _seconds(spark, d):
    return A.seconds(A.words(spark, d))


def _sentences(spark, d):
    return sequences.word_cues(_seconds(spark, d), 0.6, 14).withColumnRenamed("cue", "ord")


@_query()
def stumbles(spark, d):
    return takes.stumbles(_seconds(spark, d))


@_query()
def retakes(spark, d):
    return retakes_.repeated_takes(_seconds(spark, d), keep="best")


@_query()
def filler_ranges(spark, d):
    return takes.fillers(_seconds(spark, d), extra=True)


@_query()
def highlights_topk(spark, d):
    return highlights.highlights(_sentences(spark, d), 6, 30)


@_query()
def caption_groups(spark, d):
    return captions.caption_groups(_seconds(spark, d), max_chars=42)


@_query()
def caption_timing(spark, d):
    return captions.caption_frames(_seconds(spark, d), 29.97, max_chars=42)


@_query()
def overlay_plan(spark, d):
    frames = captions.caption_frames(_seconds(spark, d), 30.0, max_chars=42, mode="karaoke")
    frames = frames.select("rec_id", "caption", "frame", "start", "end", captions.look_key(["words", "active", "reveal"]).alias("look"))
    frames = frames.withColumn("ord", F.row_number().over(Window.partitionBy("rec_id").orderBy("caption", "frame")).cast("long"))
    return captions.overlay_plan(frames, 30.0, ["look"])


@_query()
def chapter_marks(spark, d):
    return chapters.chapters(_sentences(spark, d), 15.0)


@_query(f"""WITH w AS (SELECT source AS rec_id, lang AS part, regexp_replace(regexp_replace(lower(unnest(regexp_split_to_array(text, '\\s+'))), '[^a-z0-9''\\x{{0900}}-\\x{{0963}}\\x{{0966}}-\\x{{097F}}]', '', 'g'), '^''+|''+$', '', 'g') AS word FROM documents),
 k AS (SELECT * FROM w WHERE word <> '' AND word NOT IN ({_IN(lists.TOPIC_STOP)}) AND NOT contains(word, '''') AND length(word) >= CASE WHEN regexp_matches(word, '^[a-z0-9'']+$') THEN 4 ELSE 2 END),
 n AS (SELECT source AS rec_id, count(DISTINCT lang) AS n FROM documents GROUP BY source), t AS (SELECT rec_id, part, word, count(*) AS tf FROM k GROUP BY ALL), f AS (SELECT rec_id, word, count(*) AS df FROM t GROUP BY ALL),
 s AS (SELECT t.*, tf * (ln(n / df) + 0.1) AS s FROM t JOIN f USING (rec_id, word) JOIN n USING (rec_id)), r AS (SELECT *, row_number() OVER (PARTITION BY rec_id, part ORDER BY round(s, 9) DESC, tf DESC, word) AS r FROM s),
 p AS (SELECT rec_id, part, max(word) FILTER (r = 1) AS a, max(word) FILTER (r = 2) AS b, max(s) FILTER (r = 1) AS s1, max(s) FILTER (r = 2) AS s2, max(tf) FILTER (r = 2) AS f2 FROM r WHERE r <= 2 GROUP BY ALL)
 SELECT rec_id, part, array_to_string(list_transform(string_split(CASE WHEN f2 >= 2 AND s2 >= 0.6 * s1 THEN a || ' ' || b ELSE a END, ' '), lambda x: CASE WHEN regexp_matches(x, '^[a-z]') THEN upper(substr(x, 1, 1)) || substr(x, 2) ELSE x END), ' ') AS title FROM p""")
def chapter_titles(spark, d):
    return chapters.chapter_titles(A.documents(spark, d).withColumn("part", F.col("lang")), "part")


@_query()
def subtitles(spark, d):
    return captions.native_subtitles(A.seconds(A.cues(spark, d)), 25.0)


# ---- speakers and shots --------------------------------------------------------------------


@_query(f"""WITH s AS (SELECT rec_id, (row_number() OVER (PARTITION BY rec_id ORDER BY start, "end") - 1) % 3 AS angle, count(*) OVER (PARTITION BY rec_id) AS n FROM ({_merged()}))
 SELECT rec_id, CAST(angle AS BIGINT) AS angle, count(*) AS segments, CAST(max(n) - 1 AS BIGINT) AS switches FROM s GROUP BY rec_id, angle""")
def plan_stats(spark, d):
    from chronoweft.operators import speakers

    return speakers.plan_stats(speakers.rotate(intervals.merge(A.ranges(spark, d)), 3))


@_query(f"""WITH g AS ({A.SQL['grid']}), m AS (SELECT mic, avg(db) FILTER (db > -99) AS mean FROM g GROUP BY mic),
 c AS (SELECT g.mic, w, CASE WHEN db > -99 THEN db - mean ELSE 0.0 END AS v FROM g JOIN m USING (mic)),
 s AS (SELECT lag, avg(x.v * y.v) AS score, count(*) AS n FROM (SELECT unnest(range(-12, 13)) AS lag) l CROSS JOIN (SELECT * FROM c WHERE mic = 'click') x JOIN (SELECT * FROM c WHERE mic = 'view') y ON y.w = x.w + lag GROUP BY lag)
 SELECT CAST(0 AS BIGINT) AS rec_id, CAST(lag AS INTEGER) AS lag FROM s WHERE n > 12 ORDER BY round(score, 9) DESC, lag LIMIT 1""")
def xcorr_offset(spark, d):
    return signal.estimate_offset(A.grid(spark, d), "click", "view", 1.0, 12.0).select("rec_id", "lag")


def _turns(spark, d):
    """Turns of a conversation as regions in seconds, a camera for each role."""
    roles = F.create_map(*[x for k, r in enumerate(("user", "assistant", "system")) for x in (F.lit(r), F.lit(k).cast("long"))])
    return A.seconds(A.cues(spark, d)).select("rec_id", F.coalesce(F.element_at(roles, F.col("speaker")), F.lit(0)).alias("angle"), "start", "end")


@_query()
def director_plan(spark, d):
    from chronoweft.operators import speakers

    r = _turns(spark, d)
    return speakers.director(r, r.groupBy("rec_id").agg(F.max("end").alias("total")), 3, max_shot=20.0)


@_query()
def layout_plan(spark, d):
    from chronoweft.operators import speakers

    r = _turns(spark, d)
    return speakers.layouts(r, r.groupBy("rec_id").agg(F.max("end").alias("total")))


@_query()
def script_align(spark, d):
    from chronoweft.operators import script

    cues = settle(A.seconds(A.cues(spark, d)), "cues")
    scripts = cues.groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: F.upper(x["text"])), "\n").alias("script"))
    return script.align_to_script(cues, scripts)


@_query()
def speaker_activity(spark, d):
    from chronoweft.operators import speakers

    return speakers.speaker_activity(A.grid(spark, d), 1.0)


@_query(f"""SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY start, ord) AS i, (start // 1000) + CAST(start % 1000 AS DOUBLE) / 1000 AS start, ("end" // 1000) + CAST("end" % 1000 AS DOUBLE) / 1000 AS "end", text FROM ({A.SQL['cues']})""")
def parse_srt(spark, d):
    """Turns written as subtitle files and read again."""
    from chronoweft.sources import readers, sinks

    cues = A.seconds(A.cues(spark, d)).withColumnRenamed("ord", "i")
    return readers.subtitles(sinks.to_srt(cues))
