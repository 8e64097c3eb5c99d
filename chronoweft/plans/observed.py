"""Named queries over values as the tables have them: levels of every user's microphones, crops, colours, errors and spoken names, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweft.functions import timecode as T
from chronoweft.operators import intervals, sequences, signal, speakers, timeline
from chronoweft.plans import adapters as A
from chronoweft.plans.catalog import MERGED, _query
from chronoweft.plans.forms import _MIX, _lum
from chronoweft.plans.labels import _crop
from chronoweft.sources.folders import settle

WORDS, CUES = A.SQL["words"], A.SQL["cues"]
#: Half a day.
WINDOW = 43_200_000_000
_CELLS = f"SELECT user_id AS rec_id, event_type AS mic, epoch_us(ts) // {WINDOW} AS w, CAST(sum(CAST(floor(value + 0.5) AS BIGINT)) AS BIGINT) AS db FROM events GROUP BY ALL"
GRIDS = f"""SELECT m.rec_id, m.mic, h.w - h.lo AS w, coalesce(c.db, -100) AS db FROM (SELECT rec_id, lo, unnest(range(lo, hi + 1)) AS w FROM (SELECT rec_id, min(w) AS lo, max(w) AS hi FROM ({_CELLS}) GROUP BY rec_id)) h
    JOIN (SELECT DISTINCT rec_id, mic FROM ({_CELLS})) m USING (rec_id) LEFT JOIN ({_CELLS}) c ON c.rec_id = m.rec_id AND c.mic = m.mic AND c.w = h.w"""


def grids(spark, d):
    """Event types as the microphones of a user, half a day a window: each microphone that the user has, heard or not in every window from the first to the last."""
    e = A.table(spark, d, "events")
    w = F.expr(f"unix_micros(cast(ts as timestamp)) div {WINDOW}")
    cells = e.select(F.col("user_id").alias("rec_id"), F.col("event_type").alias("mic"), w.alias("w"), F.floor(F.col("value") + 0.5).cast("long").alias("v")).groupBy("rec_id", "mic", "w").agg(F.sum("v").cast("long").alias("db"))
    spine = cells.groupBy("rec_id").agg(F.min("w").alias("lo"), F.max("w").alias("hi"), F.collect_set("mic").alias("mics"))
    spine = spine.withColumn("w", F.explode(F.sequence("lo", "hi"))).withColumn("mic", F.explode("mics"))
    return spine.join(cells, ["rec_id", "mic", "w"], "left").select("rec_id", "mic", (F.col("w") - F.col("lo")).alias("w"), F.coalesce("db", F.lit(-100)).alias("db"))


@_query(f"""WITH g AS ({GRIDS}), m AS (SELECT rec_id, count(DISTINCT mic) AS m FROM g GROUP BY rec_id), h AS (SELECT rec_id, w, count(*) FILTER (db > -99) AS h FROM g GROUP BY ALL)
 SELECT rec_id, CAST(max(w) + 1 AS BIGINT) AS windows, count(*) FILTER (h > 0) AS any_n, count(*) FILTER (h = m) AS all_n FROM h JOIN m USING (rec_id) GROUP BY rec_id""")
def user_coverage(spark, d):
    c = signal.coverage(grids(spark, d), 1.0)
    return c.select("rec_id", "windows", F.round(F.col("any_share") * F.col("windows")).cast("long").alias("any_n"), F.round(F.col("all_share") * F.col("windows")).cast("long").alias("all_n"))


@_query(f"WITH g AS ({GRIDS}) SELECT rec_id, mic, count(*) FILTER (db > -99) AS heard, CAST(coalesce(max(w + 1) FILTER (db > -99), 0) AS BIGINT) AS last_heard FROM g GROUP BY rec_id, mic")
def user_mics(spark, d):
    g = grids(spark, d)
    n = g.groupBy("rec_id").agg((F.max("w") + 1).alias("n"))
    return signal.mic_coverage(g, 1.0).join(n, "rec_id").select("rec_id", "mic", F.round(F.col("heard") * F.col("n")).cast("long").alias("heard"), F.col("last_heard").cast("long").alias("last_heard"))


def _at(p: float) -> str:
    return f"CAST(max(d) FILTER (k = least(n - 1, floor(n * {p}))) AS BIGINT)"


@_query(f"""WITH g AS ({GRIDS}), x AS (SELECT rec_id, abs(a.db - b.db) AS d FROM g a JOIN g b USING (rec_id, w) WHERE a.mic = 'click' AND b.mic = 'view' AND a.db > -99 AND b.db > -99),
 r AS (SELECT rec_id, d, row_number() OVER (PARTITION BY rec_id ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY rec_id) AS n FROM x)
 SELECT rec_id, count(*) AS n, {_at(0.5)} AS p50, {_at(0.75)} AS p75, {_at(0.9)} AS p90 FROM r GROUP BY rec_id""")
def user_separation(spark, d):
    return signal.separation(grids(spark, d), "click", "view")


@_query(f"""WITH g AS ({GRIDS}), o AS (SELECT rec_id, w, CASE WHEN max(db) > 20 THEN 2 ELSE 1 END AS state FROM g WHERE mic <> 'click' GROUP BY rec_id, w),
 b AS (SELECT o.rec_id, state, db FROM o JOIN g USING (rec_id, w) WHERE mic = 'click' AND db > -90), r AS (SELECT *, row_number() OVER (PARTITION BY rec_id, state ORDER BY db) - 1 AS k, count(*) OVER (PARTITION BY rec_id, state) AS n FROM b)
 SELECT rec_id, count(*) FILTER (state = 2) AS talk, count(*) FILTER (state = 1) AS quiet, CAST(CASE WHEN count(*) FILTER (state = 2) >= 3 AND count(*) FILTER (state = 1) >= 3 THEN max(db) FILTER (state = 1 AND k = floor(0.9 * (n - 1))) - max(db) FILTER (state = 2 AND k = floor(0.9 * (n - 1))) ELSE 0 END AS BIGINT) AS turn FROM r GROUP BY rec_id""")
def user_against_others(spark, d):
    """Each user's clicks as a track beside the other microphones, which talk where any of them is above 20."""
    g = grids(spark, d).withColumnRenamed("w", "slot")
    others = g.filter("mic <> 'click'").groupBy("rec_id", "slot").agg(F.when(F.max("db") > 20, 2).otherwise(1).alias("state"))
    return signal.versus_others(others, g.filter("mic = 'click'").select("rec_id", "slot", "db"), 3).select("rec_id", "talk", "quiet", F.col("turn").cast("long").alias("turn"))


@_query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_discount * 9 + 0.05) AS cx, (l_tax * 10 + 0.1) AS cy, l_quantity / 200 AS size, CAST(320 + l_quantity * 32 AS DOUBLE) AS w, CAST(180 + l_quantity * 20 AS DOUBLE) AS h FROM lineitem),
 a AS (SELECT *, CASE WHEN h * 0.5625 > w THEN w ELSE h * 0.5625 END AS fw, CASE WHEN h * 0.5625 > w THEN w / 0.5625 ELSE h END AS fh, size * w / 0.34 AS want FROM l),
 c AS (SELECT *, CASE WHEN want < fw THEN least(fw, greatest(0.5 * h * 0.5625, want)) ELSE fw END AS cw0 FROM a), e AS (SELECT *, CASE WHEN want < fw THEN cw0 / 0.5625 ELSE fh END AS ch0 FROM c)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_crop('(cx * w)', '(cy * h - ch0 * 0.36)', 'cw0', 'ch0')} FROM e""")
def line_crops(spark, d):
    """Upright windows around a face whose place, size and frame follow a line's discount, tax and quantity."""
    l = A.table(spark, d, "lineitem")  # noqa: E741
    q = F.col("l_quantity")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    faces = l.select(*keys, (F.col("l_discount") * 9 + 0.05).alias("cx"), (F.col("l_tax") * 10 + 0.1).alias("cy"), (q / 200).alias("size"), (320 + q * 32).cast("double").alias("width"), (180 + q * 20).cast("double").alias("height"), F.lit(0.5625).alias("aspect"))
    rows = T.face_crops(faces).select(*keys, "c")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.col(f"c.{a}").cast("long").alias(b) for a, b in (("x", "x"), ("y", "y"), ("w", "cw"), ("h", "ch"))])


@_query(f"""WITH p AS (SELECT doc_id, substr(md5(coalesce(text, '')), 1, 6) AS a, substr(md5(coalesce(text, '')), 7, 6) AS b FROM documents), l AS (SELECT *, {_lum('a')} AS la, {_lum('b')} AS lb FROM p)
 SELECT doc_id, CAST(round((greatest(la, lb) + 0.05) / (least(la, lb) + 0.05) * 1000) AS BIGINT) AS contrast, '#' || {_MIX} AS lighter FROM l""")
def text_colours(spark, d):
    """Two colours of each text, by its MD5: their contrast, and the first a quarter of the way to white."""
    key = F.md5(F.coalesce("text", F.lit("")))
    p = A.table(spark, d, "documents").select("doc_id", F.concat(F.lit("#"), F.substring(key, 1, 6)).alias("a"), F.concat(F.lit("#"), F.substring(key, 7, 6)).alias("b"))
    return p.select("doc_id", F.round(T.contrast_ratio("a", "b") * 1000).cast("long").alias("contrast"), T.shade("a", 0.25).alias("lighter"))


@_query("""WITH e AS (SELECT event_id, 400 + 2 * CAST(json_extract(props, '$.k') AS INTEGER) AS s, CASE WHEN event_type = 'error' THEN CAST(floor(value) AS INTEGER) % 60 ELSE 0 END AS c FROM events)
 SELECT event_id, CASE WHEN c IN (5, 6, 7, 28, 35, 52, 56) THEN 'network' WHEN c <> 0 THEN 'request_failed' WHEN s IN (401, 403) THEN 'bad_key' WHEN s = 429 THEN 'rate_limit' WHEN s = 402 THEN 'no_credit' WHEN s IN (500, 502, 503) THEN 'provider_down'
 WHEN s = 413 THEN 'too_large' WHEN s = 415 THEN 'bad_audio' ELSE 'unknown' END AS kind FROM e""")
def event_errors(spark, d):
    """What the numbers of each event would mean as a provider's status and connection error."""
    e = A.table(spark, d, "events")
    status = 400 + 2 * F.get_json_object("props", "$.k").cast("int")
    curl = F.when(F.col("event_type") == "error", F.floor("value").cast("int") % 60).otherwise(0)
    return e.select("event_id", timeline.error_kind(status, curl, F.lit("")).alias("kind"))


@_query(f"""WITH w AS (SELECT rec_id, ord, text AS p, lead(text) OVER (PARTITION BY rec_id ORDER BY ord) AS n FROM ({A.SQL['words']})), t AS (SELECT rec_id, ord, lower(p || ' ' || n) AS s FROM w WHERE n IS NOT NULL)
 SELECT rec_id, ord, CASE WHEN regexp_matches(s, '(^|[^a-z0-9])(music|musics|bgm|bg music|songs?|score|beats?|background|instrumental|gaana|gana|sangeet)($|[^a-z0-9])') THEN CASE WHEN regexp_matches(s, '(^|[^a-z0-9])(voices?|vo|v\\.o\\.?|mics?|microphone|host|guest|dialog|dialogue|narration|narrator|interview|speaker)($|[^a-z0-9])') THEN '' ELSE 'music' END
 WHEN regexp_matches(s, '(^|[^a-z0-9])(voices?|vo|v\\.o\\.?|mics?|microphone|host|guest|dialog|dialogue|narration|narrator|interview|speaker)($|[^a-z0-9])') THEN 'voice' ELSE '' END AS says FROM t""")
def said_names(spark, d):
    """What each pair of words said would tell as the name of a track."""
    w = A.words(spark, d)
    pairs = w.withColumn("n", F.lead("text").over(Window.partitionBy("rec_id").orderBy("ord"))).filter("n is not null")
    return pairs.select("rec_id", "ord", signal.track_says(F.concat_ws(" ", "text", "n")).alias("says"))



# ---- words, cues and cameras -------------------------------------------------------------------


_MIDDLE = f"""SELECT rec_id, max(d) FILTER (k = n // 2) AS m FROM (SELECT rec_id, "end" - start AS d, row_number() OVER (PARTITION BY rec_id ORDER BY "end" - start) - 1 AS k, count(*) OVER (PARTITION BY rec_id) AS n FROM ({WORDS}) WHERE "end" > start) GROUP BY rec_id"""


@_query(f"""WITH w AS (SELECT w.rec_id, ord, start, "end", least(1400, greatest(300, 1.25 * m)) AS cap, lag("end") OVER o AS prev, lead(start) OVER o AS next FROM ({WORDS}) w JOIN ({_MIDDLE}) m USING (rec_id) WINDOW o AS (PARTITION BY w.rec_id ORDER BY start, "end", ord)),
 f AS (SELECT *, "end" - start > cap AS long, coalesce(next < "end", false) AS crowded, prev IS NULL OR start - prev > 100 AS alone FROM w)
 SELECT rec_id, ord, CAST(CASE WHEN long AND NOT crowded AND alone THEN "end" - cap ELSE start END AS DOUBLE) AS start, CAST(CASE WHEN long AND crowded THEN least(start + cap, greatest(next, start + 50)) WHEN long AND NOT alone THEN start + cap ELSE "end" END AS DOUBLE) AS "end" FROM f""")
def clamped_words(spark, d):
    """Words longer than a quarter more than the middle one, cut on the side where there is silence."""
    found = sequences.clamp_words(A.words(spark, d), 300.0, 1400.0, 1.25, 0.0, 100.0, 50.0)
    return found.select("rec_id", "ord", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))


@_query(f"""WITH c AS (SELECT rec_id, ord, start, "end", lead(start) OVER (PARTITION BY rec_id ORDER BY start, ord) AS next FROM ({CUES})) SELECT rec_id, ord, start, CASE WHEN next > "end" THEN least(next, "end" + 500) ELSE "end" END AS "end" FROM c""")
def lingering_cues(spark, d):
    """Turns held until the next one, for half a second at most."""
    return sequences.fill_gaps(A.cues(spark, d), 500).select("rec_id", "ord", "start", "end")


_CAMERAS = "SELECT unnest(['user', 'assistant', 'system']) AS speaker, unnest([1, 0, -1]) AS angle"


@_query(f"SELECT rec_id, angle::BIGINT AS angle, start, \"end\" FROM ({CUES}) JOIN ({_CAMERAS}) USING (speaker) WHERE angle >= 0")
def speaker_regions(spark, d):
    cameras = spark.createDataFrame([("user", 1), ("assistant", 0), ("system", -1)], "speaker string, angle long")
    return speakers.cues_to_regions(A.cues(spark, d), cameras)


@_query(f"""WITH f AS (SELECT rec_id, speaker, row_number() OVER (PARTITION BY rec_id ORDER BY min(start), speaker) AS place FROM ({CUES}) GROUP BY rec_id, speaker)
 SELECT rec_id, (place - 1)::BIGINT AS angle, start + 40 AS start, "end" + 40 AS "end" FROM ({CUES}) JOIN f USING (rec_id, speaker) WHERE place <= 2""")
def voice_regions(spark, d):
    """Turns on the camera of their speaker's place, two cameras, 40 ms later."""
    cameras = spark.createDataFrame([(1, 0), (2, 1), (3, -1)], "place int, angle long")
    found = speakers.voices_to_regions(A.cues(spark, d), cameras, 40)
    return found.select("rec_id", "angle", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@_query(f"""WITH g AS ({GRIDS}), x AS (SELECT rec_id, a.mic, b.mic AS person, a.db::DOUBLE AS x, b.db::DOUBLE AS y FROM g a JOIN g b USING (rec_id, w) WHERE a.mic < b.mic)
 SELECT rec_id, mic, person, CAST(round(CASE WHEN count(*) < 3 OR coalesce(var_pop(x), 0) = 0 OR coalesce(var_pop(y), 0) = 0 THEN 0 ELSE corr(x, y) END * 10000) AS BIGINT) AS r FROM x GROUP BY ALL""")
def level_likeness(spark, d):
    """How alike the levels of each two microphones of a user are, in ten thousandths."""
    g = grids(spark, d)
    a, b = g.select("rec_id", "w", "mic", F.col("db").cast("double").alias("x")), g.select("rec_id", "w", F.col("mic").alias("person"), F.col("db").cast("double").alias("y"))
    pairs = a.join(b, ["rec_id", "w"]).filter("mic < person")
    return speakers.pearson(pairs, "x", "y", ["rec_id", "mic", "person"]).select("rec_id", "mic", "person", F.round(F.col("r") * 10000).cast("long").alias("r"))


_SECONDS = f'SELECT rec_id, start / 1000000::DOUBLE AS start, "end" / 1000000::DOUBLE AS "end" FROM ({A.SQL["ranges"]}) WHERE "end" / 1000000::DOUBLE - start / 1000000::DOUBLE > 0.02'


@_query(f'SELECT rec_id, start, "end" FROM ({MERGED.format(gap=0.04, of=_SECONDS)})')
def host_ranges(spark, d):
    """A user's events as a timeline's host joins them."""
    return timeline.merge_host(A.seconds(A.ranges(spark, d), 1_000_000.0)).select("rec_id", "start", "end")


# ---- cuts ----------------------------------------------------------------------------------------


def _less(cuts: str, keeps: str, least: int = 1) -> str:
    """Pieces of cuts (rec_id, ord, start, end) outside keeps that don't overlap: rec_id, ord, start, end, s0 (the cut's start)."""
    return f"""(WITH c AS ({cuts}), b AS (SELECT c.*, k.start AS ks, k."end" AS ke FROM c LEFT JOIN ({keeps}) k ON k.rec_id = c.rec_id AND k.start < c."end" AND k."end" > c.start),
 p AS (SELECT rec_id, ord, start AS s0, greatest(start, coalesce(max(ke) OVER w, start)) AS f, ks AS t FROM b WHERE ks IS NOT NULL WINDOW w AS (PARTITION BY rec_id, ord ORDER BY ks ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
   UNION ALL SELECT rec_id, ord, min(start), greatest(min(start), coalesce(max(ke), min(start))), min("end") FROM b GROUP BY rec_id, ord)
 SELECT rec_id, ord, f AS start, t AS "end", s0 FROM p WHERE t > f AND t - f >= {least})"""


_PAUSES = f"""SELECT rec_id, ord, "end" - 300 AS start, next + 300 AS "end" FROM (SELECT rec_id, ord, cue, "end", lead(start) OVER o AS next, lead(cue) OVER o AS later FROM ({WORDS}) WINDOW o AS (PARTITION BY rec_id ORDER BY ord)) WHERE later <> cue"""
_PADDED = f'SELECT rec_id, start - 200 AS start, "end" + 150 AS "end" FROM ({WORDS})'


@_query(f"""WITH l AS (SELECT rec_id FROM ({WORDS}) GROUP BY rec_id HAVING count(*) >= 3), c AS ({_PAUSES})
 SELECT rec_id, ord, start::BIGINT AS start, "end"::BIGINT AS "end" FROM {_less(f"SELECT * FROM ({_PAUSES}) WHERE rec_id IN (SELECT rec_id FROM l)", MERGED.format(gap=0, of=_PADDED), 200)}
 UNION ALL SELECT rec_id, ord, start, "end" FROM c WHERE rec_id NOT IN (SELECT rec_id FROM l)""")
def protected_pauses(spark, d):
    """Cuts over the pauses between turns, less the words around them and what they need."""
    w = settle(A.words(spark, d).select("rec_id", "ord", "cue", "start", "end"), "words")
    o = Window.partitionBy("rec_id").orderBy("ord")
    cuts = w.withColumn("next", F.lead("start").over(o)).withColumn("then", F.lead("cue").over(o)).filter("then <> cue").select("rec_id", "ord", (F.col("end") - 300).alias("start"), (F.col("next") + 300).alias("end"))
    return intervals.protect_words(cuts, w, 200, 150, 200, 1000).select("rec_id", "ord", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


_CLICKS = f"""SELECT * FROM ({A.SQL['ranges']}) WHERE lane = 'click' AND "end" > start"""


@_query(f"""WITH k AS ({MERGED.format(gap=0, of=_CLICKS)}), p AS (SELECT * FROM {_less(f"SELECT rec_id, ord, start, \"end\" FROM ({A.SQL['ranges']}) WHERE lane <> 'click'", MERGED.format(gap=0, of=_CLICKS))}),
 g AS (SELECT p.*, (SELECT coalesce(sum(k."end" - k.start), 0) FROM k WHERE k.rec_id = p.rec_id AND k."end" <= p.start) AS gone FROM p)
 SELECT rec_id, ord, (row_number() OVER (PARTITION BY rec_id, ord ORDER BY start))::INTEGER AS part, (start - gone)::BIGINT AS start, ("end" - gone)::BIGINT AS "end", (start - s0)::BIGINT AS in_point FROM g""")
def cut_clips(spark, d):
    """A user's other events as clips after its clicks are cut out: split, gaps closed, in points moved."""
    r = A.ranges(spark, d)
    clips = r.filter("lane <> 'click'").select("rec_id", "ord", "start", "end", F.lit(0).cast("long").alias("in_point"), F.lit(1).cast("long").alias("speed"))
    found = timeline.razor_ripple(clips, r.filter("lane = 'click'").select("rec_id", "start", "end"))
    return found.select("rec_id", "ord", F.col("part").cast("int").alias("part"), *[F.col(c).cast("long").alias(c) for c in ("start", "end", "in_point")])
