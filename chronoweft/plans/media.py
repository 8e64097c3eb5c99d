"""Named queries of logs and files, samples and levels, and the timeline's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweft.functions.timecode import half_up
from chronoweft.operators import intervals, signal, timeline
from chronoweft.plans import adapters as A
from chronoweft.plans.catalog import HOUR, _merged, _query
from chronoweft.sources import readers, sinks

WORDS, CUES, RANGES, LEVELS = A.SQL["words"], A.SQL["cues"], A.SQL["ranges"], A.SQL["levels"]


def _lines(rows, line, *order):
    """A text of each recording's lines in order."""
    return sinks._joined(rows, line, *order)


# ---- logs and replies ------------------------------------------------------------------------


@_query(f"""SELECT rec_id, start, "end" FROM ({_merged(f"SELECT * FROM ({RANGES}) WHERE lane = 'view'")})""")
def silence_log(spark, d):
    """Merged views as the log of a silence filter, read again; the last range is left open in the log."""
    m = intervals.merge(A.ranges(spark, d).filter("lane = 'view'"))
    last = F.max("end").over(Window.partitionBy("rec_id"))
    rows = m.withColumn("total", last)
    line = F.concat(F.lit("[silence] silence_start: "), F.col("start").cast("string"), F.when(F.col("end") < F.col("total"), F.concat(F.lit("\n[silence] silence_end: "), F.col("end").cast("string"), F.lit(" | silence_duration: 1"))).otherwise(F.lit("")))
    texts = _lines(rows, line, "start").join(rows.groupBy("rec_id").agg(F.max("total").alias("total")), "rec_id")
    return readers.logged_silences(texts).select("rec_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@_query(f"SELECT rec_id, i, CASE WHEN i % 11 = 5 THEN -100 ELSE db END AS db FROM ({LEVELS})")
def level_log(spark, d):
    """Levels as the log of a statistics filter, some of them minus infinity, read again."""
    text = F.when(F.col("i") % 11 == 5, F.lit("-inf")).otherwise(F.col("db").cast("string"))
    each = F.array(F.concat(F.lit("frame:1 pts_time:"), F.col("i").cast("string")), F.concat(F.lit("lavfi.astats.Overall.RMS_level="), text))
    lines = A.levels(spark, d).select("rec_id", F.posexplode(each).alias("p", "value"), "i").select("rec_id", (F.col("i") * 2 + F.col("p")).alias("k"), "value")
    return readers.logged_levels(lines).select("rec_id", F.col("t").cast("long").alias("i"), F.col("db").cast("long").alias("db"))


@_query(f"SELECT rec_id, CAST(i % 2 AS INTEGER) AS channel, i // 2 AS i, db FROM ({LEVELS})")
def channel_log(spark, d):
    """Levels as those of two channels in a log, read again."""
    n = F.floor(F.col("i") / 2).cast("long")
    each = F.array(F.concat(F.lit("pts_time:"), (n * 0.5).cast("string")), F.concat(F.lit("lavfi.astats."), (F.col("i") % 2 + 1).cast("string"), F.lit(".RMS_level="), F.col("db").cast("string")))
    lines = A.levels(spark, d).select("rec_id", F.posexplode(each).alias("p", "value"), "i").select("rec_id", (F.col("i") * 2 + F.col("p")).alias("k"), "value")
    return readers.channel_levels(lines, 0.5).select("rec_id", "channel", "i", F.col("db").cast("long").alias("db"))


@_query("""SELECT p_partkey AS rec_id, CAST(s AS INTEGER) AS stream, CAST(CASE WHEN s = 0 THEN [1, 2, 6, 4, 8][p_partkey % 5 + 1] ELSE 3 + p_partkey % 9 END AS INTEGER) AS channels FROM part, (SELECT unnest([0, 1]) AS s)""")
def stream_headers(spark, d):
    """A probe's header of two audio streams for each part."""
    layout = F.element_at(F.array(*[F.lit(x) for x in ("mono", "stereo", "5.1(side)", "quad", "7.1")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    text = F.concat(F.lit("  Stream #0:0(und): Audio: aac, 48000 Hz, "), layout, F.lit(", fltp\n  Stream #0:1: Video: h264\n  Stream #0:2: Audio: pcm_s24le, 48000 Hz, "), (F.col("p_partkey") % 9 + 3).cast("string"), F.lit(" channels, s32"))
    return readers.audio_streams(A.table(spark, d, "part").select(F.col("p_partkey").alias("rec_id"), text.alias("value"))).select("rec_id", F.col("stream").cast("int").alias("stream"), F.col("channels").cast("int").alias("channels"))


def _replies(spark, d, unit: float, outer):
    """Words as a recogniser's JSON."""
    w = A.words(spark, d)
    one = F.struct("ord", F.col("text").alias("word"), (F.col("start") / unit).alias("start"), (F.col("end") / unit).alias("end"), F.lit(0.5).alias("confidence"), "speaker")
    all_ = w.groupBy("rec_id").agg(F.array_sort(F.collect_list(one)).alias("words"))
    return all_.select("rec_id", F.to_json(outer("words")).alias("value"))


@_query(f'SELECT rec_id, ord, text, start, "end", speaker FROM ({WORDS})')
def channel_replies(spark, d):
    found = readers.channel_words(_replies(spark, d, 1000.0, lambda w: F.struct(F.struct(F.array(F.struct(F.array(F.struct(w)).alias("alternatives"))).alias("channels")).alias("results"))))
    return found.select("rec_id", "ord", "text", half_up(F.col("start") * 1000).alias("start"), half_up(F.col("end") * 1000).alias("end"), "speaker")


@_query(f'SELECT rec_id, ord, text, start, "end", speaker FROM ({WORDS})')
def flat_replies(spark, d):
    found = readers.flat_words(_replies(spark, d, 1.0, lambda w: F.struct(w)))
    return found.select("rec_id", "ord", "text", half_up(F.col("start") * 1000).alias("start"), half_up(F.col("end") * 1000).alias("end"), "speaker")


@_query(f"""SELECT rec_id, start, "end", CASE speaker WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS speaker FROM ({CUES}) WHERE "end" > start""")
def diarized_turns(spark, d):
    """Turns as a diarizer's lines, read again."""
    n = F.when(F.col("speaker") == "user", 0).when(F.col("speaker") == "assistant", 1).otherwise(2)
    line = F.concat((F.col("start") / 1000).cast("string"), F.lit(" -- "), (F.col("end") / 1000).cast("string"), F.lit(" speaker_0"), n.cast("string"))
    found = readers.speaker_turns(_lines(A.cues(spark, d), line, "start", "ord"))
    return found.select("rec_id", half_up(F.col("start") * 1000).alias("start"), half_up(F.col("end") * 1000).alias("end"), F.col("speaker").cast("int").alias("speaker"))


_CLOCK = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@_query(f"""SELECT rec_id, string_agg(n || chr(10) || {_CLOCK.format('start')} || ' --> ' || {_CLOCK.format('"end"')} || chr(10) || text || chr(10), chr(10) ORDER BY n) AS value FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY start, ord) AS n FROM ({CUES})) GROUP BY rec_id""")
def srt_texts(spark, d):
    return sinks.to_srt(A.seconds(A.cues(spark, d)).withColumnRenamed("ord", "i"))


@_query(f"""SELECT rec_id, string_agg(CASE WHEN start >= 3600000 THEN printf('%d:%02d:%02d', start // 3600000, start // 60000 % 60, start // 1000 % 60) ELSE printf('%d:%02d', start // 60000, start // 1000 % 60) END || ' ' || speaker, chr(10) ORDER BY start, ord) AS value FROM ({CUES}) GROUP BY rec_id""")
def chapter_lists(spark, d):
    return sinks.to_chapters(A.seconds(A.cues(spark, d)).withColumn("title", F.col("speaker")))


@_query(f"""WITH s AS (SELECT rec_id, i, db % 5 + 5 AS state, i % 7 + 1 AS n FROM ({LEVELS})), c AS (SELECT *, sum(n) OVER (PARTITION BY rec_id ORDER BY i) AS upto FROM s),
 m AS (SELECT *, CAST(floor(CAST(upto AS DOUBLE) * 1000000 / 25 + 0.5) AS BIGINT) - CAST(floor(CAST(upto - n AS DOUBLE) * 1000000 / 25 + 0.5) AS BIGINT) AS us FROM c)
 SELECT rec_id, 'ffconcat version 1.0' || chr(10) || string_agg('file ''state-' || state || '.png''' || chr(10) || 'option framerate 25' || chr(10) || 'duration ' || printf('%d.%06d', us // 1000000, us % 1000000), chr(10) ORDER BY i) AS value FROM m GROUP BY rec_id""")
def concat_lists(spark, d):
    """Levels as stills of one to seven frames."""
    plan = A.levels(spark, d).select("rec_id", F.col("i").alias("segment"), (F.col("db") % 5 + 5).alias("state"), (F.col("i") % 7 + 1).alias("frames"))
    return sinks.to_concat(plan, 25.0)


# ---- samples and levels ------------------------------------------------------------------------

_SAMPLES = "SELECT vec_id AS rec_id, generate_subscripts(embedding, 1) - 1 AS n, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"


def _samples(spark, d):
    """A vector's components as samples."""
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("rec_id"), F.posexplode("embedding").alias("n", "v"))
    return e.select("rec_id", F.col("n").cast("long").alias("n"), F.col("v").cast("double").alias("v"))


def _milli(db):
    return F.round(F.col(db) * 1000).cast("long").alias("milli")


@_query(f"""WITH e AS (SELECT rec_id, n // 8 AS i, sum(v * v) AS e FROM ({_SAMPLES}) GROUP BY ALL), m AS (SELECT *, (coalesce(lag(e) OVER w, e) + e + coalesce(lead(e) OVER w, e)) / 24 AS m FROM e WINDOW w AS (PARTITION BY rec_id ORDER BY i))
 SELECT rec_id, i, CAST(round(CASE WHEN m > 1e-12 THEN 10 * log10(m) ELSE -120 END * 1000) AS BIGINT) AS milli FROM m""")
def sample_envelope(spark, d):
    return signal.envelope(_samples(spark, d), 800).select("rec_id", "i", _milli("db"))


@_query(f"SELECT rec_id, n // 10 AS i, CAST(round(10 * log10(greatest(1e-9, avg(v * v))) * 1000) AS BIGINT) AS milli FROM ({_SAMPLES}) GROUP BY rec_id, n // 10")
def sample_steps(spark, d):
    return signal.step_levels(_samples(spark, d), 100, 0.1).select("rec_id", "i", _milli("db"))


@_query(f"SELECT rec_id, n // 2 AS n, CAST(round(avg(v) * 1000000) AS BIGINT) AS v FROM ({_SAMPLES}) GROUP BY rec_id, n // 2")
def mono_samples(spark, d):
    """Every two components as two channels."""
    s = _samples(spark, d).withColumn("n", F.floor(F.col("n") / 2).cast("long"))
    return signal.mono(s).select("rec_id", "n", F.round(F.col("v") * 1000000).cast("long").alias("v"))


@_query(f"""WITH w AS (SELECT *, avg(v * v) OVER (PARTITION BY rec_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS p, max(n) OVER (PARTITION BY rec_id) + 1 AS total FROM ({_SAMPLES})),
 r AS (SELECT rec_id, n // 2 AS i, total, sqrt(p) >= 0.1 AS loud FROM w WHERE n % 2 = 0 AND n + 8 <= total), g AS (SELECT *, i - row_number() OVER (PARTITION BY rec_id, loud ORDER BY i) AS g, max(i) OVER (PARTITION BY rec_id) AS final FROM r)
 SELECT rec_id, min(i) * 2 AS start, CASE WHEN max(i) = max(final) THEN max(total) ELSE (max(i) + 1) * 2 END AS "end" FROM g WHERE NOT loud GROUP BY rec_id, g""")
def sample_silences(spark, d):
    found = signal.fixed_silences(_samples(spark, d), 100, -20.0, 0.08, 0.02)
    return found.select("rec_id", half_up(F.col("start") * 100).alias("start"), half_up(F.col("end") * 100).alias("end"))


@_query(f"""WITH m AS ({_merged(gap=HOUR)}), p AS (SELECT rec_id, start + CASE WHEN start <= 0.001 THEN 0 ELSE {HOUR // 4} END AS start, "end" - {HOUR // 4} AS "end" FROM m WHERE "end" - start >= {2 * HOUR})
 SELECT rec_id, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM p WHERE "end" - start >= {2 * HOUR - HOUR // 2}""")
def refined_silences(spark, d):
    return signal.refine_silences(A.ranges(spark, d), 2 * HOUR, HOUR // 4, HOUR).select("rec_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@_query(f"WITH g AS ({A.SQL['grid']}) SELECT CAST(rec_id AS BIGINT) AS rec_id, mic, CAST(count(*) FILTER (db > -99) AS BIGINT) AS heard, CAST(coalesce(max(w + 1) FILTER (db > -99), 0) AS BIGINT) AS last_heard FROM g GROUP BY rec_id, mic")
def mic_coverage(spark, d):
    g = A.grid(spark, d)
    n = g.groupBy("rec_id").agg((F.max("w") + 1).alias("n"))
    return signal.mic_coverage(g, 1.0).join(n, "rec_id").select("rec_id", "mic", F.round(F.col("heard") * F.col("n")).cast("long").alias("heard"), F.col("last_heard").cast("long").alias("last_heard"))


@_query(f"""WITH g AS ({A.SQL['grid']}), o AS (SELECT rec_id, w, CASE WHEN max(db) > 20 THEN 2 ELSE 1 END AS state FROM g WHERE mic <> 'click' GROUP BY rec_id, w),
 b AS (SELECT o.rec_id, state, db FROM o JOIN g USING (rec_id, w) WHERE mic = 'click' AND db > -90), r AS (SELECT *, row_number() OVER (PARTITION BY rec_id, state ORDER BY db) - 1 AS k, count(*) OVER (PARTITION BY rec_id, state) AS n FROM b)
 SELECT CAST(rec_id AS BIGINT) AS rec_id, count(*) FILTER (state = 2) AS talk, count(*) FILTER (state = 1) AS quiet, CAST(CASE WHEN count(*) FILTER (state = 2) >= 50 AND count(*) FILTER (state = 1) >= 50 THEN max(db) FILTER (state = 1 AND k = floor(0.9 * (n - 1))) - max(db) FILTER (state = 2 AND k = floor(0.9 * (n - 1))) ELSE 0 END AS BIGINT) AS turn FROM r GROUP BY rec_id""")
def track_against_others(spark, d):
    """One event type as a track beside the others, which talk where any of them is above 20."""
    g = A.grid(spark, d).withColumnRenamed("w", "slot")
    others = g.filter("mic <> 'click'").groupBy("rec_id", "slot").agg(F.when(F.max("db") > 20, 2).otherwise(1).alias("state"))
    return signal.versus_others(others, g.filter("mic = 'click'").select("rec_id", "slot", "db")).select("rec_id", "talk", "quiet", F.col("turn").cast("long").alias("turn"))


# ---- ranges and the timeline's tables ------------------------------------------------------------


@_query(f"""WITH k AS (SELECT rec_id, "end" - start AS d, row_number() OVER (PARTITION BY rec_id ORDER BY "end" - start) - 1 AS k, count(*) OVER (PARTITION BY rec_id) AS n FROM ({RANGES})) SELECT rec_id, max(d) FILTER (k = n // 2) <= {12 * HOUR} AND max(n) >= 3 AS word_level FROM k GROUP BY rec_id""")
def word_level(spark, d):
    return intervals.is_word_level(A.ranges(spark, d), 12 * HOUR)


@_query(f"""WITH k AS (SELECT *, coalesce(sum("end" - start) OVER (PARTITION BY rec_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at0 FROM ({_merged(f"SELECT * FROM ({RANGES}) WHERE lane = 'view'")})),
 h AS (SELECT i.rec_id, i.ord, CAST(at0 + greatest(i.start, k.start) - k.start AS BIGINT) AS start, CAST(at0 + least(i."end", k."end") - k.start AS BIGINT) AS "end", row_number() OVER (PARTITION BY i.rec_id, i.ord ORDER BY k.start) AS r FROM ({RANGES}) i JOIN k ON k.rec_id = i.rec_id AND i.start < k."end" AND i."end" > k.start WHERE lane = 'click')
 SELECT rec_id, ord, start, "end" FROM h WHERE r = 1""")
def remap_first(spark, d):
    r = A.ranges(spark, d)
    return intervals.remap_first_overlap(r.filter("lane = 'click'"), intervals.merge(r.filter("lane = 'view'"))).select("rec_id", "ord", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


_GONE = f"""SELECT *, coalesce(sum("end" - start) OVER (PARTITION BY rec_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM ({_merged(f"SELECT * FROM ({RANGES}) WHERE lane = 'view'")})"""
_REMOVED = 'coalesce((SELECT gone + least({t}, m."end") - m.start FROM m WHERE m.rec_id = p.rec_id AND m.start < {t} ORDER BY m.start DESC LIMIT 1), 0)'


@_query(f"""WITH m AS ({_GONE}), p AS (SELECT * FROM ({RANGES}) WHERE lane = 'click') SELECT rec_id, ord, CAST({_REMOVED.format(t='p.start')} AS BIGINT) AS removed FROM p""")
def removed_time(spark, d):
    r = A.ranges(spark, d)
    return intervals.removed_before(r.filter("lane = 'click'").select("rec_id", "ord", F.col("start").alias("t")), r.filter("lane = 'view'")).select("rec_id", "ord", F.col("removed").cast("long").alias("removed"))


@_query(f"""WITH m AS ({_GONE}), p AS (SELECT * FROM ({RANGES}) WHERE lane = 'click' AND ord % 10 <> 3), s AS (SELECT rec_id, ord, start - {_REMOVED.format(t='p.start')} AS s, "end" - {_REMOVED.format(t='p."end"')} AS e FROM p)
 SELECT rec_id, ord, CAST(s AS BIGINT) AS start, CAST(greatest(s, e) AS BIGINT) AS "end" FROM s""")
def shifted_markers(spark, d):
    """Clicks as markers, every tenth of them a preview, after the views are cut."""
    r = A.ranges(spark, d)
    marks = r.filter("lane = 'click'").select("rec_id", "ord", F.when(F.col("ord") % 10 == 3, F.lit("Preview 2")).otherwise(F.lit("Mark")).alias("name"), "start", "end")
    return timeline.shift_markers(marks, r.filter("lane = 'view'"), "Preview").select("rec_id", "ord", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def _clips(spark, d):
    """Events as clips in seconds: a user is a sequence."""
    r = A.ranges(spark, d)
    return r.select(F.col("rec_id").alias("sequence_id"), "rec_id", F.col("ord").alias("clip_id"), F.col("lane").alias("track"), F.lit("audio").alias("kind"), F.col("lane").alias("media"), (F.col("start") / 1000000).alias("start"), (F.col("end") / 1000000).alias("end"), F.lit(0.0).alias("in_point"), (F.col("ord") % 7 == 2).alias("muted"), (F.col("ord") % 5 == 1).alias("disabled"), (F.col("ord") % 11 == 4).alias("reversed"), F.when(F.col("ord") % 13 == 6, F.lit(2.0)).alias("speed"), (F.col("ord") % 3 == 0).alias("selected"))


@_query(f'SELECT rec_id AS sequence_id, count(*) AS n, CAST(sum(start // 1000) AS BIGINT) AS start_ms, max("end") AS last FROM ({RANGES}) GROUP BY rec_id')
def sequence_fingerprints(spark, d):
    return timeline.fingerprint(_clips(spark, d).withColumn("start", F.floor(F.col("start") * 1000 + 1e-4) / 1000)).select("sequence_id", "n", "start_ms", half_up(F.col("last") * 1000000).alias("last"))


@_query(f'SELECT rec_id, ord AS clip_id FROM ({RANGES}) WHERE (start + "end") / 2 > 1704500000000000 + 1000 AND (start + "end") / 2 < 1706000000000000 - 1000')
def clips_between(spark, d):
    return timeline.clips_in_range(_clips(spark, d), 1704500000.0, 1706000000.0).select("rec_id", "clip_id")


@_query(f"""SELECT rec_id, lane AS track, ord, "end" - start AS dur, start AS at FROM ({RANGES}) WHERE NOT (ord % 7 = 2 OR ord % 5 = 1 OR ord % 11 = 4 OR ord % 13 = 6)""")
def plain_pieces(spark, d):
    c = _clips(spark, d).withColumn("in_point", F.col("clip_id").cast("double"))
    return timeline.pieces_of(c).select("rec_id", "track", F.col("from").cast("long").alias("ord"), half_up(F.col("dur") * 1000000).alias("dur"), half_up(F.col("at") * 1000000).alias("at"))


@_query(f"""SELECT rec_id, ord AS clip_id, lane || '!' AS track_name, min(start) FILTER (ord % 3 = 0) OVER (PARTITION BY rec_id) AS selection_start, max("end") FILTER (ord % 3 = 0) OVER (PARTITION BY rec_id) AS selection_end FROM ({RANGES}) WHERE lane <> 'error'""")
def cut_sources(spark, d):
    c = _clips(spark, d)
    tracks = c.filter("track <> 'error'").select("sequence_id", "kind", "track").distinct().select("*", F.concat("track", F.lit("!")).alias("name"), F.lit(False).alias("muted"), F.lit(False).alias("locked"))
    found = timeline.sources(c.drop("muted"), tracks)
    return found.select("rec_id", "clip_id", "track_name", half_up(F.col("selection_start") * 1000000).alias("selection_start"), half_up(F.col("selection_end") * 1000000).alias("selection_end"))


@_query("""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM (SELECT page_id, url || ['.mp3', '.mov', '.jpg', '.srt', '/bgm_theme.wav', '/x-proxy.mp4', '.cube', '.aep', '.doc', '.zzz'][page_id % 10 + 1] AS url FROM pages))
 SELECT page_id, CASE WHEN ext IN ('mp3', 'wav') THEN CASE WHEN regexp_matches(url, '(?i)(^|[\\s._-])(vo|voiceover|voice-over|narration|dialogue|dialog|adr)($|[\\s._-])') THEN 'voiceover' WHEN regexp_matches(url, '(?i)(^|[\\s._-])(music|song|score|soundtrack|bgm|instrumental|theme)($|[\\s._-])') THEN 'music' WHEN regexp_matches(url, '(?i)(^|[\\s._-])(sfx|sound-effect|sound_effect|soundeffect|foley|ambience|ambient|whoosh|impact|riser|roomtone|room-tone)($|[\\s._-])') THEN 'sfx' ELSE 'audio' END
 WHEN ext IN ('mov', 'mp4') THEN CASE WHEN regexp_matches(url, '(?i)(^|[\\s._-])(proxy|proxies)($|[\\s._-])') THEN 'proxy' ELSE 'video' END WHEN ext = 'jpg' THEN 'image' WHEN ext = 'srt' THEN 'caption' WHEN ext = 'cube' THEN 'lut' WHEN ext = 'aep' THEN 'afterEffects' WHEN ext = 'doc' THEN 'document' ELSE 'other' END AS kind FROM u""")
def asset_kinds(spark, d):
    """Pages' addresses with endings of files as assets."""
    tail = F.element_at(F.array(*[F.lit(x) for x in (".mp3", ".mov", ".jpg", ".srt", "/bgm_theme.wav", "/x-proxy.mp4", ".cube", ".aep", ".doc", ".zzz")]), (F.col("page_id") % 10 + 1).cast("int"))
    p = A.table(spark, d, "pages").select("page_id", F.concat("url", tail).alias("name"))
    return p.select("page_id", timeline.asset_class(F.col("name"), F.lit(None).cast("string"), F.lit(False)).alias("kind"))


@_query(f"""WITH s AS (SELECT rec_id, start, (row_number() OVER (PARTITION BY rec_id ORDER BY start, "end") - 1) // 2 % 3 AS angle, CAST(floor(start / 3600000000.0 + 0.5) AS BIGINT) AS s, CAST(floor("end" / 3600000000.0 + 0.5) AS BIGINT) AS e FROM ({_merged()})),
 f AS (SELECT *, sum(b) OVER (PARTITION BY rec_id ORDER BY start) AS g FROM (SELECT *, CASE WHEN lag(angle) OVER (PARTITION BY rec_id ORDER BY start) = angle THEN 0 ELSE 1 END AS b FROM s WHERE e > s))
 SELECT rec_id, angle, min(s) AS s, max(e) AS e FROM f GROUP BY rec_id, g, angle""")
def snapped_shots(spark, d):
    """Merged activity as shots, on hours."""
    m = intervals.merge(A.ranges(spark, d))
    n = F.floor((F.row_number().over(intervals._w("start", "end")) - 1) / 2) % 3
    plan = m.select("rec_id", n.cast("long").alias("angle"), (F.col("start") / 3600000000.0).alias("start"), (F.col("end") / 3600000000.0).alias("end"))
    return timeline.snap_plan(plan, 1.0).select("rec_id", "angle", "s", "e")


@_query(f"""WITH p AS (SELECT rec_id, i, i % 3 AS src, 0.5 + i % 4 AS dur, CAST(db AS DOUBLE) AS lufs FROM ({LEVELS})), g AS (SELECT *, lufs > -60 AND dur >= 0.8 AS good FROM p),
 r AS (SELECT *, sum(dur) OVER (PARTITION BY rec_id ORDER BY lufs, i) AS u, sum(dur) OVER (PARTITION BY rec_id) AS t FROM g WHERE good), m AS (SELECT rec_id, min(lufs) AS m FROM r WHERE u >= t / 2 GROUP BY rec_id),
 o AS (SELECT g.*, CASE WHEN good THEN CASE WHEN abs(greatest(-10, least(10, m - lufs))) < 1 THEN 0 ELSE greatest(-10, least(10, m - lufs)) END END AS own FROM g LEFT JOIN m USING (rec_id))
 SELECT rec_id, i, CAST(coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY rec_id, src ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS gain FROM o""")
def piece_gains(spark, d):
    p = A.levels(spark, d).select("rec_id", F.col("i").alias("ord"), (F.col("i") % 3).alias("src"), (0.5 + F.col("i") % 4).cast("double").alias("dur"), F.col("db").cast("double").alias("lufs"))
    return timeline.piece_gains(p).select("rec_id", F.col("ord").alias("i"), F.col("gain").cast("long").alias("gain"))

