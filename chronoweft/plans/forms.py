"""Named queries of the functions on clocks, words, lines and frames, and of the joins of timelines, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.functions import text as X
from chronoweft.functions import timecode as T
from chronoweft.functions import words as lists
from chronoweft.operators import captions, intervals, joins
from chronoweft.plans import adapters as A
from chronoweft.plans.catalog import HOUR, _IN, _merged, _query

WORDS, CUES, RANGES = A.SQL["words"], A.SQL["cues"], A.SQL["ranges"]
DOCS = "SELECT doc_id, text FROM documents"


def _docs(spark, d):
    return A.table(spark, d, "documents")


# ---- clocks ----------------------------------------------------------------------------


@_query(f"""SELECT rec_id, ord, printf('%02d:%02d:%02d,%03d', start // 3600000, start // 60000 % 60, start // 1000 % 60, start % 1000) AS srt,
 printf('%d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS ass,
 CASE WHEN start >= 3600000 THEN printf('%d:%02d:%02d', start // 3600000, start // 60000 % 60, start // 1000 % 60) ELSE printf('%d:%02d', start // 60000, start // 1000 % 60) END AS clock,
 printf('%d:%02d', (start + 500) // 60000, (start + 500) // 1000 % 60) AS short, start AS back FROM (SELECT *, CAST(floor(CAST(start AS DOUBLE) / 1000 * 100 + 0.5) AS BIGINT) AS cs FROM ({WORDS}))""")
def clock_forms(spark, d):
    w = A.seconds(A.words(spark, d))
    return w.select("rec_id", "ord", T.srt_time("start").alias("srt"), T.ass_time("start").alias("ass"), T.timecode("start").alias("clock"), T.mmss("start").alias("short"), F.round(T.srt_seconds(T.srt_time("start")) * 1000).cast("long").alias("back"))


@_query("""WITH q AS (SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS v FROM lineitem), r AS (SELECT v AS rate FROM q UNION ALL SELECT v - 0.03 FROM q UNION ALL SELECT round(v * 1000 / 1001, 3) FROM q),
 n AS (SELECT unnest([24000, 30000, 48000, 60000, 120000]) AS n),
 e AS (SELECT rate, first(n ORDER BY n) FILTER (abs(rate - n / 1001.0) < 0.01) AS wide, first(n ORDER BY n) FILTER (abs(rate - n / 1001.0) < 0.002) AS narrow FROM r CROSS JOIN n GROUP BY rate)
 SELECT CAST(round(rate * 1000) AS BIGINT) AS rate, CAST(round(coalesce(wide / 1001.0, rate) * 1000000) AS BIGINT) AS exact_u,
 coalesce(narrow || '/1001', CASE WHEN abs(rate - round(rate)) < 0.002 THEN CAST(CAST(floor(rate + 0.5) AS BIGINT) AS VARCHAR) END, CAST(floor(rate * 1000 + 0.5) / 1000 AS VARCHAR)) AS rational,
 CAST(round(pow(10.0, -rate / 20) * 1000000) AS BIGINT) AS linear_u FROM e""")
def frame_rates(spark, d):
    q = A.table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("v")).distinct()
    r = q.select(F.explode(F.array(F.col("v"), F.col("v") - 0.03, F.round(F.col("v") * 1000 / 1001, 3))).alias("rate")).distinct()
    return r.select(F.round(F.col("rate") * 1000).cast("long").alias("rate"), F.round(T.fps_exact("rate") * 1000000).cast("long").alias("exact_u"), T.fps_rational("rate").alias("rational"), F.round(T.db_to_linear(-F.col("rate")) * 1000000).cast("long").alias("linear_u"))


# ---- words -----------------------------------------------------------------------------


@_query(f"""SELECT rec_id, ord, regexp_replace(regexp_replace(text, '^[\\s"''“”‘’(\\[{{¿¡]+', ''), '[\\s"''“”‘’.,!?;:)\\]}}…—–]+$', '') AS stripped,
 upper(replace(substr(text, 1, 1), 'ß', 'ss')) || lower(substr(text, 2)) AS title, upper(replace(text, 'ß', 'ss')) AS upper,
 regexp_replace(lower(text), '[^a-z0-9''\\x{{0900}}-\\x{{0963}}\\x{{0966}}-\\x{{097F}}]', '', 'g') AS keyword,
 regexp_replace(regexp_replace(translate(lower(text), '‘’ʼ`', ''''''''''), '[^\\p{{L}}\\p{{M}}\\p{{N}}'']', '', 'g'), '^''+|''+$', '', 'g') AS spoken,
 regexp_replace(lower(text), '^[\\s"''“”‘’(\\[¿¡]+|[\\s"''“”‘’)\\].,!?;:…।॥۔؟-]+$', '', 'g') AS edge FROM ({WORDS})""")
def word_forms(spark, d):
    w = A.words(spark, d)
    return w.select("rec_id", "ord", X.strip_punctuation("text").alias("stripped"), X.case_word("text", "title").alias("title"), X.case_word("text", "upper").alias("upper"), X.keyword("text").alias("keyword"), X.spoken("text").alias("spoken"), X.edge_trimmed("text").alias("edge"))


@_query(f"""WITH w AS (SELECT rec_id, ord, text, regexp_replace(text, '["''»)\\]”’]+$', '') AS v, regexp_replace(lower(text), '[^a-z]', '', 'g') AS l FROM ({WORDS})),
 c AS (SELECT *, regexp_replace(v, '\\.+$', '') AS core, regexp_replace(regexp_replace(l, '(?:[^laeiouy]es|[^laeiouy]e|ed)$', ''), '^y', '') AS nucleus FROM w)
 SELECT rec_id, ord, regexp_matches(v, '[!?।॥۔]$') OR (regexp_matches(v, '\\.$') AND lower(core) NOT IN ({_IN(lists.ABBREVIATIONS)}) AND NOT ((regexp_matches(core, '^([A-Za-z]\\.)*[A-Za-z]$') AND regexp_matches(core, '[A-Z]')) OR regexp_matches(core, '^([a-z]\\.)+[a-z]$'))) AS sentence_end,
 regexp_replace(lower(text), '^[\\s"''“”‘’(\\[¿¡]+|[\\s"''“”‘’)\\].,!?;:…।॥۔؟-]+$', '', 'g') IN ({_IN(lists.HESITATIONS)}) AS hesitation,
 CAST(CASE WHEN length(l) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(nucleus, '[aeiouy]{{1,2}}'))) END AS INTEGER) AS syllables,
 CAST(round(CASE WHEN regexp_matches(lower(text), '^[^aeiouy]+[aeiouy]') THEN least(0.4, length(regexp_extract(lower(text), '^[^aeiouy]+')) / greatest(1, length(text)) * 0.6) ELSE 0 END * 1000000) AS BIGINT) AS onset_u FROM c""")
def word_measures(spark, d):
    w = A.words(spark, d)
    return w.select("rec_id", "ord", X.is_sentence_end("text").alias("sentence_end"), X.is_hesitation("text").alias("hesitation"), X.syllables("text").cast("int").alias("syllables"), F.round(X.onset_share("text") * 1000000).cast("long").alias("onset_u"))


@_query(f"""WITH w AS (SELECT rec_id, ord, text, k, regexp_replace(text, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') AS clean FROM ({WORDS}))
 SELECT rec_id, ord, CAST(round(CASE WHEN clean = '' OR (NOT regexp_matches(text, '\\d') AND (length(clean) < 3 OR lower(clean) IN ({_IN(lists.STOP)}) OR lower(clean) IN ({_IN(lists.LIGHT_WORDS)}))) THEN 0
 ELSE 1 + least(4, greatest(0, length(clean) - 3) * 0.5) + CASE WHEN regexp_matches(text, '\\d') THEN 3.5 ELSE 0 END + CASE WHEN regexp_matches(clean, '^[A-Z][a-z]{{2,}}') AND k > 0 THEN 2.5 ELSE 0 END + CASE WHEN lower(clean) IN ({_IN(lists.CALLS)}) THEN 2 ELSE 0 END END * 10) AS BIGINT) AS tenths FROM w""")
def word_salience(spark, d):
    return A.words(spark, d).select("rec_id", "ord", F.round(X.salience("text", F.col("k")) * 10).cast("long").alias("tenths"))


@_query(f"""SELECT rec_id, ord, CASE WHEN regexp_replace(lower(text), '[^a-z]', '', 'g') IN ({_IN(lists.PROFANITY)}) THEN regexp_extract(text, '^[^A-Za-z]*[A-Za-z]') || regexp_replace(substr(text, length(regexp_extract(text, '^[^A-Za-z]*[A-Za-z]')) + 1), '[A-Za-z]', '*', 'g') ELSE text END AS text
 FROM (SELECT rec_id, ord, CASE WHEN ord % 7 = 3 THEN '"' || upper({_IN(["shit"])}) || '!"' ELSE text END AS text FROM ({WORDS}))""")
def censored_text(spark, d):
    """The words of conversations, every seventh of them a listed one, as they are shown."""
    w = A.words(spark, d).withColumn("text", F.when(F.col("ord") % 7 == 3, F.lit('"SHIT!"')).otherwise(F.col("text")))
    return w.select("rec_id", "ord", X.censor("text").alias("text"))


@_query(f"""WITH c AS (SELECT rec_id, cue AS ord, list(lower(text) ORDER BY k) AS ws FROM ({WORDS}) GROUP BY rec_id, cue), p AS (SELECT *, list_position(list_transform(ws, lambda w: regexp_matches(w, '[A-Za-z]')), true) AS pos FROM c)
 SELECT rec_id, ord, array_to_string(list_transform(ws, lambda w, k: CASE WHEN k = pos THEN upper(substr(w, 1, 1)) || substr(w, 2) ELSE w END), ' ') AS text FROM p""")
def sentence_case(spark, d):
    return A.cues(spark, d).select("rec_id", "ord", F.array_join(X.case_words(F.split("text", " "), "sentence"), " ").alias("text"))


# ---- lines -----------------------------------------------------------------------------


@_query(f"""WITH c AS (SELECT rec_id, ord, '<b>' || speaker || ': ' || text || '</b> {{\\an8}}' AS line FROM ({CUES})),
 t AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '</?[a-zA-Z][^>]*>', '', 'g'), '<\\d[\\d:.,]*>', '', 'g'), '\\{{\\\\[^}}]*\\}}', '', 'g'), '[ \\t]+\\n', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS clean FROM c),
 s AS (SELECT *, trim(regexp_extract(clean, '^\\s*([A-Za-z][\\w .''\\-]{{0,24}}?)\\s*[:：]\\s+(.+)$', 1)) AS name, regexp_extract(clean, '^\\s*([A-Za-z][\\w .''\\-]{{0,24}}?)\\s*[:：]\\s+(.+)$', 2) AS said FROM t)
 SELECT rec_id, ord, clean, name AS speaker, said AS text FROM s""")
def cue_cleaning(spark, d):
    """Turns as tagged lines with the speaker's name, cleaned and parted again."""
    c = A.cues(spark, d).select("rec_id", "ord", F.concat(F.lit("<b>"), "speaker", F.lit(": "), "text", F.lit("</b> {\\an8}")).alias("line"))
    c = c.withColumn("clean", X.clean_cue("line")).withColumn("s", X.speaker_of("clean"))
    return c.select("rec_id", "ord", "clean", "s.speaker", "s.text")


_STOCK = "(?i)^(thanks for watching|thank you|please subscribe|subscribe|bye|you|okay|ok|so|the|♪+|music)\\.?$"


@_query(f"""WITH w AS (SELECT rec_id, ord, CASE WHEN ord % 5 = 1 THEN '[' || text || ']' WHEN ord % 5 = 2 THEN ' ' || substr(text, 1, 1) || '. ' ELSE text END AS t FROM ({WORDS})), s AS (SELECT rec_id, ord, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t FROM w)
 SELECT rec_id, ord, t = '' OR regexp_matches(t, '^[\\[(].*[\\])]$') OR length(regexp_replace(t, '[^A-Za-z0-9\\x{{0900}}-\\x{{097F}}]', '', 'g')) <= 1 OR regexp_matches(t, '{_STOCK}') AS silent FROM s""")
def non_speech(spark, d):
    """Words, some in brackets and some cut to a letter, that a recogniser would write over silence."""
    t = F.when(F.col("ord") % 5 == 1, F.concat(F.lit("["), "text", F.lit("]"))).when(F.col("ord") % 5 == 2, F.concat(F.lit(" "), F.substring("text", 1, 1), F.lit(". "))).otherwise(F.col("text"))
    return A.words(spark, d).select("rec_id", "ord", X.is_non_speech(t).alias("silent"))


def _whole_word(choices: str, anchored: bool = False) -> str:
    letters = "A-Za-z0-9_\\x{0900}-\\x{0963}\\x{0966}-\\x{097F}"
    return ("(?i)" + ("^" if anchored else f"(?:^|[^{letters}])") + f"(?:{choices})(?:$|[^{letters}])").replace("'", "''")


_HOOK = f"""CASE WHEN regexp_matches(t, '\\?\\s*$') OR regexp_matches(t, '{_whole_word(lists.QUESTION_START, True)}') OR (regexp_matches(t, '{_whole_word(lists.HINDI_QUESTION)}') AND regexp_matches(t, '(?i)(?:^|[^A-Za-z0-9_\\x{{0900}}-\\x{{0963}}\\x{{0966}}-\\x{{097F}}])(?:{lists.HINDI_VERB_END})[\\s,.!।]*$')) THEN 22 ELSE 0 END
 + CASE WHEN regexp_matches(t, '{_whole_word(lists.STRONG)}') THEN 18 ELSE 0 END + CASE WHEN regexp_matches(t, '\\d|[०-९]|%') OR regexp_matches(t, '{_whole_word(lists.NUMBERS)}') THEN 10 ELSE 0 END
 + CASE WHEN regexp_matches(t, '{_whole_word(lists.YOU)}') THEN 8 ELSE 0 END - CASE WHEN regexp_matches(t, '{_whole_word(lists.CONNECTIVE, True)}') THEN 25 ELSE 0 END - CASE WHEN regexp_matches(t, '{_whole_word(lists.BACK_REFERENCE)}') THEN 20 ELSE 0 END"""


@_query(f"SELECT rec_id, ord, CAST({_HOOK} AS INTEGER) AS score FROM (SELECT rec_id, ord, trim(text) AS t FROM ({CUES}))")
def hook_scores(spark, d):
    return A.cues(spark, d).select("rec_id", "ord", X.hook_score("text").cast("int").alias("score"))


@_query(f"""WITH c AS (SELECT rec_id, ord, text, list_filter(regexp_split_to_array(regexp_replace(text, '["“”]', '', 'g'), '\\s+'), lambda w: w <> '') AS ws, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM ({CUES})),
 t AS (SELECT *, regexp_replace(array_to_string(CASE WHEN len(ws) <= 8 THEN ws ELSE ws[1:6] END, ' '), '[,;:–—-]+$', '') || CASE WHEN len(ws) <= 8 THEN '' ELSE '…' END AS raw FROM c)
 SELECT rec_id, ord, CASE WHEN raw = '' THEN 'Clip' ELSE upper(substr(raw, 1, 1)) || substr(raw, 2) END AS title, CASE WHEN length(flat) > 60 THEN regexp_replace(substr(flat, 1, 57), '\\s+\\S*$', '') || '…' ELSE flat END AS post,
 array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN regexp_matches(w, '^[a-z]') THEN upper(substr(w, 1, 1)) || substr(w, 2) ELSE w END), ' ') AS cased FROM t""")
def line_titles(spark, d):
    return A.cues(spark, d).select("rec_id", "ord", X.title_of("text").alias("title"), X.post_title("text").alias("post"), X.title_case("text").alias("cased"))


@_query(f"""WITH c AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 f AS (SELECT doc_id, len(regexp_extract_all(t, '[\\x{{0900}}-\\x{{097F}}]')) AS deva, len(regexp_extract_all(t, '[A-Za-z]')) AS latin, regexp_extract_all(lower(t), '[a-z]+') AS ws, regexp_split_to_array(t, '\\s+') AS parts, t FROM c)
 SELECT doc_id, regexp_matches(t, '[A-Za-z]') AS latin, regexp_matches(t, '[\\x{{0900}}-\\x{{097F}}]') AS devanagari,
 CASE WHEN deva > 20 AND deva > latin THEN 'hi' WHEN len(ws) >= 8 AND len(list_filter(ws, lambda w: w IN ({_IN(lists.HINDI_WORDS)}))) / len(ws) >= 0.08 THEN 'hinglish' END AS language FROM f""")
def script_languages(spark, d):
    return _docs(spark, d).withColumn("n", X.script_needs("text")).select("doc_id", "n.latin", "n.devanagari", X.script_language("text").alias("language"))


@_query(f"""WITH u AS (SELECT page_id, list_last(string_split_regex(coalesce(url, ''), '[\\\\/]')) AS name FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(name, '\\.[^.]+$', ''), '([a-z])([A-Z])', '\\1 \\2', 'g') AS b FROM u),
 p AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(b, '[^A-Za-z0-9\\x{{0900}}-\\x{{097F}}]+'), lambda w: regexp_replace(lower(w), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda w: w <> '' AND w NOT IN ({_IN(lists.FILE_SKIP)}) AND NOT regexp_matches(w, '^\\d+$')) AS ws FROM b)
 SELECT page_id, array_to_string(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: list_position(ws, x[1]) = x[2]), lambda x: x[1])[1:3], ' ') AS words FROM p""")
def file_words(spark, d):
    """What the last part of a page's address says."""
    return A.table(spark, d, "pages").select("page_id", F.array_join(X.file_keywords("url"), " ").alias("words"))


@_query(f"""WITH c AS (SELECT rec_id, ord, CAST(floor(start / 1000.0 * 25 + 0.5) AS BIGINT) AS s, CAST(floor("end" / 1000.0 * 25 + 0.5) AS BIGINT) AS e FROM ({CUES}) WHERE trim(text) <> ''),
 p AS (SELECT *, (row_number() OVER w - 1) * 3 AS p FROM c WINDOW w AS (PARTITION BY rec_id ORDER BY s, ord)), q AS (SELECT *, max(s - p) OVER (PARTITION BY rec_id ORDER BY p) + p AS b FROM p), n AS (SELECT *, lead(b) OVER (PARTITION BY rec_id ORDER BY p) AS nxt, greatest(e + 13, b + 25) AS want FROM q)
 SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY p) AS i, CAST(b AS BIGINT) AS s, CAST(greatest(CASE WHEN nxt IS NULL THEN want WHEN nxt - least(want, nxt - 2) < 13 THEN nxt - 2 ELSE least(want, nxt - 2) END, b + 1) AS BIGINT) AS e FROM n""")
def subtitle_frames(spark, d):
    """First and last frames of two-line subtitles."""
    return captions.native_subtitles(A.seconds(A.cues(spark, d)), 25.0).select("rec_id", "i", "s", "e")


# ---- colours and frames ------------------------------------------------------------------


def _hex(of: str) -> str:
    return f"CAST(('0x' || {of}) AS BIGINT)"


def _lum(c: str) -> str:
    part = lambda k: f"(CASE WHEN {_hex(f'substr({c}, {1 + 2 * k}, 2)')} / 255.0 <= 0.03928 THEN {_hex(f'substr({c}, {1 + 2 * k}, 2)')} / 255.0 / 12.92 ELSE pow(({_hex(f'substr({c}, {1 + 2 * k}, 2)')} / 255.0 + 0.055) / 1.055, 2.4) END)"
    return f"(0.2126 * {part(0)} + 0.7152 * {part(1)} + 0.0722 * {part(2)})"


_MIX = "||".join(f"printf('%02x', CAST(floor({_hex(f'substr(a, {1 + 2 * k}, 2)')} + (255 - {_hex(f'substr(a, {1 + 2 * k}, 2)')}) * 0.25 + 0.5) AS BIGINT))" for k in range(3))


@_query(f"""WITH p AS (SELECT p_partkey, substr(md5(CAST(p_partkey AS VARCHAR)), 1, 6) AS a, substr(md5(CAST(p_partkey AS VARCHAR)), 7, 6) AS b FROM part), l AS (SELECT *, {_lum('a')} AS la, {_lum('b')} AS lb FROM p)
 SELECT p_partkey, CAST(round((greatest(la, lb) + 0.05) / (least(la, lb) + 0.05) * 1000) AS BIGINT) AS contrast, '#' || {_MIX} AS lighter FROM l""")
def colour_pairs(spark, d):
    """Two colours for each part, by the MD5 of its key: their contrast, and the first a quarter of the way to white."""
    key = F.md5(F.col("p_partkey").cast("string"))
    p = A.table(spark, d, "part").select("p_partkey", F.concat(F.lit("#"), F.substring(key, 1, 6)).alias("a"), F.concat(F.lit("#"), F.substring(key, 7, 6)).alias("b"))
    return p.select("p_partkey", F.round(T.contrast_ratio("a", "b") * 1000).cast("long").alias("contrast"), T.shade("a", 0.25).alias("lighter"))


@_query("""WITH p AS (SELECT p_partkey, p_partkey % 7 AS i, p_partkey % 5 AS j, CAST(640 + p_partkey % 9 * 160 AS BIGINT) AS w, CAST(360 + p_partkey % 4 * 240 AS BIGINT) AS h FROM part),
 q AS (SELECT *, greatest(0, CAST(floor(i / 8.0 * w + 0.5) AS BIGINT)) AS x, greatest(0, CAST(floor(j / 8.0 * h + 0.5) AS BIGINT)) AS y FROM p)
 SELECT p_partkey, x, y, greatest(2, least(w - x, CAST(floor(0.25 * w + 0.5) AS BIGINT))) AS rw, greatest(2, least(h - y, CAST(floor(0.5 * h + 0.5) AS BIGINT))) AS rh,
 CAST(floor(h * 0.62 / 2 + 0.5) * 2 AS BIGINT) AS big, CAST(h - floor(h * 0.62 / 2 + 0.5) * 2 AS BIGINT) AS rest FROM q""")
def frame_regions(spark, d):
    """A region and a layout for each part's frame."""
    p = A.table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 7 / 8.0).alias("i"), (F.col("p_partkey") % 5 / 8.0).alias("j"), (640 + F.col("p_partkey") % 9 * 160).cast("long").alias("w"), (360 + F.col("p_partkey") % 4 * 240).cast("long").alias("h"))
    p = p.withColumn("r", T.region_pixels(F.col("i"), F.col("j"), F.lit(0.25), F.lit(0.5), F.col("w"), F.col("h"))).withColumn("c", T.layout_cells(F.lit("bigsmall"), F.col("w"), F.col("h")))
    return p.select("p_partkey", "r.x", "r.y", F.col("r.w").alias("rw"), F.col("r.h").alias("rh"), F.col("c")[0]["h"].alias("big"), F.col("c")[1]["h"].alias("rest"))


# ---- joins of timelines ----------------------------------------------------------------------


@_query(f"WITH r AS ({RANGES}) SELECT rec_id, ord, start AS t FROM r p WHERE lane = 'click' AND EXISTS (SELECT 1 FROM r q WHERE q.rec_id = p.rec_id AND q.lane = 'view' AND q.start <= p.start AND p.start < q.\"end\")")
def points_in_ranges(spark, d):
    r = A.ranges(spark, d)
    return joins.in_ranges(r.filter("lane = 'click'").select("rec_id", "ord", F.col("start").alias("t")), r.filter("lane = 'view'"), slack=0)


@_query(f"""WITH r AS ({RANGES}), m AS ({_merged(f"SELECT * FROM ({RANGES}) WHERE lane = 'view'")}), p AS (SELECT rec_id, ord, start AS t FROM r WHERE lane = 'click')
 SELECT p.rec_id, p.ord, coalesce(bool_or(q."end" + {HOUR} >= t) FILTER (q.start = (SELECT max(start) FROM m WHERE m.rec_id = p.rec_id AND m.start <= t + {HOUR})), false) AS spoken FROM p LEFT JOIN m q ON q.rec_id = p.rec_id GROUP BY p.rec_id, p.ord""")
def points_in_speech(spark, d):
    r = A.ranges(spark, d)
    return joins.in_speech(r.filter("lane = 'click'").select("rec_id", "ord", F.col("start").alias("t")), intervals.merge(r.filter("lane = 'view'")), pad=HOUR).select("rec_id", "ord", F.col("in_speech").alias("spoken"))


@_query(f"""WITH r AS ({RANGES}), p AS (SELECT rec_id, ord, start AS t FROM r WHERE lane = 'click'), l AS (SELECT * FROM r WHERE lane = 'view'),
 x AS (SELECT p.rec_id, p.ord, l.ord AS line, CASE WHEN l.start <= t AND t < l."end" THEN 0 ELSE 1 END AS apart, CASE WHEN l.start <= t AND t < l."end" THEN 0 ELSE least(abs(t - l.start), abs(t - l."end")) END AS far FROM p LEFT JOIN l USING (rec_id))
 SELECT rec_id, ord, line FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, ord ORDER BY apart, far, line) AS k FROM x) WHERE k = 1""")
def nearest_lines(spark, d):
    r = A.ranges(spark, d)
    return joins.nearest_line(r.filter("lane = 'click'").select("rec_id", "ord", F.col("start").alias("t")), r.filter("lane = 'view'")).select("rec_id", "ord", "line")


_PIECES = f"""SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY start) - 1 AS piece, start AS i, "end" AS o, coalesce(sum("end" - start) OVER (PARTITION BY rec_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q FROM ({_merged(f"SELECT * FROM ({RANGES}) WHERE lane = 'view'")})"""


def _pieces(spark, d):
    """The merged views of a user as pieces of a timeline, one after the other."""
    m = intervals.merge(A.ranges(spark, d).filter("lane = 'view'"))
    w = F.sum(F.col("end") - F.col("start")).over(intervals._before("start"))
    n = F.row_number().over(intervals._w("start")) - 1
    return m.select("rec_id", n.alias("piece"), F.col("start").alias("in_point"), F.col("end").alias("out_point"), F.coalesce(w, F.lit(0)).alias("seq_start"), F.lit(1.0).alias("speed"))


@_query(f"""WITH p AS ({_PIECES}), i AS (SELECT * FROM ({RANGES}) WHERE lane = 'click'),
 h AS (SELECT i.rec_id, i.ord, piece, i.start AS s0, i."end" AS e0, greatest(i.start, p.i) AS a, least(i."end", o) AS b, q, p.i AS f, o FROM i JOIN p ON p.rec_id = i.rec_id AND i.start <= o AND i."end" >= p.i),
 w AS (SELECT *, a <= s0 AND b >= e0 AND (b > a OR (a >= f AND a < o)) AS whole FROM h)
 SELECT rec_id, ord, piece, CAST(q + a - f AS BIGINT) AS start, CAST(q + b - f AS BIGINT) AS "end" FROM w WHERE CASE WHEN whole THEN b >= a ELSE b - a > {HOUR} END""")
def media_on_timeline(spark, d):
    moved = joins.media_to_timeline(A.ranges(spark, d).filter("lane = 'click'"), _pieces(spark, d), HOUR, 0)
    return moved.select("rec_id", "ord", F.col("piece").cast("long").alias("piece"), F.round("start").cast("long").alias("start"), F.round("end").cast("long").alias("end"))


@_query(f"""WITH p AS ({_PIECES}), i AS (SELECT rec_id, ord, row_number() OVER (PARTITION BY rec_id ORDER BY ord) * {HOUR} AS s FROM ({RANGES}) WHERE lane = 'click'),
 h AS (SELECT i.rec_id, i.ord, i.s, piece, f.i AS f, q, row_number() OVER (PARTITION BY i.rec_id, i.ord ORDER BY piece) AS k FROM i LEFT JOIN (SELECT rec_id, piece, i, q, q + o - i AS z FROM p) f ON f.rec_id = i.rec_id AND i.s + {HOUR // 2} >= q AND i.s + {HOUR // 2} <= z)
 SELECT rec_id, ord, piece, CAST(f + s - q AS BIGINT) AS media_start FROM h WHERE k = 1""")
def timeline_in_media(spark, d):
    """An hour of the timeline for each click, in the media."""
    r = A.ranges(spark, d).filter("lane = 'click'")
    n = F.row_number().over(intervals._w("ord"))
    items = r.select("rec_id", "ord", (n * HOUR).cast("double").alias("start"), ((n + 1) * HOUR).cast("double").alias("end"))
    return joins.timeline_to_media(items, _pieces(spark, d), slack=0.5).select("rec_id", "ord", F.col("piece").cast("long").alias("piece"), F.round("media_start").cast("long").alias("media_start"))


@_query(f"""WITH s AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY start) AS ord, start, "end" FROM ({_merged()})), b AS (SELECT DISTINCT rec_id, start AS t FROM ({RANGES}) WHERE lane = 'purchase'),
 c AS (SELECT s.rec_id, s.ord, t FROM s JOIN b ON b.rec_id = s.rec_id AND t > s.start AND t < s."end"), e AS (SELECT rec_id, ord, start AS t FROM s UNION ALL SELECT * FROM c),
 x AS (SELECT e.rec_id, e.ord, t, lead(t) OVER (PARTITION BY e.rec_id, e.ord ORDER BY t) AS n, row_number() OVER (PARTITION BY e.rec_id, e.ord ORDER BY t) > 1 AS cut FROM e)
 SELECT x.rec_id, x.ord, t AS start, coalesce(n, s."end") AS "end", cut FROM x JOIN s USING (rec_id, ord)""")
def split_segments(spark, d):
    r = A.ranges(spark, d)
    m = intervals.merge(r).select("rec_id", F.row_number().over(intervals._w("start")).cast("long").alias("ord"), "start", "end")
    return intervals.split_at(m, r.filter("lane = 'purchase'").select("rec_id", F.col("start").alias("at")), 0)


@_query(f"""WITH c AS (SELECT rec_id, count(*) AS total FROM ({A.SQL['levels']}) GROUP BY rec_id), m AS (SELECT *, total // 2 AS mid FROM c)
 SELECT rec_id, CAST(unnest([0, 1]) AS INTEGER) AS half, unnest([CAST(0 AS BIGINT), greatest(0, mid - 3)]) AS from_i, unnest([least(total, mid + 3), total]) AS to_i, unnest([CAST(0 AS BIGINT), mid]) AS own_from, unnest([mid, total]) AS own_to FROM m""")
def halved_chunks(spark, d):
    plan = intervals.plan_chunks(A.levels(spark, d).groupBy("rec_id").agg(F.count(F.lit(1)).alias("total")), 1 << 40)
    return intervals.split_chunk(plan, 6).select("rec_id", F.col("half").cast("int").alias("half"), "from_i", "to_i", "own_from", "own_to")


@_query(f"""WITH l AS (SELECT *, "end" - start >= {HOUR} AS long, ord % 3 = 0 AS doubt FROM ({RANGES})), g AS (SELECT *, sum(fresh) OVER (PARTITION BY rec_id ORDER BY start, "end") AS g FROM (SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY rec_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {HOUR} THEN 0 ELSE 1 END AS fresh FROM l WHERE long))
 SELECT rec_id, min(start) AS start, max("end") AS "end", bool_or(doubt) AS needs_review FROM g GROUP BY rec_id, g""")
def tidied_cuts(spark, d):
    r = A.ranges(spark, d).select("rec_id", "ord", "start", "end", F.col("lane").alias("text"), (F.col("ord") % 3 == 0).alias("needs_review"), F.lit(False).alias("estimated"))
    return intervals.tidy(r, HOUR, HOUR).select("rec_id", "start", "end", "needs_review")
