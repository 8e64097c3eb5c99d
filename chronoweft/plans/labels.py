"""Named queries of the functions that label names, lines, breaks, errors and crops, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.functions import text as X
from chronoweft.functions import timecode as T
from chronoweft.functions import words as lists
from chronoweft.operators import timeline
from chronoweft.plans import adapters as A
from chronoweft.plans.catalog import _IN, _query

WORDS, CUES = A.SQL["words"], A.SQL["cues"]
_NAMES = ["Music Bed", "Host mic", "A1 › BGM", "Interview › Guest", "musical", "voice & song", "Drums", "Narration", "beats.wav", "vo"]


def _sql_list(names) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


def _pick(names, of: str):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(of) % len(names) + 1).cast("int"))


@_query(f"""WITH n AS (SELECT p_partkey, trim(list_last(string_split({_sql_list(_NAMES)}[p_partkey % {len(_NAMES)} + 1], '›'))) AS own FROM part),
 t AS (SELECT p_partkey, regexp_matches(own, '(?i)(^|[^a-z0-9])(music|musics|bgm|bg music|songs?|score|beats?|background|instrumental|gaana|gana|sangeet)($|[^a-z0-9])') AS m, regexp_matches(own, '(?i)(^|[^a-z0-9])(voices?|vo|v\\.o\\.?|mics?|microphone|host|guest|dialog|dialogue|narration|narrator|interview|speaker)($|[^a-z0-9])') AS v FROM n)
 SELECT p_partkey, CASE WHEN m AND NOT v THEN 'music' WHEN v AND NOT m THEN 'voice' ELSE '' END AS says FROM t""")
def track_names(spark, d):
    from chronoweft.operators import signal

    return A.table(spark, d, "part").select("p_partkey", signal.track_says(_pick(_NAMES, "p_partkey")).alias("says"))


_KINDS = [f"{n.upper().replace('_', ' ')} " if k % 2 else n for k, n in enumerate(n for names in lists.CATEGORIES.values() for n in names.split())] + ["nothing known"]
_CASES = " ".join(f"WHEN k IN ({_IN(names.split())}) THEN '{kind}'" for kind, names in reversed(lists.CATEGORIES.items()))


@_query(f"""SELECT p_partkey, CASE {_CASES} ELSE 'cut' END AS kind FROM (SELECT p_partkey, regexp_replace(lower(trim({_sql_list(_KINDS)}[p_partkey % {len(_KINDS)} + 1])), '[\\s\\-]+', '_', 'g') AS k FROM part)""")
def cut_kinds(spark, d):
    return A.table(spark, d, "part").select("p_partkey", X.category(_pick(_KINDS, "p_partkey")).alias("kind"))


_ERRORS = [(200, 28, ""), (0, 3, ""), (401, 0, ""), (200, 0, "Invalid API key"), (404, 0, "the model x was not found"), (429, 0, ""), (402, 0, ""), (503, 0, "no"), (413, 0, ""), (200, 0, "No speech detected"), (415, 0, ""), (418, 0, "teapot")]
_WHAT = ["network", "request_failed", "bad_key", "bad_key", "model_gone", "rate_limit", "no_credit", "provider_down", "too_large", "no_speech", "bad_audio", "unknown"]


@_query(f"SELECT p_partkey, {_sql_list(_WHAT)}[p_partkey % {len(_WHAT)} + 1] AS kind FROM part")
def error_kinds(spark, d):
    """Errors of every kind, dealt to the parts."""
    each = lambda k: F.element_at(F.array(*[F.lit(e[k]) for e in _ERRORS]), (F.col("p_partkey") % len(_ERRORS) + 1).cast("int"))
    return A.table(spark, d, "part").select("p_partkey", timeline.error_kind(each(0), each(1), each(2)).alias("kind"))


_FOLDERS = [*timeline.FOLDERS, "other"]


@_query(f"SELECT p_partkey, {_sql_list([timeline.FOLDERS.get(k, 'Other') for k in _FOLDERS])}[p_partkey % {len(_FOLDERS)} + 1] AS folder FROM part")
def asset_folders(spark, d):
    return A.table(spark, d, "part").select("p_partkey", timeline.asset_folder(_pick(_FOLDERS, "p_partkey")).alias("folder"))


@_query("SELECT p_partkey, p_name AS name FROM part WHERE contains(lower(p_name), 'an')")
def family_names(spark, d):
    return timeline.families(A.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name")), " AN ")


@_query(f"""WITH w AS (SELECT rec_id, ord, text, k, regexp_replace(text, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') AS clean FROM ({WORDS}))
 SELECT rec_id, ord, regexp_matches(text, '\\d') AS number, lower(clean) IN ({_IN(lists.CALLS)}) AS call, regexp_matches(clean, '^[A-Z][a-z]{{2,}}$') AND k > 0 AS name FROM w""")
def word_flags(spark, d):
    """Which words of a turn are numbers, calls to act and names."""
    w = A.words(spark, d)
    per = w.groupBy("rec_id", "cue").agg(F.array_sort(F.collect_list(F.struct("k", "ord", "text"))).alias("ws"))
    texts = F.transform("ws", lambda x: x["text"])
    zipped = F.arrays_zip(F.transform("ws", lambda x: x["ord"]).alias("ord"), *[X.keyword_flags(texts, mode).alias(n) for n, mode in (("number", "numbers"), ("call", "cta"), ("name", "names"))])
    return per.select("rec_id", F.explode(zipped).alias("z")).select("rec_id", "z.ord", "z.number", "z.call", "z.name")


_BARE = "regexp_replace(lower({0}), '[^a-z0-9''\\x{{0900}}-\\x{{0963}}\\x{{0966}}-\\x{{097F}}]', '', 'g')"


@_query(f"""WITH w AS (SELECT rec_id, ord, text AS p, lead(text) OVER (PARTITION BY rec_id ORDER BY ord) AS n FROM ({WORDS})), b AS (SELECT rec_id, ord, p, n, {_BARE.format('p')} AS pb, {_BARE.format('n')} AS nb, regexp_replace(p, '["''»)\\]”’]+$', '') AS v FROM w WHERE n IS NOT NULL),
 c AS (SELECT *, regexp_replace(v, '\\.+$', '') AS core FROM b)
 SELECT rec_id, ord, CAST(CASE WHEN regexp_matches(n, '^[।॥]') OR nb IN ({_IN(lists.POSTPOSITIONS)}) OR nb IN ({_IN(lists.AUXILIARIES)}) OR (nb = 'the' AND regexp_matches(pb, '(te|ti|ta|ye|ae|aye|rahe|gaye|hue|baithe|kar|liye|diye|kiye)$') AND NOT regexp_matches(pb, '^(the|to|be|we|he|she|me|ye)$')) THEN 1000
 WHEN regexp_matches(v, '[!?।॥۔]$') OR (regexp_matches(v, '\\.$') AND lower(core) NOT IN ({_IN(lists.ABBREVIATIONS)}) AND NOT ((regexp_matches(core, '^([A-Za-z]\\.)*[A-Za-z]$') AND regexp_matches(core, '[A-Z]')) OR regexp_matches(core, '^([a-z]\\.)+[a-z]$'))) THEN 0
 WHEN regexp_matches(p, '[,;:—–]["''»)\\]”’]?$') THEN 10 WHEN pb IN ({_IN(lists.BAD_LINE_ENDS)}) OR pb = 'the' THEN 300 WHEN pb IN ({_IN(lists.GENITIVES)}) THEN 250 WHEN regexp_matches(pb, '^\\d[\\d,.]*$') AND NOT regexp_matches(nb, '^\\d') THEN 250
 WHEN regexp_matches(p, '^[A-Z][a-z]+$') AND regexp_matches(n, '^[A-Z][a-z]+$') THEN 200 WHEN nb IN ({_IN(lists.CONJUNCTIONS)}) THEN 25 ELSE 100 END AS BIGINT) AS hundredths FROM c""")
def break_costs(spark, d):
    """What a line break after each word costs, in hundredths; 1000 where grammar forbids it."""
    w = A.words(spark, d)
    from pyspark.sql import Window

    pairs = w.withColumn("n", F.lead("text").over(Window.partitionBy("rec_id").orderBy("ord"))).filter("n is not null")
    return pairs.select("rec_id", "ord", F.round(F.least(X.line_break_cost("text", "n"), F.lit(10.0)) * 100).cast("long").alias("hundredths"))


@_query("""WITH w AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\s+') AS ws FROM documents), c AS (SELECT doc_id, len(list_filter(ws, lambda x: regexp_matches(x, '[\\x{0900}-\\x{097F}]'))) AS deva, len(list_filter(ws, lambda x: NOT regexp_matches(x, '[\\x{0900}-\\x{097F}]') AND regexp_matches(x, '[A-Za-z]{2,}'))) AS latin FROM w)
 SELECT doc_id, CASE WHEN deva >= 3 THEN CASE WHEN latin / (deva + latin) >= 0.15 THEN 'hinglish' ELSE 'deva' END END AS language FROM c""")
def probe_languages(spark, d):
    return A.table(spark, d, "documents").select("doc_id", X.probe_language("text").alias("language"))


@_query(f"""WITH c AS (SELECT rec_id, ord, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM ({CUES})) SELECT rec_id, ord, CASE WHEN len(ws) <= 9 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[1:7], ' ') || '…' END AS text FROM c""")
def first_words(spark, d):
    return A.cues(spark, d).select("rec_id", "ord", X.first_words("text", 7, 9).alias("text"))


@_query(f"""WITH w AS (SELECT rec_id, ord, lower(text) AS a, lead(lower(text)) OVER (PARTITION BY rec_id ORDER BY ord) AS b FROM ({WORDS})) SELECT rec_id, ord, a <> '' AND b <> '' AND (a = b OR (length(b) >= 5 AND starts_with(a, b)) OR (length(a) >= 5 AND starts_with(b, a))) AS same FROM w WHERE b IS NOT NULL""")
def same_stems(spark, d):
    from pyspark.sql import Window

    w = A.words(spark, d).select("rec_id", "ord", F.lower("text").alias("a"))
    pairs = w.withColumn("b", F.lead("a").over(Window.partitionBy("rec_id").orderBy("ord"))).filter("b is not null")
    return pairs.select("rec_id", "ord", X.same_stem(F.col("a"), F.col("b")).alias("same"))


@_query(f"""SELECT rec_id, ord, CASE WHEN regexp_matches(text, '(?i)er') THEN 'E' WHEN regexp_matches(text, '(?i)an') THEN 'A' END AS emoji FROM ({WORDS})""")
def emoji_marks(spark, d):
    return A.words(spark, d).select("rec_id", "ord", X.emoji_for("text", [("(?i)er", "E"), ("(?i)an", "A")]).alias("emoji"))


_EVEN = "(floor({0} + 0.5) - floor({0} + 0.5) % 2)"


def _crop(cx: str, top: str, cw: str, ch: str) -> str:
    x, y = f"greatest(0, least(w - {cw}, {cx} - {cw} / 2))", f"greatest(0, least(h - {ch}, {top}))"
    return ", ".join(f"CAST({_EVEN.format(v)} AS BIGINT) AS {n}" for v, n in ((x, "x"), (y, "y"), (cw, "cw"), (ch, "ch")))


_FACES = "SELECT p_partkey, (p_partkey % 9 + 0.5) / 10 AS cx, (p_partkey % 5 + 0.5) / 6 AS cy, (p_partkey % 4 + 1) * CAST(0.05 AS DOUBLE) AS size, CAST(640 + p_partkey % 9 * 160 AS DOUBLE) AS w, CAST(360 + p_partkey % 4 * 240 AS DOUBLE) AS h FROM part"


def _frames(spark, d):
    k = F.col("p_partkey")
    return A.table(spark, d, "part").select("p_partkey", ((k % 9 + 0.5) / 10).alias("cx"), ((k % 5 + 0.5) / 6).alias("cy"), ((k % 4 + 1) * 0.05).alias("size"), (640 + k % 9 * 160).cast("double").alias("w"), (360 + k % 4 * 240).cast("double").alias("h"))


@_query(f"""WITH f AS ({_FACES}), a AS (SELECT *, CASE WHEN h * 0.5625 > w THEN w ELSE h * 0.5625 END AS fw, CASE WHEN h * 0.5625 > w THEN w / 0.5625 ELSE h END AS fh, size * w / 0.34 AS want FROM f),
 c AS (SELECT *, CASE WHEN want < fw THEN least(fw, greatest(0.5 * h * 0.5625, want)) ELSE fw END AS cw0 FROM a), e AS (SELECT *, CASE WHEN want < fw THEN cw0 / 0.5625 ELSE fh END AS ch0 FROM c)
 SELECT p_partkey, {_crop('(cx * w)', '(cy * h - ch0 * 0.36)', 'cw0', 'ch0')} FROM e""")
def face_crops(spark, d):
    """Upright windows around a face in each part's frame."""
    f = _frames(spark, d)
    c = T.face_crop(F.col("cx"), F.col("cy"), F.col("size"), F.col("w"), F.col("h"), F.lit(0.5625))
    return f.withColumn("c", c).select("p_partkey", *[F.col(f"c.{a}").cast("long").alias(b) for a, b in (("x", "x"), ("y", "y"), ("w", "cw"), ("h", "ch"))])


@_query(f"""WITH f AS ({_FACES}), a AS (SELECT *, least(h, greatest(0.4 * h, size * h * 1.08, size * w * 1.08 / 0.5625)) AS tall FROM f), c AS (SELECT *, CASE WHEN tall * 0.5625 > w THEN w ELSE tall * 0.5625 END AS cw0, CASE WHEN tall * 0.5625 > w THEN w / 0.5625 ELSE tall END AS ch0 FROM a)
 SELECT p_partkey, {_crop('((cx + size / 2) * w)', '(cy * h - ch0 * 0.04)', 'cw0', 'ch0')} FROM c""")
def mark_crops(spark, d):
    f = _frames(spark, d)
    c = T.mark_crop(F.col("cx"), F.col("cy"), F.col("size"), F.col("size"), F.col("w"), F.col("h"), F.lit(0.5625))
    return f.withColumn("c", c).select("p_partkey", *[F.col(f"c.{a}").cast("long").alias(b) for a, b in (("x", "x"), ("y", "y"), ("w", "cw"), ("h", "ch"))])
