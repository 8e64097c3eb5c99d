"""Named queries of files and of model replies, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweft.functions.timecode import half_up
from chronoweft.operators import replies
from chronoweft.plans import adapters as A
from chronoweft.plans.catalog import _query
from chronoweft.sources import files, folders

WORDS, CUES = A.SQL["words"], A.SQL["cues"]


# ---- files ---------------------------------------------------------------------------------


def _through(spark, texts, kind: str, suffix: str):
    """Texts written as files, a recording each, and read again."""
    files.register(spark)
    at = folders.fresh(spark, kind)
    texts.select(F.col("rec_id").cast("string").alias("rec_id"), "value").write.format(f"chronoweft_{kind}").option("suffix", suffix).mode("append").save(at)
    return spark.read.format(f"chronoweft_{kind}").load(at)


def _joined(rows, line, head=None):
    """The lines of each recording as one text, by start and ord."""
    found = rows.select("rec_id", F.struct("start", "ord", line.alias("_line")).alias("_l")).groupBy("rec_id").agg(F.array_sort(F.collect_list("_l")).alias("_ls"))
    text = F.array_join(F.transform("_ls", lambda x: x["_line"]), "")
    return found.select("rec_id", (F.concat(head, text) if head is not None else text).alias("value"))


@_query(f"""SELECT CAST(rec_id AS VARCHAR) AS rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY start, ord) AS i, (start // 1000) + CAST(start % 1000 AS DOUBLE) / 1000 AS start,
    ("end" // 1000) + CAST("end" % 1000 AS DOUBLE) / 1000 AS "end", text FROM ({CUES})""")
def subtitle_files(spark, d):
    """Turns as subtitle files of six dialects: plain, hourless with dots, a byte order mark and CRLF, no blank lines, no numbers, tags and settings."""
    kind = F.col("rec_id") % 6
    two = lambda c, n: F.lpad(c.cast("string"), n, "0")

    def clock(c):
        ms = F.col(c)
        minutes, rest = F.floor(ms / 60000), F.concat(F.lit(":"), two(F.floor(ms / 1000) % 60, 2))
        long = F.concat(two(F.floor(ms / 3600000), 2), F.lit(":"), two(minutes % 60, 2), rest, F.lit(","), two(ms % 1000, 3))
        # a fraction without its last zeros
        short = F.concat(minutes.cast("string"), rest, F.lit("."), F.regexp_replace(two(ms % 1000, 3), "(?<=.)0+$", ""))
        return F.when(kind == 1, short).otherwise(long)

    cues = A.cues(spark, d)
    text = F.when(kind == 5, F.concat(F.lit("<v Ann>{\\an8}<b>"), F.col("text"), F.lit("</b><00:01.5>"))).otherwise(F.col("text"))
    number = F.when(kind.isin(1, 4), F.lit("")).otherwise(F.concat((F.col("ord") + 1).cast("string"), F.lit("\n")))
    after = F.when(kind == 3, F.lit("\n")).otherwise(F.lit("\n\n"))
    line = F.concat(number, clock("start"), F.lit(" --> "), clock("end"), F.when(kind == 5, F.lit(" align:start")).otherwise(F.lit("")), F.lit("\n"), text, after)
    line = F.when(kind == 2, F.replace(line, F.lit("\n"), F.lit("\r\n"))).otherwise(line)
    return _through(spark, _joined(cues, line, F.when(kind == 1, F.lit("WEBVTT\n\n")).when(kind == 2, F.lit("﻿")).otherwise(F.lit(""))), "subtitles", ".srt")


@_query(f'SELECT CAST(rec_id AS VARCHAR) AS rec_id, ord, text, start, "end", CASE WHEN rec_id % 2 = 0 THEN speaker END AS speaker FROM ({WORDS}) WHERE rec_id % 5 <> 3')
def recogniser_files(spark, d):
    """Words as recognisers' files of both forms; those of every fifth recording break off and give nothing."""
    w = A.words(spark, d)
    even = F.col("rec_id") % 2 == 0
    unit = F.when(even, F.lit(1000.0)).otherwise(F.lit(1.0))
    one = F.struct("ord", F.when(even, F.col("text")).alias("punctuated_word"), F.when(~even, F.col("text")).alias("text"), (F.col("start") / unit).alias("start"), (F.col("end") / unit).alias("end"), F.lit(0.5).alias("confidence"), F.when(even, F.col("speaker")).alias("speaker"))
    every = w.groupBy("rec_id").agg(F.array_sort(F.collect_list(one)).alias("words"))
    nested = F.to_json(F.struct(F.struct(F.array(F.struct(F.array(F.struct("words")).alias("alternatives"))).alias("channels")).alias("results")))
    value = F.when(even, nested).otherwise(F.to_json(F.struct("words")))
    texts = every.select("rec_id", F.when(F.col("rec_id") % 5 == 3, F.substring(value, 1, 50)).otherwise(value).alias("value"))
    found = _through(spark, texts, "recogniser", ".json")
    return found.select("rec_id", "ord", "text", half_up(F.col("start") * 1000).alias("start"), half_up(F.col("end") * 1000).alias("end"), "speaker")


@_query(f"""SELECT CAST(rec_id AS VARCHAR) AS rec_id, start, "end", CASE speaker WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END::BIGINT AS speaker FROM ({CUES}) WHERE "end" > start""")
def turn_files(spark, d):
    """Turns as diarizers' files, among lines that are none."""
    n = F.when(F.col("speaker") == "user", 0).when(F.col("speaker") == "assistant", 1).otherwise(2)
    line = F.concat(F.lit("progress 10%\n"), (F.col("start") / 1000).cast("string"), F.lit(" -- "), (F.col("end") / 1000).cast("string"), F.lit(" speaker_0"), n.cast("string"), F.lit("\n5.0 -- 5.0 speaker_07\n"))
    found = _through(spark, _joined(A.cues(spark, d), line), "turns", ".txt")
    return found.select("rec_id", half_up(F.col("start") * 1000).alias("start"), half_up(F.col("end") * 1000).alias("end"), "speaker")


# ---- replies of language models ---------------------------------------------------------------

#: Every 17th word begins a cut of one to three words, counted up to four too high or too low.
_KINDS = ["Filler words", "false-start", "retake", "silence", "off topic", "something else"]
_EDGED = r"regexp_replace(lower(text), '^[^0-9A-Za-z_\x{0900}-\x{0963}\x{0966}-\x{097f}]+|[^0-9A-Za-z_\x{0900}-\x{0963}\x{0966}-\x{097f}]+$', '', 'g')"
_CUTS = rf"""
WITH w0 AS (SELECT rec_id, ord AS k, start, "end", text, {_EDGED} AS e, count(*) OVER (PARTITION BY rec_id) AS n FROM ({WORDS})),
    w AS (SELECT *, CAST(sum((e <> '')::INTEGER) OVER (PARTITION BY rec_id ORDER BY k) AS BIGINT) AS nth FROM w0),
    s AS (SELECT rec_id, list(e ORDER BY k) AS es, list(k ORDER BY k) AS ks FROM w WHERE e <> '' GROUP BY rec_id),
    c AS (SELECT rec_id, k AS cut_no, n, k + k % 9 - 4 AS f, k % 9 - 4 + k + k % 3 AS t, 1 + k % 3 AS m, ['filler', 'false_start', 'repetition', 'dead_air', 'tangent', 'cut'][k % 6 + 1] AS label,
        CASE k % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.9 WHEN 2 THEN 0.75 ELSE 1.0 END AS confidence FROM w WHERE k % 17 = 4 AND k + 3 < n),
    q AS (SELECT c.*, list_filter(list(w.e ORDER BY w.k), lambda x: x <> '') AS said FROM c JOIN w ON w.rec_id = c.rec_id AND w.k BETWEEN c.cut_no AND c.cut_no + c.m - 1 GROUP BY ALL),
    g AS (SELECT * FROM q WHERE f < n AND t <= n + 1 AND len(said) > 0),
    a AS (SELECT g.rec_id, g.cut_no, w.k AS a, ks[w.nth + len(said) - 1] AS b, row_number() OVER (PARTITION BY g.rec_id, g.cut_no ORDER BY abs(w.k - g.f), w.k DESC) AS rank
        FROM g JOIN w ON w.rec_id = g.rec_id AND w.k BETWEEN g.f - 6 AND g.f + 6 AND w.e = g.said[1] JOIN s ON s.rec_id = g.rec_id WHERE es[w.nth:w.nth + len(said) - 1] = said),
    r AS (SELECT g.rec_id, g.label, g.confidence, g.n, a.a, a.b, string_agg(w.text, ' ' ORDER BY w.k) FILTER (w.k <= a.b) AS text, string_agg(w.e, ' ' ORDER BY w.k) FILTER (w.k <= a.b) AS es, coalesce(max(w.e) FILTER (w.k > a.b), '') AS next,
        min(w.start) AS start, max(w."end") FILTER (w.k <= a.b) AS "end" FROM g JOIN a USING (rec_id, cut_no) JOIN w ON w.rec_id = g.rec_id AND w.k BETWEEN a.a AND a.b + 1 WHERE a.rank = 1 GROUP BY g.rec_id, g.cut_no, g.label, g.confidence, g.n, a.a, a.b)
SELECT rec_id, start, "end", text, label AS reason, label, CAST(confidence AS DOUBLE) AS confidence, a AS from_idx, b AS to_idx, "end" - start > 45 OR (n >= 40 AND b - a + 1 > 0.25 * n) AS needs_review
FROM r WHERE NOT (es = 'you know' AND next = 'what') AND NOT (es = 'like' AND regexp_matches(next, '^([0-9]|one|two|three|four|five|ten|a|about|half)'))
"""


def _reply_texts(w):
    """A reply for each recording, of six dialects: as asked for, in prose, with trailing commas, broken off, a bare list with other names, a list two levels down."""
    kind, k = F.col("rec_id") % 6, F.col("ord")
    of = Window.partitionBy("rec_id").orderBy("ord")
    said = F.concat_ws(" ", "text", *[F.when(k % 3 >= j, F.lead("text", j).over(of)) for j in (1, 2)])
    n = F.count(F.lit(1)).over(Window.partitionBy("rec_id"))
    at = w.withColumn("said", said).withColumn("n", n).filter((k % 17 == 4) & (k + 3 < F.col("n"))).withColumn("a", k + k % 9 - 4)
    name = F.element_at(F.array(*[F.lit(x) for x in _KINDS]), (k % 6 + 1).cast("int"))
    sure = F.element_at(F.array(F.lit("0.5"), F.lit("90"), F.lit('"75%"'), F.lit("null")), (k % 4 + 1).cast("int"))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("said").alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    # plain replies have numbers only
    asked = F.format_string('{"from":%d,"to":%d,"words":%s,"category":"%s","confidence":%s}', "a", F.col("a") + k % 3, quoted, name, F.when(kind == 0, F.regexp_replace(sure, '["%]', "")).otherwise(sure))
    other = F.format_string('{"range":["w%d",[%d]],"words":%s,"type":"%s","confidence":%s}', "a", F.col("a") + k % 3, quoted, name, sure)
    lists = at.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.when(kind == 4, other).otherwise(asked).alias("item")))).alias("items"))
    items = F.transform("items", lambda x: x["item"])
    comma, lines = F.array_join(items, ","), F.array_join(items, ",\n  ")
    text = (
        F.when(kind == 0, F.concat(F.lit('{"cuts":['), comma, F.lit("]}")))
        .when(kind == 1, F.concat(F.lit('Sure {as asked}, here "they are":\n```json\n{"cuts": [\n  '), lines, F.lit("\n]}\n```\nAnything else?")))
        .when(kind == 2, F.concat(F.lit('{"cuts":['), comma, F.lit(",],}")))
        .when(kind == 3, F.concat(F.lit('{"cuts":['), comma, F.lit(',{"from":12,"to":')))
        .when(kind == 4, F.concat(F.lit("["), comma, F.lit("]")))
        .otherwise(F.concat(F.lit('{"note":{"n":1},"result":{"edits":['), comma, F.lit("]}}")))
    )
    return lists.select("rec_id", text.alias("reply"))


@_query(_CUTS)
def reply_cuts(spark, d):
    """Cuts that replies about conversations name, moved onto the words they quote."""
    w = A.words(spark, d)
    # times are milliseconds here, so any cut of over 45 of them is to be reviewed
    return replies.cleanup_cuts(w, _reply_texts(w))
