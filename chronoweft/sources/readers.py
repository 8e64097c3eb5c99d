"""Recognisers', subtitle and log files as rows. Paths may be anything Spark can read."""

from __future__ import annotations

import io
import re
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweft.functions import text as X
from chronoweft.functions.timecode import srt_seconds

KEY = "rec_id"
_TIMING = r"((?:\d+:)?\d+:\d+(?:[,.]\d+)?)\s*-->\s*((?:\d+:)?\d+:\d+(?:[,.]\d+)?)"
_WORD = "array<struct<word:string,punctuated_word:string,text:string,start:double,end:double,confidence:double,speaker:string>>"


def subtitles(files: DataFrame) -> DataFrame:
    """SRT and WebVTT: rec_id, i, start, end, text. files: rec_id, value (a whole file).

    A timing line opens a cue; a blank line after text, the next timing line or an index before it closes it.
    Tags go, and cues without text.
    """
    whole = F.regexp_replace(F.regexp_replace(F.coalesce("value", F.lit("")), "^\uFEFF", ""), r"\r\n?", "\n")
    lines = files.select(KEY, F.posexplode(F.split(whole, "\n")).alias("k", "line"))
    w = Window.partitionBy(KEY).orderBy("k")
    lines = lines.withColumn("timing", F.col("line").rlike(_TIMING)).withColumn("next", F.coalesce(F.lead("timing").over(w), F.lit(False)))
    lines = lines.withColumn("cue", F.sum(F.col("timing").cast("int")).over(w)).filter("cue > 0")
    each = Window.partitionBy(KEY, "cue").orderBy("k")
    index = F.trim("line").rlike(r"^\d+$") & F.col("next")
    texts = lines.filter(~F.col("timing")).withColumn("_text", (F.trim("line") != "") & ~index).withColumn("_had", F.coalesce(F.max(F.col("_text").cast("int")).over(each.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ended = F.max((index | ((F.trim("line") == "") & (F.col("_had") == 1))).cast("int")).over(each.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    texts = texts.withColumn("_end", ended).filter("_text and _end = 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n")
    cues = lines.filter("timing").select(KEY, "cue", srt_seconds(F.regexp_extract("line", _TIMING, 1)).alias("start"), srt_seconds(F.regexp_extract("line", _TIMING, 2)).alias("end"))
    both = cues.join(texts.groupBy(KEY, "cue").agg(text.alias("text")), [KEY, "cue"]).withColumn("text", X.clean_cue("text")).filter("text <> ''")
    return both.select(KEY, F.row_number().over(Window.partitionBy(KEY).orderBy("cue")).cast("long").alias("i"), "start", "end", "text")


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    return subtitles(spark.read.text(path, wholetext=True).withColumn(KEY, F.col("_metadata.file_path")))


def _words_of(rows: DataFrame, array: Column, unit: float) -> DataFrame:
    w = rows.select(KEY, F.posexplode(array).alias("ord", "w"))
    said = F.trim(F.coalesce("w.punctuated_word", "w.word", "w.text"))
    return w.select(KEY, F.col("ord").cast("long").alias("ord"), said.alias("text"), (F.coalesce("w.start", F.lit(0.0)) / unit).alias("start"), (F.coalesce("w.end", F.lit(0.0)) / unit).alias("end"), F.col("w.confidence").alias("conf"), F.col("w.speaker").alias("speaker")).filter("text <> ''")


def channel_words(replies: DataFrame) -> DataFrame:
    """Words of recogniser JSON with channels and alternatives, in seconds: rec_id, ord, text, start, end, conf, speaker. Broken JSON has no words. replies: rec_id, value."""
    doc = F.from_json("value", f"results struct<channels:array<struct<alternatives:array<struct<words:{_WORD}>>>>>")
    words = F.get(F.get(doc["results"]["channels"], F.lit(0))["alternatives"], F.lit(0))["words"]
    return _words_of(replies, words, 1.0)


def flat_words(replies: DataFrame) -> DataFrame:
    """Words of recogniser JSON with a flat list, in milliseconds there and seconds here."""
    return _words_of(replies, F.from_json("value", f"words {_WORD}")["words"], 1000.0)


def speaker_turns(texts: DataFrame) -> DataFrame:
    """Turns of a diarizer's "0.318 -- 6.865 speaker_00" lines: rec_id, start, end, speaker. texts: rec_id, value."""
    pattern = r"([\d.]+)\s+--\s+([\d.]+)\s+speaker_(\d+)"
    parts = F.arrays_zip(*[F.regexp_extract_all("value", F.lit(pattern), F.lit(k)).alias(n) for k, n in ((1, "a"), (2, "b"), (3, "c"))])
    rows = texts.select(KEY, F.explode(parts).alias("p")).select(KEY, F.col("p.a").try_cast("double").alias("start"), F.col("p.b").try_cast("double").alias("end"), F.col("p.c").try_cast("long").alias("speaker"))
    return rows.filter("end > start")


def logged_silences(texts: DataFrame) -> DataFrame:
    """Ranges of silence_start and silence_end lines; an open one ends with the recording. texts: rec_id, value, total."""
    pattern = r"silence_(start|end):\s*(-?[\d.]+)"
    parts = F.arrays_zip(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias("kind"), F.regexp_extract_all("value", F.lit(pattern), F.lit(2)).alias("t"))
    rows = texts.select(KEY, "total", F.posexplode(parts).alias("k", "p")).select(KEY, "total", "k", F.col("p.kind").alias("kind"), F.col("p.t").try_cast("double").alias("t"))
    w = Window.partitionBy(KEY).orderBy("k")
    rows = rows.withColumn("_kind", F.lead("kind").over(w)).withColumn("_t", F.lead("t").over(w)).filter("kind = 'start'")
    end = F.when(F.col("_kind") == "end", F.col("_t")).when(F.col("_kind").isNull(), F.col("total"))
    return rows.select(KEY, F.greatest(F.lit(0.0), F.col("t")).alias("start"), end.alias("end")).filter(F.col("end").isNotNull())


def _logged(lines: DataFrame, level: str) -> DataFrame:
    """Log lines (rec_id, k, value) with the time that stands before each level."""
    w = Window.partitionBy(KEY).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = F.regexp_extract("value", r"pts_time:([\d.]+)", 1)
    timed = lines.withColumn("t", F.last(F.when(t != "", t.try_cast("double")), ignorenulls=True).over(w))
    raw = F.regexp_extract("value", level, 2)
    return timed.filter(raw != "").withColumn("db", F.when(raw.rlike("inf|nan"), F.lit(-100.0)).otherwise(raw.try_cast("double"))).withColumn("_c", F.regexp_extract("value", level, 1))


def logged_levels(lines: DataFrame) -> DataFrame:
    """Coarse levels of a filter's log: rec_id, t, db. lines: rec_id, k, value."""
    return _logged(lines, r"(RMS_level)=(-?[\d.]+|-?inf|nan)").select(KEY, "t", "db")


def channel_levels(lines: DataFrame, step: float) -> DataFrame:
    """Levels of each channel: rec_id, channel (from 0), i, db. The last line for a window counts."""
    rows = _logged(lines, r"lavfi\.astats\.(\d+)\.RMS_level=(-?[\d.]+|-?inf|nan)").withColumn("channel", F.col("_c").cast("int") - 1).withColumn("i", F.floor(F.coalesce("t", F.lit(0.0)) / step + 0.5).cast("long"))
    return rows.groupBy(KEY, "channel", "i").agg(F.max_by("db", "k").alias("db"))


def audio_streams(texts: DataFrame) -> DataFrame:
    """Audio streams in a probe's header: rec_id, stream, channels. texts: rec_id, value."""
    rows = texts.select(KEY, F.posexplode(F.regexp_extract_all("value", F.lit(r"Stream #\d+:\d+[^\n]*?: Audio:([^\n]*)"), F.lit(1))).alias("stream", "s"))
    n, layout = F.regexp_extract("s", r"(\d+) channels", 1), r"\b(\d)\.(\d)\b"
    s = F.col("s")
    named = F.when(s.rlike(r"\bmono\b"), 1).when(s.rlike(r"\b(stereo|downmix)\b"), 2).when(s.rlike(layout), F.regexp_extract("s", layout, 1).try_cast("int") + F.regexp_extract("s", layout, 2).try_cast("int"))
    named = F.coalesce(named, F.when(s.rlike(r"\bquad\b"), 4).when(s.rlike(r"\bhexagonal\b"), 6).when(s.rlike(r"\boctagonal\b"), 8), F.lit(2))
    return rows.select(KEY, "stream", F.coalesce(n.try_cast("int"), named).alias("channels"))


def docx(raw: bytes | None) -> str | None:
    """The text of a .docx file; None if it is none."""
    try:
        xml = zipfile.ZipFile(io.BytesIO(raw or b"")).read("word/document.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError):
        return None
    t = re.sub("<[^>]+>", "", re.sub("</w:p>", "\n", re.sub("<w:tab/>", " ", xml)))
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        t = t.replace(name, sign)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t)).strip()


docx_text = F.pandas_udf(lambda s: s.map(docx), T.StringType())
