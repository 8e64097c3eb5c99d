"""The driver tables as recordings: ranges, levels, words and cues with a rec_id, in whole numbers so that every engine agrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ranges of a user, in microseconds: 600 seconds for each unit of value."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events")
    length = F.floor(F.col("value") * 600 + 0.5).cast("long") * 1_000_000
    return e.select(F.col("user_id").alias("rec_id"), start.alias("start"), (start + length).alias("end"), F.col("event_type").alias("lane"), F.col("event_id").alias("ord"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as loudness of a user: db from -100 up, one step for each event."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("rec_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("i"), (F.floor(F.col("value") + 0.5) - 100).cast("long").alias("db"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as five microphones of one recording, an hour a window."""
    e = table(spark, sf_dir, "events")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long")
    cells = e.select(F.lit(0).cast("long").alias("rec_id"), F.col("event_type").alias("mic"), hour.alias("w"), F.floor(F.col("value") + 0.5).cast("long").alias("v")).groupBy("rec_id", "mic", "w").agg(F.sum("v").cast("long").alias("db"))
    low = cells.groupBy("rec_id").agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    spine = low.select("rec_id", F.explode(F.sequence("lo", "hi")).alias("w"), "lo").crossJoin(F.broadcast(cells.select("mic").distinct()))  # five event types
    return spine.join(cells, ["rec_id", "mic", "w"], "left").select("rec_id", "mic", (F.col("w") - F.col("lo")).alias("w"), F.coalesce("db", F.lit(-100)).alias("db"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a conversation, in milliseconds: 200 and 35 for each of up to eight letters, 60 between words, 700 after a turn."""
    c = table(spark, sf_dir, "conversations")
    split = c.select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("cue"), F.col("role").alias("speaker"), F.posexplode(F.filter(F.split("text", r"\s+"), lambda t: t != "")).alias("k", "text"))
    length = (200 + 35 * F.least(F.lit(8), F.length("text"))).cast("long")
    w = Window.partitionBy("rec_id").orderBy("cue", "k")
    last = F.lead("cue").over(w) != F.col("cue")
    rows = split.withColumn("_d", length).withColumn("_s", F.col("_d") + F.when(F.coalesce(last, F.lit(False)), 700).otherwise(60))
    start = F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return rows.select("rec_id", (F.row_number().over(w) - 1).cast("long").alias("ord"), "cue", "k", "speaker", "text", start.alias("start"), (start + F.col("_d")).alias("end"))


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as cues."""
    w = words(spark, sf_dir)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), " ")
    return w.groupBy("rec_id", F.col("cue").alias("ord")).agg(F.min("start").alias("start"), F.max("end").alias("end"), text.alias("text"), F.min("speaker").alias("speaker"))


def seconds(rows: DataFrame, unit: float = 1000.0) -> DataFrame:
    """Times in seconds."""
    return rows.withColumn("start", F.col("start") / unit).withColumn("end", F.col("end") / unit)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as cues of a recording."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("rec_id"), F.col("doc_id").alias("cue"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("double").alias("start"), "text", "lang")


# The same tables in SQL.
SQL = {
    "ranges": "SELECT user_id AS rec_id, epoch_us(ts) AS start, epoch_us(ts) + CAST(floor(value * 600 + 0.5) AS BIGINT) * 1000000 AS \"end\", event_type AS lane, event_id AS ord FROM events",
    "levels": "SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CAST(floor(value + 0.5) - 100 AS BIGINT) AS db FROM events",
    "cells": "SELECT event_type AS mic, epoch_us(ts) // 3600000000 AS w, CAST(sum(CAST(floor(value + 0.5) AS BIGINT)) AS BIGINT) AS db FROM events GROUP BY ALL",
    "words": """SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY cue, k) - 1 AS ord, cue, k, speaker, text, start, start + d AS "end" FROM (
        SELECT *, CAST(coalesce(sum(d + CASE WHEN last THEN 700 ELSE 60 END) OVER (PARTITION BY rec_id ORDER BY cue, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (
          SELECT *, 200 + 35 * least(8, length(text)) AS d, coalesce(lead(cue) OVER (PARTITION BY rec_id ORDER BY cue, k) <> cue, false) AS last FROM (
            SELECT conv_id AS rec_id, turn AS cue, role AS speaker, generate_subscripts(ws, 1) - 1 AS k, unnest(ws) AS text
            FROM (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS ws FROM conversations))))""",
}
SQL["grid"] = f"""SELECT 0 AS rec_id, m.mic, h.w - (SELECT min(w) FROM ({SQL['cells']})) AS w, coalesce(c.db, -100) AS db
    FROM (SELECT unnest(range(min(w), max(w) + 1)) AS w FROM ({SQL['cells']})) h CROSS JOIN (SELECT DISTINCT event_type AS mic FROM events) m LEFT JOIN ({SQL['cells']}) c ON c.mic = m.mic AND c.w = h.w"""
SQL["cues"] = f"""SELECT rec_id, cue AS ord, min(start) AS start, max("end") AS "end", string_agg(text, ' ' ORDER BY k) AS text, min(speaker) AS speaker FROM ({SQL['words']}) GROUP BY rec_id, cue"""
