"""Readers, writers, replies, timeline, evaluation and the live path."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweft.operators import evaluation, replies, timeline
from chronoweft.sources import readers, sinks
from chronoweft.streaming import envelope


def test_subtitles(spark):
    srt = "﻿1\r\n00:00:01,500 --> 00:00:02,000\r\n<b>Hello</b>\r\nthere\r\n2\r\n00:03 --> 00:04.25\r\nno blank line\r\n\r\nnot a cue\r\n00:00:05,000 --> 00:00:06,000\r\n\r\n"
    got = readers.subtitles(spark.createDataFrame([("a", srt)], "rec_id string, value string")).orderBy("i").collect()
    assert [(r["start"], r["end"], r["text"]) for r in got] == [(1.5, 2.0, "Hello\nthere"), (3.0, 4.25, "no blank line")]
    back = sinks.to_srt(spark.createDataFrame([("a", r["i"], r["start"], r["end"], r["text"]) for r in got], "rec_id string, i long, start double, end double, text string"))
    again = readers.subtitles(back).orderBy("i").collect()
    assert [r["text"] for r in again] == [r["text"] for r in got]


def test_recogniser_words(spark):
    a = '{"results":{"channels":[{"alternatives":[{"words":[{"word":"hi","punctuated_word":"Hi,","start":0.5,"end":1.0,"confidence":0.9,"speaker":1},{"word":" "}]}]}]}}'
    b = '{"words":[{"text":"Hi","start":500,"end":1000}]}'
    df = lambda v: spark.createDataFrame([(1, v)], "rec_id long, value string")
    r = readers.channel_words(df(a)).collect()
    assert [(x["text"], x["start"], x["end"], x["speaker"]) for x in r] == [("Hi,", 0.5, 1.0, "1")]
    assert [(x["text"], x["start"]) for x in readers.flat_words(df(b)).collect()] == [("Hi", 0.5)]
    assert readers.channel_words(df("{broken")).collect() == []


def test_logs(spark):
    df = lambda v: spark.createDataFrame([(1, v, 9.0)], "rec_id long, value string, total double")
    turns = readers.speaker_turns(df("0.318 -- 6.865 speaker_00\n7.0 -- 6.0 speaker_01")).collect()
    assert [(t["start"], t["end"], t["speaker"]) for t in turns] == [(0.318, 6.865, 0)]
    sil = readers.logged_silences(df("silence_start: 1.5\nsilence_end: 2\nsilence_start: 8")).collect()
    assert [(s["start"], s["end"]) for s in sil] == [(1.5, 2.0), (8.0, 9.0)]
    lines = ["pts_time:0.2", "lavfi.astats.1.RMS_level=-31.5", "lavfi.astats.2.RMS_level=-inf"]
    got = readers.channel_levels(spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "rec_id long, k long, value string"), 0.2).collect()
    assert sorted((r["channel"], r["i"], r["db"]) for r in got) == [(0, 1, -31.5), (1, 1, -100.0)]
    streams = readers.audio_streams(df("Stream #0:1: Audio: aac, 48000 Hz, 5.1\nStream #0:2: Audio: pcm, mono")).collect()
    assert [s["channels"] for s in streams] == [6, 1]


def test_writers(spark):
    ch = spark.createDataFrame([(1, 65.0, "Two"), (1, 0.0, "One")], "rec_id long, start double, title string")
    assert sinks.to_chapters(ch).first()["value"] == "0:00 One\n1:05 Two"
    cues = spark.createDataFrame([(1, 0, 0.0, 1.0, "a {b}", None)], "rec_id long, i long, start double, end double, text string, words array<struct<text:string,start:double,end:double>>")
    assert sinks.to_ass(cues).first()["value"].endswith("{\\1c&H00D4FF&}a (b){\\1c&HFFFFFF&}")
    plan = spark.createDataFrame([(1, 1, 0, 10), (1, 2, -1, 20)], "rec_id long, segment long, state long, frames long")
    assert "duration 0.333333" in sinks.to_concat(plan, 30.0).first()["value"]


def test_replies():
    words = [{"text": t, "start": k * 0.4, "end": k * 0.4 + 0.3} for k, t in enumerate("so um we go to the shop".split())]
    got = replies.cleanup('Here you go {as asked}: ```{"cuts":[{"from":0,"to":0,"words":"um","category":"Filler words","confidence":90,},]}```', words)
    assert [(c["from_idx"], c["label"], c["confidence"]) for c in got] == [(1, "filler", 0.9)]
    cut_off = '{"cuts":[{"from":1,"to":1},{"from":3,"to"'
    assert replies.truncated(cut_off) and len(replies.cleanup(cut_off, words)) == 1
    assert replies.cleanup("nothing here", words) == [] and replies.cleanup(None, words) == []
    assert replies.ranking('{"ranked":[{"i":1,"score":80},{"i":1,"score":5},{"i":9},0]}', 3) == [(1, 80.0), (0, 25.0)]
    segs = [{"start": 5.0 * k, "end": 5.0 * k + 4.8, "text": f"Line {k}."} for k in range(6)]
    assert replies.highlights('{"clips":[{"from":"0:05","to":2,"title":"T","score":70}]}', segs)[0]["start"] == 5.0


def test_nests_and_edits(spark):
    c = "sequence_id string, track int, kind string, clip_id string, name string, media string, nested_id string, start double, end double, in_point double, out_point double, speed double, reversed boolean, disabled boolean, selected boolean"
    clips = spark.createDataFrame([("A", 1, "audio", "n", "n", None, "B", 10.0, 14.0, 2.0, 6.0, 1.0, False, False, True), ("B", 1, "audio", "m", "m", "x.wav", None, 0.0, 5.0, 100.0, 105.0, 1.0, False, False, False), ("B", 1, "audio", "self", "s", None, "A", 5.0, 6.0, 0.0, 1.0, 1.0, False, False, False)], c)
    tracks = spark.createDataFrame([("A", 1, "audio", "A1", False, False), ("B", 1, "audio", "A1", False, False)], "sequence_id string, track int, kind string, name string, muted boolean, locked boolean")
    got = timeline.flatten_nests(clips, tracks, "A").collect()
    assert [(r["clip_id"], r["start"], r["end"], r["in_point"], r["out_point"]) for r in got] == [("m", 10.0, 13.0, 102.0, 105.0)]
    cl = spark.createDataFrame([(1, 0, 0.0, 10.0, 0.0, 1.0)], "rec_id long, ord long, start double, end double, in_point double, speed double")
    cuts = spark.createDataFrame([(1, 4.0, 6.0)], "rec_id long, start double, end double")
    out = sorted((r["start"], r["end"], r["in_point"]) for r in timeline.razor_ripple(cl, cuts).collect())
    assert out == [(0.0, 4.0, 0.0), (4.0, 8.0, 6.0)]
    marks = spark.createDataFrame([(1, 0, "Hook", 7.0, 7.0), (1, 1, "Silence 3", 5.0, 5.0)], "rec_id long, ord long, name string, start double, end double")
    assert [(r["name"], r["start"]) for r in timeline.shift_markers(marks, cuts, "Silence").collect()] == [("Hook", 5.0)]
    one = spark.createDataFrame([("song theme.mp3", None)], "name string, media string").select(timeline.asset_class(F.col("name"), F.col("media"), F.lit(False)).alias("k"))
    assert one.first()["k"] == "music"


def test_confusion(spark):
    totals = spark.createDataFrame([(1, 2.0)], "rec_id long, total double")
    kept = lambda s, e: evaluation.mask(spark.createDataFrame([(1, s, e)], "rec_id long, start double, end double"), totals)
    r = evaluation.confusion(kept(0.0, 1.0), kept(0.5, 2.0)).first()
    assert (r["only_machine"], r["only_hand"]) == (pytest.approx(0.5), pytest.approx(1.0))
    rng = np.random.default_rng(1)
    src = evaluation.log_mel(rng.normal(size=16000 * 6))
    assert [s - e for e, s, _ in evaluation.match_windows(src[200:450], src)] == [200] * 4
    assert evaluation.best_split(np.array([1.0, 1, 0, 0]), np.array([0.0, 0, 1, 1])) == 2


def test_live_levels(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, 0, 0, s // 4, (s % 4) * 250_000), 0.5 if s < 8 else 0.0) for s in range(16)]
    spark.createDataFrame(rows, "rec_id string, ts timestamp, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("rec_id string, ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = envelope.live_levels(stream, late="0 seconds").writeStream.format("memory").queryName("live").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = [r["db"] for r in spark.sql("select db from live order by start").collect()]
    assert got and got[0] == pytest.approx(-6.02, abs=0.01)
