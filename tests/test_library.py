"""Text, signals, captions, takes, scripts, speakers and chapters on literal cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweft.functions import text as X
from chronoweft.functions import timecode as T
from chronoweft.operators import highlights, retakes, script, sequences, signal, speakers, takes


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string" if isinstance(value, str) else "x double").select(*columns).first()


def timed(lines, gap=0.7):
    out, t = [], 0.0
    for line in lines:
        for w in line.split():
            d = 0.2 + 0.035 * min(8, len(w))
            out.append({"ord": len(out), "start": round(t, 3), "end": round(t + d, 3), "text": w})
            t += d + 0.06
        t += gap
    return out


def frame(spark, words, rec=1):
    return spark.createDataFrame([(rec, w["ord"], w["start"], w["end"], w["text"]) for w in words], "rec_id long, ord long, start double, end double, text string")


def test_times(spark):
    r = one(spark, 3661.5, T.srt_time("x"), T.ass_time("x"), T.timecode("x"), T.mmss("x"), T.fps_exact(F.lit(29.97)), T.fps_rational(F.lit(23.976)))
    assert tuple(r) == ("01:01:01,500", "1:01:01.50", "1:01:01", "61:02", 30000 / 1001, "24000/1001")
    assert tuple(one(spark, "1:02:03.5", T.srt_seconds("x"), T.srt_seconds(F.lit("nothing")), T.clock_seconds(F.lit("125:07")))) == (3723.5, 0.0, 7507.0)


def test_colours_and_cells(spark):
    r = one(spark, "#000000", T.contrast_ratio("x", F.lit("#FFFFFF")), T.shade(F.lit("#808080"), 1.0), T.shade(F.lit("red"), 1.0))
    assert r[0] == pytest.approx(21.0) and r[1] == "#ffffff" and r[2] == "red"
    cells = one(spark, "split", T.layout_cells("x", F.lit(1080), F.lit(1920)))[0]
    assert [(c["y"], c["h"], c["role"]) for c in cells] == [(0, 960, "main"), (960, 960, "other")]


def test_text(spark):
    assert one(spark, "<b>Hi</b> <00:01.5>there", X.clean_cue("x"))[0] == "Hi there"
    assert one(spark, "Dr.", X.is_sentence_end("x"))[0] is False and one(spark, "done.", X.is_sentence_end("x"))[0] is True
    assert one(spark, "Anna Lee: hello there", X.speaker_of("x"))[0]["speaker"] == "Anna Lee"
    assert one(spark, "Nobody tells you this", X.hook_label("x"))[0] == "Hook"
    assert one(spark, "Why do most people lose money?", X.hook_score("x"))[0] == 40
    assert one(spark, "shit", X.censor("x"))[0] == "s***" and one(spark, "constructor", X.censor("x"))[0] == "constructor"
    assert one(spark, "StockMarket_crash-final2.mp4", X.file_keywords("x"))[0] == ["market", "crash", "final2"]
    assert one(spark, "[BLANK_AUDIO]", X.is_non_speech("x"))[0] and not one(spark, "we go on", X.is_non_speech("x"))[0]
    assert X.latin("नमस्ते") == "namaste" and X.skeleton("listed") == X.skeleton("लिस्टिट")
    assert X.word_likeness("hello", "hello") == 2.0 and X.word_likeness("cat", "dog") == -1.5
    assert X.fuzzy("Add captions", "zzz") == -1 and X.fuzzy("captions", "cap") > X.fuzzy("a clap", "cap")
    assert X.clusters("नमस्ते")[0] == "न" and X.visible("abc") == 3.0


def test_levels_and_cuts(spark):
    hop, db = 0.01, [-60.0] * 300 + [-20.0] * 300 + [-60.0] * 200 + [-20.0] * 300
    levels = spark.createDataFrame([(1, i, v) for i, v in enumerate(db)], "rec_id long, i long, db double")
    m = signal.mic_levels(levels).first()
    assert (m["floor"], m["speech"], m["continuous"], m["digital"]) == (-60.0, -20.0, False, False)
    flags = sequences.hysteresis(levels, F.lit(m["threshold"])).select(F.lit("a").alias("media"), "i", "db", "loud")
    src = spark.createDataFrame([(1, 0, "a", 0.0, 11.0, 0.0, 1.0, -40.0, -20.0)], "rec_id long, source long, media string, seq_start double, seq_end double, in_point double, speed double, strong_db double, speech_db double")
    grid = signal.combine(src, flags, spark.createDataFrame([(1, 11.0)], "rec_id long, total double"), hop)
    cuts = sorted((round(r["start"], 2), round(r["end"], 2)) for r in signal.plan_cuts(grid, signal.TUNING["balanced"], hop).collect())
    assert cuts == [(0.17, 2.87), (6.17, 7.87)]


def test_envelope_of_pcm(spark):
    v = (np.sin(np.arange(3000) * 0.5) * 16000).astype("<i2")
    v[1000:2000] = 0
    df = spark.createDataFrame([("a", bytearray(v.tobytes()))], "rec_id string, content binary")
    got = {r["i"]: r["db"] for r in signal.pcm_envelope(df, 1000).collect()}
    assert len(got) == 300 and got[150] == -120.0 and got[50] == pytest.approx(20 * math.log10(16000 / 32768 / math.sqrt(2)), abs=0.5)


def test_two_modes_and_runs():
    rng = np.random.default_rng(1)
    found = signal.two_modes(np.concatenate((rng.normal(-12, 1, 1900), rng.normal(12, 1, 100))))
    assert found["lo"] == pytest.approx(-12, abs=0.3) and found["hi"] == pytest.approx(12, abs=0.5)
    t = np.arange(100) * 0.05
    assert signal.speech_runs_of(t, np.where((t > 1) & (t < 2), -20.0, -60.0))[0] == pytest.approx((1.05, 2.0), abs=0.051)
    assert signal.speech_runs_of(t, np.full(100, -30.0)) == []


def test_retakes_and_stumbles(spark):
    words = timed(["so the main point of this video is", "so the main point of this video is saving money early.", "now we go to the next thing entirely"])
    got = retakes.repeated_takes(frame(spark, words)).collect()
    assert len(got) == 1 and got[0]["start"] == 0.0
    st = takes.stumbles(frame(spark, timed(["I I think the the plan works"]))).collect()
    assert [r["text"] for r in st] == ["I", "the"]
    talk = timed(["What did you learn in that first year?", "I learned that patience matters a lot."])
    assert retakes.repeated_takes(frame(spark, talk)).collect() == []


def test_fillers(spark):
    got = takes.fillers(frame(spark, timed(["um I like it, you know, a lot"]))).collect()
    assert sorted(r["text"] for r in got) == ["um", "you know"]


def test_script_alignment(spark):
    cues = [{"text": "hello wurld again"}, {"text": "we are hear today"}]
    texts, rate, ok = script.align_cues(cues, "Hello world again\nWe are here today")
    assert ok and texts == ["Hello world again", "We are here today"] and rate > 0.35
    assert script.match_pairs(list("abcd"), list("axcd")) == [(0, 0), (2, 2), (3, 3)]
    assert script.script_words("HOST: Hi there [laughs]\n12\n00:01 --> 00:02\nbye") == ["Hi", "there", "bye"]


def test_global_alignment_prefers_the_later_take():
    said = "one two three one two three four five".split()
    at = script.global_alignment(script.Scores(said, "one two three four five".split()).full)
    assert list(at) == [-1, -1, -1, 0, 1, 2, 3, 4]


def test_director_and_random(spark):
    regions = [(0, 0.0, 10.0), (1, 10.0, 20.0), (0, 20.0, 30.0)]
    shots = speakers.director_of(regions, 2, 30.0)
    assert [s[2] for s in shots] == [0, 1, 0] and shots[0][0] == 0.0 and shots[-1][1] == 30.0
    r = speakers.Mulberry(42)
    assert 0 <= r() < 1 and r() != r()


def test_speaker_activity():
    rng = np.random.default_rng(2)
    turn = np.arange(600) // 50 % 2
    a = np.where(turn == 0, -20, -38) + rng.normal(0, 1, 600)
    b = np.where(turn == 1, -26, -44) + rng.normal(0, 1, 600)
    quiet = rng.random(600) < 0.2
    a[quiet], b[quiet] = -60 + rng.normal(0, 1, quiet.sum()), -66 + rng.normal(0, 1, quiet.sum())
    got = speakers.activity_of([a, b])
    right = [s == {int(t)} for s, t, q in zip(got, turn, quiet, strict=True) if not q]
    assert np.mean(right) >= 0.95


def test_highlights_and_tighten():
    words = [{"text": "so", "start": 0.0, "end": 0.2}, {"text": "um", "start": 0.3, "end": 0.5}, {"text": "money", "start": 1.5, "end": 2.0}]
    got = highlights.tighten(words)
    assert got["segments"] == [(0.0, 0.27), (1.43, 2.3)] and got["duration"] == pytest.approx(1.14)
    segs = [{"start": 5.0 * k, "end": 5.0 * k + 4.8, "text": f"Sentence number {k}."} for k in range(10)]
    assert highlights.fit_clip(segs, 2, 3, 15, 30) == (2, 5)
    assert highlights.fit_clip([s | {"text": "brought to you by us"} for s in segs], 2, 3, 15, 30) is None


def test_entry_and_oracles(spark):
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert entry.entry(spark).limit(1).count() == 1
