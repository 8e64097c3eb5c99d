"""Operators that the other tests don't touch: each runs on a small recording and gives what its rule says."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronoweft.operators import captions, chapters, highlights, intervals, joins, replies, script, sequences, signal, speakers, takes, timeline

W = "rec_id long, ord long, start double, end double, text string"
R = "rec_id long, ord long, start double, end double"


@pytest.fixture(scope="module")
def words(spark):
    text = "so um today we talk about the market crash, and why most people lose money. never sell in a panic. the market comes back".split()
    return spark.createDataFrame([(1, k, 0.5 * k, 0.5 * k + 0.4, w) for k, w in enumerate(text)], W)


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(1, 0.05 * k, -20.0 if (k // 10) % 2 else -60.0) for k in range(260)], "rec_id long, t double, db double")


def vals(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_captions(spark, words, samples):
    cues = spark.createDataFrame([(1, 0, 0.0, 0.05, "a"), (1, 1, 0.05, 2.0, "b c"), (1, 2, 0.1, 2.0, "b c")], W)
    assert vals(captions.min_durations(cues), "text")[0][0].startswith("a")
    assert [r["ord"] for r in captions.drop_repeats(cues).orderBy("ord").collect()] == [0, 1]
    for f in (captions.sentence_groups, captions.readable_groups, captions.capped_groups):
        got = f(words).orderBy("cue").collect()
        assert " ".join(r["text"] for r in got).split() == [r["text"] for r in words.orderBy("ord").collect()]
    assert captions.respread(words).count() == words.count()
    assert captions.refine_words(words, samples).count() == words.count()
    aligned = captions.align_to_onsets(cues, samples).orderBy("cue", "k").collect()
    assert all(r["end"] >= r["start"] for r in aligned) and len(aligned) == 5
    line = spark.createDataFrame([(1, 0, 0.0, 1.4, "SO UM TODAY"), (1, 1, 1.5, 3.0, "two words")], W)
    timed = captions.carry_word_times(line, words).orderBy("cue", "k").collect()
    assert [r["estimated"] for r in timed] == [False] * 3 + [True] * 2
    style = spark.createDataFrame([({"fill": "#fff", "font": "A"}, {"fill": "", "font": "B"})], "p map<string,string>, o map<string,string>").select(captions.merge_style("p", "o").alias("s")).first()["s"]
    assert style == {"fill": "#fff", "font": "B"}


def test_text_operators(spark, words):
    cues = spark.createDataFrame([(1, 0, 0, 0.0, "market market prices"), (1, 1, 1, 5.0, "prices crash crash")], "rec_id long, ord long, cue long, start double, text string").withColumn("part", F.col("cue")).withColumn("end", F.col("start") + 4)
    assert vals(chapters.most_said(cues), "label") == [("Crash",), ("Market",)]
    assert ("market", 0.0) in vals(chapters.broll_terms(cues), "term", "at")
    assert chapters.digest(cues).first()["digest"].startswith("market")
    assert chapters.evenly(words, 5).count() == 5
    assert vals(highlights.broll_plan(words, [("m.jpg", ["market"])]), "at", "word") == [(3.5, "market")]
    assert highlights.tightened(words).count() >= 1
    moment = spark.createDataFrame([(1, 0, 0.0, 6.0)], R)
    assert 0 <= highlights.hook_check(words, moment).first()["score"] <= 100
    assert takes.phrase_pairs(words).count() >= 1
    made = takes.review(spark.createDataFrame([(1, 0.0, 2.0, "t")], "rec_id long, start double, end double, text string"), spark.createDataFrame([(1, 0.5, 1.0, "s")], "rec_id long, start double, end double, text string"), spark.createDataFrame([(1, 3.0, 4.0, "f")], "rec_id long, start double, end double, text string"))
    assert vals(made, "kind") == [("filler",), ("take",)]


def test_scripts_and_replies(spark, words):
    scripts = spark.createDataFrame([(1, "Today we talk about the market crash.\nNever sell in a panic.\nThe market comes back.")], "rec_id long, script string")
    cues = sequences.word_cues(words, 0.7).withColumnRenamed("cue", "ord").withColumn("ord", F.col("ord").cast("long"))
    assert script.align_to_script(cues, scripts).count() == cues.count()
    for f in (script.script_takes, script.script_keep, script.script_attempts):
        assert f(words, scripts).count() >= 0
    said = [r.asDict() for r in words.orderBy("ord").collect()]
    assert script.keep_every_line_of(said, "never sell in a panic", [{"start": 7.0, "end": 9.5}]) != [{"start": 7.0, "end": 9.5}]
    reply = spark.createDataFrame([(1, '{"cuts":[{"from":1,"to":1,"words":"um"}]}')], "rec_id long, reply string")
    assert vals(replies.cleanup_cuts(words, reply), "text") == [("um",)]
    assert reply.select(replies.reply_truncated("reply").alias("t"), replies.reply_json("reply").alias("j")).first()["t"] is False


def test_signals(spark, samples):
    levels = spark.createDataFrame([("m", i, -20.0 if i % 100 < 60 else -60.0) for i in range(500)], "media string, i long, db double")
    clips = spark.createDataFrame([(1, "a", 0, "m", 1.0, 3.0, 0.0, 2.0, 1.0, False), (1, "b", 0, "m", 0.0, 4.0, 0.0, 4.0, 1.0, False)], "rec_id long, mic string, clip long, media string, seq_start double, seq_end double, in_point double, out_point double, speed double, reversed boolean")
    grid = signal.grid_from_clips(clips, levels.select("media", "i", "db"), 0.01)
    assert {r["mic"]: r["count"] for r in grid.groupBy("mic").count().collect()} == {"a": 200, "b": 400}
    assert signal.estimate_offset(grid, "b", "a", 0.01, 0.2).count() == 1
    assert signal.mic_coverage(grid, 0.01).count() == 2
    assert signal.mic_gains(grid).count() == 2
    for f in (speakers.speaker_activity, speakers.loudest_regions):
        assert f(grid).count() >= 0
    assert signal.speech_runs(samples).count() > 3 and signal.onsets(samples).count() > 3 and signal.burst_starts(samples).count() > 0
    one = spark.createDataFrame([(1, n, 0.5 if n % 200 < 100 else 0.0) for n in range(1000)], "rec_id long, n long, v double")
    quiet = signal.fixed_silences(one, 1000, window=0.02, hop=0.01)
    assert quiet.count() == 5 and signal.refine_silences(quiet, 0.05, 0.01).count() == 5
    assert signal.step_levels(one, 1000, 0.1).count() == 10
    g = spark.createDataFrame([(1, s, 1 if 100 <= s < 400 else 2, -60.0 if 100 <= s < 400 else -20.0, 0.0) for s in range(600)], "rec_id long, slot long, state int, peak double, rel double")
    assert vals(signal.quiet_stretches(g, -25.0), "start") and signal.versus_others(g, g.select("rec_id", "slot", F.col("peak").alias("db"))).first()["turn"] == -40.0
    w = spark.createDataFrame([(1, k, float(k), k + 0.5, "w") for k in (0, 1, 4, 5)], W)
    assert signal.audible_words(w, g).count() >= 3
    assert vals(signal.wordless_noise(w, g, spark.createDataFrame([(1, 6.0)], "rec_id long, total double"), -25.0, signal.TUNING["balanced"]), "start")


def test_ranges(spark):
    cuts = spark.createDataFrame([(1, 0, 1.0, 2.0, "a", True, False), (1, 1, 2.02, 3.0, "b", False, False)], R + ", text string, needs_review boolean, estimated boolean")
    assert vals(intervals.tidy(cuts, 0.1, 0.05), "start", "end", "text", "needs_review") == [(1.0, 3.0, "a / b", True)]
    words = spark.createDataFrame([(1, k, s, s + 0.3) for k, s in enumerate((1.4, 5.0, 6.0))], R)
    assert (1, 2.02) in vals(intervals.protect_words(cuts.select("rec_id", "ord", "start", "end"), words), "ord", "start")
    keeps = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, 4.0, 6.0)], R)
    items = spark.createDataFrame([(1, 0, 1.5, 4.5)], R)
    assert vals(intervals.remap_first_overlap(items, keeps), "start", "end") == [(0.5, 1.0)]
    plan = intervals.plan_chunks(spark.createDataFrame([(1, 25)], "rec_id long, total long"), 10, 4)
    assert vals(plan, "from_i", "to_i", "own_from", "own_to") == [(0, 10, 0, 8), (6, 16, 8, 14), (12, 22, 14, 20), (18, 25, 20, 25)]
    assert intervals.split_chunk(plan, 4).count() == 8
    found = spark.createDataFrame([(1, 0, 7, 7, 1.0, 2.0, "x", False), (1, 1, 1, 1, 1.0, 2.0, "x", False), (1, 1, 3, 3, 3.0, 4.0, "y", True)], "rec_id long, chunk int, from_idx long, to_idx long, start double, end double, text string, needs_review boolean")
    assert vals(intervals.merge_chunk_cuts(plan, found), "start", "text") == [(1.0, "x"), (3.0, "y")]
    pieces = lambda at: spark.createDataFrame([(1, 0, 0.0, 5.0, at, 1.0)], "rec_id long, piece long, in_point double, out_point double, seq_start double, speed double")
    assert vals(joins.retime(spark.createDataFrame([(1, 0, 11.0, 12.0), (1, 1, 90.0, 91.0)], R), pieces(10.0), pieces(20.0)), "start") == [(21.0,), (90.0,)]
    assert intervals.fixed_chunks(items, 2).first()["chunk"] == 0


def test_shots(spark):
    regions = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 10.0, 20.0)], "rec_id long, angle long, start double, end double")
    totals = spark.createDataFrame([(1, 20.0)], "rec_id long, total double")
    assert [x[0] for x in vals(speakers.director(regions, totals, 2), "angle")] == [0, 1]
    assert vals(speakers.layouts(regions, totals), "mode") == [("single",), ("single",)]
    segs = spark.createDataFrame([(1, k, float(k), k + 1.0) for k in range(6)], R)
    plan = speakers.rotate(segs, 3, mode="pingpong")
    assert [r["angle"] for r in plan.orderBy("start").collect()] == [0, 1, 2, 1, 0, 1]
    assert speakers.plan_stats(plan).first()["switches"] == 5
    drawn = [r["angle"] for r in speakers.drawn(segs, 3).orderBy("start").collect()]
    assert all(a != b for a, b in zip(drawn, drawn[1:], strict=False)) and speakers.drawn(segs, 3, "weighted").count() == 6
    series = spark.createDataFrame([(1, s, i, 5.0 if (s == "a") == (i < 5) else 1.0) for s in "ab" for i in range(10)], "rec_id long, speaker string, i long, v double")
    assert [x[0] for x in vals(speakers.turns_of(series, 1.0, 2.0), "speaker")] == ["a", "b"]
    pairs = spark.createDataFrame([(1, "m1", "p1", 0.9), (1, "m1", "p2", 0.8), (1, "m2", "p1", 0.85), (1, "m2", "p2", 0.1)], "rec_id long, mic string, person string, r double")
    assert vals(speakers.assign(pairs), "mic", "person") == [("m1", "p1"), ("m2", "p2")]


def test_timeline_tables(spark):
    p = spark.createDataFrame([(1, 0, "s", 2.0, -20.0), (1, 1, "s", 2.0, -14.0), (1, 2, "s", 0.2, None)], "rec_id long, ord long, src string, dur double, lufs double")
    assert [r["gain"] for r in timeline.piece_gains(p).orderBy("ord").collect()] == [0.0, -6.0, -6.0]
    assert timeline.free_name("Cut", spark.createDataFrame([("Cut",), ("Cut 2",)], "name string")).first()["name"] == "Cut 3"
    plan = spark.createDataFrame([(1, 0.0, 1.0, 0), (1, 1.0, 1.01, 1), (1, 1.01, 2.0, 0)], "rec_id long, start double, end double, angle long")
    assert vals(timeline.snap_plan(plan, 25.0), "s", "e", "angle") == [(0, 50, 0)]
    clips = spark.createDataFrame([(1, 1, "a.wav", 0.0, 4.0, 0.0, 4.0, 1.0, False, False, False), (1, 2, "a.wav", 0.0, 4.0, 0.0, 4.0, 1.0, False, False, False)], "rec_id long, track int, media string, start double, end double, in_point double, out_point double, speed double, reversed boolean, disabled boolean, muted boolean")
    pieces, inputs = timeline.mix_plan(clips)
    assert pieces.first()["streams"] == 2 and inputs.first()["to"] == 4.5
    assert timeline.transcribe_source(clips).first()["media"] == "a.wav" and timeline.pieces_of(clips).count() == 2
    kinds = spark.createDataFrame([(429, None, ""), (None, 28, ""), (None, None, "Invalid API key")], "s int, c int, r string").select(timeline.error_kind(F.col("s"), F.col("c"), F.col("r")).alias("k"))
    assert [r["k"] for r in kinds.collect()] == ["rate_limit", "network", "bad_key"]
