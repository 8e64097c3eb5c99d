"""Lines on pieces, bursts, reactions, tracks and the rest."""

from __future__ import annotations

import pytest

from chronoweft.operators import evaluation, joins, speakers, timeline


def test_place_lines(spark):
    s = "rec_id long, ord long, start double, end double, text string"
    lines = spark.createDataFrame([(1, 0, 0.0, 4.0, "one two three four"), (1, 1, 6.0, 8.0, "aa bb")], s)
    words = spark.createDataFrame([(1, k, float(k), k + 0.5, w) for k, w in enumerate("one two three four".split())], s)
    pieces = spark.createDataFrame([(1, 0, 0.0, 2.0, 0.0, 1.0), (1, 1, 6.0, 7.0, 10.0, 1.0)], "rec_id long, piece long, in_point double, out_point double, seq_start double, speed double")
    got = sorted((r["ord"], r["piece"], r["start"], r["end"], r["text"]) for r in joins.place_lines(lines, words.filter("ord < 4"), pieces).collect())
    assert got == [(0, 0, 0.0, 2.0, "one two"), (1, 1, 10.0, 11.0, "aa")]


def test_bursts_and_reactions(spark):
    regions = [(0, 0.0, 20.0), (1, 9.0, 9.5)]
    assert speakers.listener_bursts_of(regions) == [(1, 9.0, 9.5, 0)]
    r = speakers.listener_bursts(spark.createDataFrame([(1, *x) for x in regions], "rec_id long, angle long, start double, end double"))
    plan = spark.createDataFrame([(1, 0.0, 20.0, 0, False)], "rec_id long, start double, end double, angle long, cutaway boolean")
    got = sorted((x["start"], x["end"], x["angle"]) for x in speakers.reaction_shots(plan, r, 5.0).collect())
    assert [g[2] for g in got] == [0, 1, 0] and got[1][:2] == pytest.approx((8.0, 10.1))


def test_pieces_talker_and_cameras(spark):
    assert speakers.short_pieces([(0.0, 10.0)], [(0.0, 4.0, 0), (4.0, 4.3, 1), (4.3, 10.0, 2)]) == [(0.0, 4.3, 0), (4.3, 10.0, 2)]
    levels = spark.createDataFrame([(1, m, i, -20.0 if (m == "a") == (i < 10) else -60.0) for m in "ab" for i in range(20)], "rec_id long, mic string, i long, db double")
    spans = spark.createDataFrame([(1, 0, 0, 9), (1, 1, 0, 19)], "rec_id long, ord long, first long, last long")
    assert {r["ord"]: r["talker"] for r in speakers.talker(levels, spans).collect()} == {0: "a", 1: "both"}
    assert speakers.cameras_of(["Ann", "Speaker 1", "x"], 3, [None, "ann"]) == {"Ann": 1, "Speaker 1": 0, "x": 2}


def test_tracks_and_movement(spark):
    rows = [(1, i, x, 0.5, 0.1) for i in range(10) for x in (0.3 + 0.001 * i, 0.7)] + [(1, 3, 0.05, 0.1, 0.3)]
    got = speakers.face_tracks(spark.createDataFrame(rows, "rec_id long, i long, cx double, cy double, s double"), 10).orderBy("track").collect()
    assert [round(r["cx"], 1) for r in got] == [0.3, 0.7]
    m = speakers.movement(spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0, 2.0])], "rec_id long, i long, pixels array<double>")).orderBy("i").collect()
    assert [r["v"] for r in m] == [0.0, 1.0]


def test_filters_and_placement(spark):
    names = spark.createDataFrame([("Mukta",), ("Arial",)], "name string")
    assert [r["name"] for r in timeline.families(names, " MUK").collect()] == ["Mukta"] and timeline.families(names, "").count() == 2
    src = "we went to the big shop and then we went to the big house".split()
    assert evaluation.placed_windows("went to the big house".split(), src, 5)[-1] == (0, 9)
