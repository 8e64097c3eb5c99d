"""The overlay's timeline: looks numbered as they appear, gaps and the tail empty, frames read once."""

from __future__ import annotations

from chronoweft.operators import captions


def test_overlay_of_literal_frames(spark):
    rows = [(1, 0, 0.1, 0.2, ["a"]), (1, 1, 0.2, 0.5, ["b"]), (1, 2, 0.5, 0.6, ["a"]), (1, 3, 0.6, 0.7, ["a"]), (1, 4, 1.0, 0.9, ["c"]), (2, 0, 0.0, 1.0, ["b"])]
    frames = spark.createDataFrame(rows, "rec_id long, ord long, start double, end double, words array<string>")
    plan = captions.overlay_plan(frames, 10.0, ["words"])
    got = sorted((r["rec_id"], r["segment"], r["state"], r["frames"]) for r in plan.collect())
    # 1.0 to 1.04 seconds are no whole frame
    assert got == [(1, 1, -1, 1), (1, 2, 0, 1), (1, 3, 1, 3), (1, 4, 0, 2), (1, 5, -1, 2), (2, 1, 0, 10), (2, 2, -1, 2)]


def test_frames_are_made_once(spark):
    words = spark.createDataFrame([(1, k, 0.3 * k, 0.3 * k + 0.2, f"w{k}", None) for k in range(30)], "rec_id long, ord long, start double, end double, text string, speaker string")
    frames = captions.caption_frames(words, 30.0, max_chars=42, mode="karaoke").selectExpr("*", "caption * 1000 + frame as ord")
    plan = captions.overlay_plan(frames, 30.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1
