"""Interval algebra and joins against brute force on literal and random ranges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chronoweft.operators import intervals, joins

R = "rec_id long, ord long, start double, end double"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def ranges(spark):
    rng = random.Random(3)
    data = [(k % 3, k, s := float(rng.randint(0, 400)), s + rng.randint(1, 20)) for k in range(90)]
    return data, spark.createDataFrame(data, R)


def test_merge_literal(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 1.02, 2.0), (1, 2, 5.0, 6.0)], R)
    assert rows(intervals.merge(df, 0.05), "start", "end", "n") == [(0.0, 2.0, 2), (5.0, 6.0, 1)]


def test_complement_literal(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, 4.0, 5.0)], R)
    totals = spark.createDataFrame([(1, 6.0), (2, 3.0)], "rec_id long, total double")
    assert rows(intervals.complement(df, totals, 0.25), "rec_id", "start", "end") == [(1, 0.0, 1.0), (1, 2.0, 4.0), (1, 5.0, 6.0), (2, 0.0, 3.0)]


def test_merge_and_complement_cover_everything(spark, ranges):
    data, df = ranges
    totals = spark.createDataFrame([(k, 500.0) for k in range(3)], "rec_id long, total double")
    kept = {r["rec_id"]: r["total"] for r in intervals.total(intervals.complement(df, totals)).collect()}
    cut = {r["rec_id"]: r["total"] for r in intervals.total(intervals.merge(df)).collect()}
    assert all(kept[k] + cut[k] == 500.0 for k in range(3))


def test_subtract(spark, ranges):
    data, df = ranges
    cuts, keeps = df.filter("ord % 2 = 0"), df.filter("ord % 2 = 1")
    got = rows(intervals.subtract(cuts, keeps), "ord", "start", "end")
    want = []
    for rec, k, s, e in data[::2]:
        free = [t for t in range(int(s), int(e)) if not any(r == rec and a <= t < b for r, _, a, b in data[1::2])]
        for t in free:
            if want and want[-1][0] == k and want[-1][2] == t:
                want[-1] = (k, want[-1][1], float(t + 1))
            else:
                want.append((k, float(t), float(t + 1)))
    assert got == sorted(want)


def test_ripple_words(spark):
    words = spark.createDataFrame([(1, 0, 0.0, 0.5), (1, 1, 1.9, 2.2), (1, 2, 2.2, 2.8), (1, 3, 3.1, 3.5)], R)
    cuts = spark.createDataFrame([(1, 0, 2.0, 3.0)], R)
    got = rows(intervals.ripple(words, cuts), "ord", "start", "end")
    assert [g[0] for g in got] == [0, 3]
    assert got[1][1:] == pytest.approx((2.1, 2.5))


def test_ripple_keeps_order(spark, ranges):
    data, df = ranges
    got = intervals.ripple(df.filter("ord % 2 = 0"), df.filter("ord % 2 = 1"), kind="lines").collect()
    for rec in range(3):
        moved = sorted((r for r in got if r["rec_id"] == rec), key=lambda r: r["ord"])
        before = {k: s for r, k, s, _ in data if r == rec}
        by_old, by_new = sorted(moved, key=lambda r: before[r["ord"]]), [r["start"] for r in sorted(moved, key=lambda r: before[r["ord"]])]
        assert by_new == sorted(by_new) and len(by_old) == len(moved)


def test_lines_lose_the_text_of_cut_words(spark):
    lines = spark.createDataFrame([(1, 0, 0.0, 3.0, "one two three"), (1, 1, 5.0, 6.0, "gone")], R + ", text string")
    words = spark.createDataFrame([(1, 0, 0, 0.0, 0.5, "one"), (1, 0, 1, 1.0, 1.5, "two"), (1, 0, 2, 2.0, 2.5, "three"), (1, 1, 3, 5.0, 6.0, "gone")], "rec_id long, line long, ord long, start double, end double, text string")
    cuts = spark.createDataFrame([(1, 0, 0.9, 1.6), (1, 1, 4.9, 6.1)], R)
    got = intervals.ripple_lines(lines, words, cuts).collect()
    assert [(r["ord"], r["text"]) for r in got] == [(0, "one three")]


def test_overlap_join(spark, ranges):
    data, df = ranges
    other = df.filter("ord % 2 = 1").selectExpr("rec_id", "ord as o", "start as s", "end as e")
    got = rows(joins.overlap(df.filter("ord % 2 = 0"), other, ("start", "end"), ("s", "e")), "ord", "o")
    assert got == sorted((a[1], b[1]) for a in data[::2] for b in data[1::2] if a[0] == b[0] and a[2] < b[3] and a[3] > b[2])


def test_nearest_edge_and_line(spark, ranges):
    data, df = ranges
    points = spark.createDataFrame([(k % 3, float(t)) for k, t in enumerate(range(-5, 460, 7))], "rec_id long, t double")
    for r in joins.nearest_edge(points, df).collect():
        assert abs(r["edge"] - r["t"]) == min(abs(x - r["t"]) for d in data if d[0] == r["rec_id"] for x in d[2:])
    far = lambda d, t: d[2] - t if t < d[2] else t - d[3] if t >= d[3] else 0
    for r in joins.nearest_line(points, df).collect():
        mine = [d for d in data if d[0] == r["rec_id"]]
        assert far(next(d for d in mine if d[1] == r["line"]), r["t"]) == min(far(d, r["t"]) for d in mine)


def test_in_speech(spark):
    runs = spark.createDataFrame([(1, 0, 1.0, 2.0)], R)
    points = spark.createDataFrame([(1, 0.95), (1, 1.0), (1, 2.05), (1, 2.5)], "rec_id long, t double")
    assert rows(joins.in_speech(points, runs, pad=0.1), "t", "in_speech") == [(0.95, True), (1.0, True), (2.05, True), (2.5, False)]


def test_media_to_timeline(spark):
    items = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, 3.9, 4.5)], R)
    pieces = spark.createDataFrame([(1, 0, 0.0, 4.0, 10.0, 2.0)], "rec_id long, piece long, in_point double, out_point double, seq_start double, speed double")
    got = rows(joins.media_to_timeline(items, pieces), "ord", "start", "end")
    assert got == [(0, 10.5, 11.0), (1, pytest.approx(11.95), 12.0)]
    back = joins.timeline_to_media(spark.createDataFrame([(1, 0, 10.5, 11.0)], R), pieces).first()
    assert (back["media_start"], back["media_end"]) == (1.0, 2.0)


def test_split_at(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 10.0)], R)
    bounds = spark.createDataFrame([(1, 4.0), (1, 4.02), (1, 9.99)], "rec_id long, at double")
    assert rows(intervals.split_at(seg, bounds), "start", "end", "cut") == [(0.0, 4.0, False), (4.0, 10.0, True)]


def test_joins_against_brute_force(spark):
    """Equal points and ranges, an empty and a very long range, touching ends, whole numbers and fractions."""
    draw = random.Random(4)
    spans = [(r, round(s, 2), round(s + draw.choice([0, 0.25, 1, 7]), 2)) for r in (1, 2) for s in (draw.randrange(400) / 4 for _ in range(40))] + [(1, 0.0, 1e6), (2, 5.0, 6.0), (2, 6.0, 7.0), (3, 1.0, 2.0)]
    points = [(r, draw.randrange(800) / 8) for r in (1, 2) for _ in range(60)] + [(2, 5.0)] * 3 + [(4, 1.0)]
    left = spark.createDataFrame([(r, n, s, e) for n, (r, s, e) in enumerate(spans)], "rec_id long, a long, start double, end double")
    right = left.select("rec_id", F.col("a").alias("b"), F.col("start").alias("s"), F.col("end").alias("e")).filter("b % 3 <> 1")
    for closed in (False, True):
        hit = [(n, m) for n, (r, s, e) in enumerate(spans) for m, (q, a, b) in enumerate(spans) if m % 3 != 1 and r == q and ((s <= b and e >= a) if closed else (s < b and e > a))]
        assert sorted((r["a"], r["b"]) for r in joins.overlap(left, right, ("start", "end"), ("s", "e"), closed).collect()) == sorted(hit)
    at = spark.createDataFrame(points, "rec_id long, t double")
    want = sorted((r, t) for r, t in points if any(r == q and s <= t < e for q, s, e in spans))
    assert sorted(map(tuple, joins.in_ranges(at, left, slack=0).collect())) == want and want.count((2, 5.0)) == 3
    held = joins.within(at, left, "t", (F.col("start"), F.col("end")), ("start", "end"), 0)
    assert held.count() == sum(r == q and s <= t < e for r, t in points for q, s, e in spans)
