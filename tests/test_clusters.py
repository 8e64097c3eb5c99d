"""Rows that are alike within tolerances against going through them one by one."""

from __future__ import annotations

import numpy as np

from chronoweft.operators import clusters, timeline


def one_by_one(rows, tolerances):
    kept, out = [], []
    for r in sorted(rows, key=lambda r: (r[2], r[3], r[4], r[5])):
        q = next((q for q in kept if q[:2] == r[:2] and all(abs(x - y) < t for x, y, t in zip(q[3:6], r[3:6], tolerances, strict=True))), None)
        if q is None:
            kept.append(r)
            q = r
        out.append((*r[:6], q[2:6]))
    return sorted(out)


def test_first_kept_against_one_by_one(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(3)), "ab"[int(rng.integers(2))], int(rng.integers(4)), float(rng.integers(0, 60)) * 0.004, float(rng.integers(0, 4)) * 0.005, 1.0 + 0.0004 * float(rng.integers(0, 4))) for _ in range(300)]
    # a long chain, values at edges, and repeated rows
    rows += [(9, "c", k, 5 + 0.009 * k, 0.0, 1.0) for k in range(30)] + [(9, "c", 50 + k, 5 + 0.009 * k, 0.0, 1.0) for k in range(30)][::-1] + [(8, "d", 0, 0.01, 0.0, 1.0), (8, "d", 1, 0.02, 0.0, 1.0), (8, "d", 2, 0.0199, 0.0, 1.0), (8, "d", 3, 0.0, 0.0, 1.0)] * 2
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "rec_id long, media string, track int, start double, from double, speed double, p string, leader int").drop("leader").repartition(3)
    near = {"start": 0.01, "from": 0.01, "speed": 1e-3}
    got = sorted((*[r[c] for c in ("rec_id", "media", "track", "start", "from", "speed")], tuple(r["leader"])) for r in clusters.first_kept(df, ["rec_id", "media"], ["track", "start", "from", "speed"], near).collect())
    assert got == one_by_one(rows, near.values())
    assert clusters.first_kept(df.limit(0), ["rec_id", "media"], ["track", "start"], near).count() == 0


def test_pieces_across_an_edge_are_one(spark):
    columns = "rec_id long, track int, media string, start double, end double, in_point double, out_point double, speed double, reversed boolean, disabled boolean, muted boolean"
    clip = lambda track, start: (1, track, "a.wav", start, start + 4.0, 1.0, 5.0, 1.0, False, False, False)
    pieces, inputs = timeline.mix_plan(spark.createDataFrame([clip(2, 10.0049), clip(1, 10.0051), clip(3, 10.0152), clip(4, 10.0249)], columns))
    assert sorted((r["track"], r["start"], r["streams"]) for r in pieces.collect()) == [(1, 10.0051, 2), (3, 10.0152, 2)]
    assert inputs.first()["streams"] == 2


def test_free_name_beyond_any_number(spark):
    names = spark.range(2, 10_050).selectExpr("concat('Cut ', id) as name")
    one = lambda df: timeline.free_name("Cut", df).first()["name"]
    assert one(names) == "Cut"
    assert one(names.unionByName(spark.createDataFrame([("Cut",), ("Cut",), ("Cut 07",), ("Cut x",), ("Cutting",)], "name string"))) == "Cut 10050"
    assert one(names.filter("name <> 'Cut 77'").unionByName(spark.createDataFrame([("Cut",)], "name string"))) == "Cut 77"
    assert one(names.limit(0)) == "Cut"
