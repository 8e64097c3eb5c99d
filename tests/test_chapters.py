"""Chapters by joins against dense sums in memory."""

from __future__ import annotations

import numpy as np

from chronoweft.operators import chapters
from tests.chapters_in_memory import chapters_of

TOPICS = ["market stock shares trading", "cricket batting bowling wicket", "cooking recipe kitchen spices", "engine gearbox wheels brakes", "बाजार शेयर निवेश पैसा", "garden flowers watering seeds"]
FILLER = "today really people something because little never always".split()


def talk(rng, lines, topics, step=3.2):
    out, t = [], 0.0
    for k in range(lines):
        said = TOPICS[k * topics // lines % len(TOPICS)].split()
        words = [said[int(j)] for j in rng.integers(0, 4, int(rng.integers(0, 4)))] + [FILLER[int(j)] for j in rng.integers(0, 8, int(rng.integers(1, 4)))]
        out.append({"ord": k, "start": round(t, 3), "end": round(t + step - 0.2, 3), "text": " ".join(words)})
        t += step * float(rng.choice([1.0, 1.0, 0.7, 3.0]))
    return out


def frame(spark, talks):
    rows = [(r, c["ord"], c["start"], c["end"], c["text"], 1, "x") for r, cs in talks.items() for c in cs]
    return spark.createDataFrame(rows, "rec_id long, ord long, start double, end double, text string, k int, part string").repartition(3)


def found(df, **options):
    out = {}
    for r in chapters.chapters(df, **options).orderBy("rec_id", "chapter").collect():
        out.setdefault(r["rec_id"], []).append((r["start"], r["title"]))
    return out


def test_topics_are_chapters(spark):
    cues = [{"ord": k, "start": 3.2 * k, "end": 3.2 * k + 3, "text": f"today {TOPICS[k // 60].split()[k % 4]} and {TOPICS[k // 60].split()[(k + 1) % 4]}"} for k in range(180)]
    got = found(frame(spark, {1: cues}))[1]
    assert len(got) == 3 and all(abs(s - 192 * k) <= 30 for k, (s, _) in enumerate(got))


def test_chapters_against_memory(spark):
    rng = np.random.default_rng(3)
    talks = {k: talk(rng, int(rng.integers(1, 400)), int(rng.integers(1, 7))) for k in range(14)}
    talks[20] = [{"ord": k, "start": 10.0, "end": 9.0, "text": t} for k, t in enumerate(["", "same", None, "time"])]
    talks[21] = [{"ord": k, "start": 5.0 * k, "end": 5.0 * k + 1, "text": "" if k % 2 else None} for k in range(60)]
    talks[22] = [{"ord": 0, "start": 0.0, "end": 1.0, "text": None}]
    for options in ({}, {"least": 12.0}, {"least": 45.0, "most": 4}):
        want = {r: chapters_of(cs, **options) for r, cs in talks.items()}
        assert found(frame(spark, talks), **options) == {r: c for r, c in want.items() if c}
    assert sum(len(c) > 2 for c in want.values()) > 3
    assert chapters.chapters(frame(spark, talks).limit(0)).count() == 0


def test_a_talk_of_twenty_thousand_lines(spark):
    talks = {1: talk(np.random.default_rng(5), 20_000, 90)}
    assert found(frame(spark, talks))[1] == chapters_of(talks[1])
