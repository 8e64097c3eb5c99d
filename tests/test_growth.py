"""Work that must grow no faster than its rows: what is read, looked at or computed more than once."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoweft.functions import timecode
from chronoweft.functions import words as lists
from chronoweft.operators import chapters, highlights, intervals, replies, retakes, script, signal, takes


class Heard:
    """A phrase's sounds that count how often they are gone through or asked."""

    looks = 0

    def __init__(self, sounds):
        self.sounds = frozenset(sounds)

    def __contains__(self, x):
        Heard.looks += 1
        return x in self.sounds

    def __iter__(self):
        Heard.looks += 1
        return iter(self.sounds)


def test_later_phrases_are_looked_at_once_for_a_phrase():
    rows = []
    for k in range(30):
        said = [f"w{k}x{j}" for j in range(6)] if k != 20 else [f"w3x{j}" for j in range(6)]
        rows.append({"p": k, "own": True, "gone": False, "nod": False, "said": said, "sounds": said, "heard": Heard(said), "ended": True, "start": float(k), "end": k + 0.5, "speaker": None, "agrees": False, "negative": False, "question": False, "asks": False})
    found = list(retakes._retold(rows, {"max_gap": 60.0, "far": 90.0}))
    assert [(i, t) for i, _, t in found] == [(3, None)]
    assert Heard.looks <= 30 * 29 / 2


def test_lists_of_structs_by_columns():
    kind = pa.list_(pa.struct([("a", pa.float64()), ("b", pa.string()), ("c", pa.int64()), ("d", pa.list_(pa.string()))]))
    rows = [[{"a": 0.5, "b": None, "c": 1, "d": ["x"]}, {"a": None, "b": "y", "c": None, "d": None}], [], [{"a": 2.0, "b": "", "c": 1 << 60, "d": []}]]
    assert signal.records(pa.array(rows, kind)) == rows
    assert signal.records(pa.array([[], *rows], kind)[1:]) == rows
    assert signal.records(pa.array([], kind)) == []


@pytest.mark.parametrize("again", [False, True])
def test_keywords_leave_a_task_once_for_many_cues(spark, monkeypatch, again):
    texts = ["Red' ‘Red’ blue 12 9a the नमस्ते", "red BLUE ab x''y", None, "", "''' - Ünder blue", "red"]
    rows = [("a" if k % 3 else None, k // 2 if again else k, t) for k, t in enumerate(texts * 3)]
    df = spark.createDataFrame(rows, "rec_id string, cue long, text string")
    want = {}
    for key, cue, text in rows:
        for w in re.split("[^a-z0-9'ऀ-ॣ०-ॿ]+", (text or "").lower().translate(str.maketrans("‘’ʼ`", "''''"))):
            w = w.strip("'")
            if key and w and w not in lists.STOP and (w[0] in "0123456789" or len(w.replace("'", "")) >= 3):
                want.setdefault((key, w), []).append(cue)
    n = sum(key is not None for key, _, _ in rows)
    scores = chapters.keyword_scores(df)
    assert {(r.rec_id, r.word): (r.tf, r.df, round(r.score, 9)) for r in scores.collect()} == {k: (len(c), len(set(c)), round(len(c) * math.log(1 + n / len(set(c))), 9)) for k, c in want.items()}
    part = pa.RecordBatch.from_pylist([{"rec_id": "a", "cue": k, "text": "red blue red"} for k in range(50)])
    out = [r for b in chapters._counted(lists.STOP, 3, True, False)(iter([part, part])) for r in b.to_pylist()]
    assert sorted((r["word"], r["tf"], r["df"]) for r in out) == [("blue", 100, 100), ("red", 200, 100)]


def test_common_ends_need_no_table(monkeypatch):
    rng = np.random.default_rng(3)

    def by_table(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
        out, i, j = [], len(a), len(b)
        while i and j:
            if a[i - 1] == b[j - 1]:
                out.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif table[i - 1][j] >= table[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return out[::-1]

    for _ in range(300):
        a, b = ([str(x) for x in rng.integers(0, 4, rng.integers(1, 14))] for _ in range(2))
        assert script.match_pairs(a, b) == by_table(a, b)
        assert script.match_pairs([*a, *b], b) == by_table([*a, *b], b)
    monkeypatch.setattr(script.np, "zeros", lambda *a: pytest.fail("a table for equal words"))
    said = [f"w{k}" for k in range(3000)]
    assert script.match_pairs(said, said) == [(k, k) for k in range(3000)]


def test_stumbles_and_fillers_by_columns(spark):
    said = ["the", "the", "plan", None, "you", "know", ",", "um", "uh", "works", "we", "try", "we", "try", "we", "try", "7", "7"]
    rows = [(r, k, k * 0.5, k * 0.5 + 0.4, t, ["A", None][r % 2]) for r in (2, 5) for k, t in enumerate(said)]
    df = spark.createDataFrame(rows[::-1], "rec_id int, ord long, start double, end double, text string, speaker string")
    for found, want in ((takes.stumbles(df), [(0.0, 0.5, "the", False), (5.0, 7.0, "we try we try", False)]), (takes.fillers(df), [(3.5, 4.4, "um uh")])):
        assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().toString()
        assert sorted(tuple(r) for r in found.collect()) == [(r, *w) for r in (2, 5) for w in want]


def source_is_read_again(df):
    """Does a result's plan still hold the rows it was made from, which every branch would compute anew."""
    return "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()


def test_words_of_protected_cuts_are_computed_once(spark):
    words = spark.createDataFrame([(r, k, k * 10, k * 10 + 4) for r in (1, 2) for k in range(2 * r)], "rec_id long, ord long, start long, end long")
    cuts = spark.createDataFrame([(1, 0, -5, 30), (2, 0, -5, 30), (2, 1, 12, 13), (3, 0, 1, 2)], "rec_id long, ord long, start long, end long")
    found = intervals.protect_words(cuts, words, 1, 1, 2, 1000)
    assert sorted(tuple(r) for r in found.select("rec_id", "ord", "start", "end").collect()) == [(1, 0, -5, 30), (2, 0, -5, -1), (2, 0, 5, 9), (2, 0, 15, 19), (2, 0, 25, 29), (3, 0, 1, 2)]
    assert not source_is_read_again(found)


def test_words_of_reply_cuts_are_computed_once(spark):
    words = spark.createDataFrame([(1, k, float(k), k + 0.5, f"w{k}") for k in range(20)], "rec_id long, ord long, start double, end double, text string")
    said = spark.createDataFrame([(1, '{"cuts":[{"from":3,"to":4,"words":"w5 w6","category":"filler"}]}')], "rec_id long, reply string")
    found = replies.cleanup_cuts(words, said)
    assert [(r.start, r.end, r.text, r.from_idx, r.to_idx) for r in found.collect()] == [(5.0, 6.5, "w5 w6", 5, 6)]
    assert not source_is_read_again(found)


def test_sentences_of_highlights_are_computed_once(spark):
    rows = [(r, k, k * 4.0, k * 4.0 + 3.5, f"This is the number {k} you need to know.") for r in (1, 2) for k in range(8)]
    found = highlights.highlights(spark.createDataFrame(rows, "rec_id long, ord long, start double, end double, text string"), 6, 30)
    got = found.collect()
    assert got and {r.rec_id for r in got} == {1, 2}
    assert not source_is_read_again(found)
    ranges = spark.createDataFrame([(1, 0.0, 5.0, 1.0), (1, 4.0, 6.0, 3.0), (1, 5.0, 9.0, 3.0), (1, 6.0, 9.0, 3.0), (1, 9.0, 9.5, 0.5)], "rec_id long, start double, end double, score double")
    assert sorted(r.start for r in highlights.best_apart(ranges, 2).collect()) == [4.0, 6.0]


def test_crops_step_by_step(spark):
    rng = np.random.default_rng(5)
    rows = [(None if k % 7 == 0 else float(rng.random()), float(rng.random()), float(rng.random() * 0.8), float(rng.integers(320, 1920)), float(rng.integers(180, 1080)), [0.5625, 1.0, 1.7][k % 3]) for k in range(120)]
    df = spark.createDataFrame(rows, "cx double, cy double, size double, width double, height double, aspect double")
    whole = df.select("*", timecode.face_crop(*(F.col(c) for c in df.columns)).alias("c"))
    steps = timecode.face_crops(df)
    assert sorted(map(str, steps.collect())) == sorted(map(str, whole.collect()))
    cases = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN")
    assert cases(steps) < 20 < cases(whole)
