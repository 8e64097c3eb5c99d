"""Repeated takes as joins against the same rules step by step in memory."""

from __future__ import annotations

import numpy as np
import pytest

from chronoweft.operators import retakes
from tests.retakes_in_memory import Retakes, tidy

LINES = [
    "so the main point of this video is saving money early.", "so the main point of this video", "the main point of this video is saving", "what do you think about the budget?", "I think the budget is fine.", "no I do not like it.",
    "um let me do that again", "sorry one more time", "okay", "yes right", "and then we go to the next big thing entirely", "and then we go", "we go to the next big thing entirely after lunch today", "saving money early is the point of everything we do",
    "the the plan works we try we try again", "you should save your money early", "यह एक नया विचार है जो हम करते हैं", "यह एक नया विचार", "it is not the same thing at all", "it is the same thing at all", "he", "money early", "point of this", "let us wait let me try that again",
]


def talk(rng, lines):
    words, t = [], 0.0
    for _ in range(lines):
        line = LINES[int(rng.integers(len(LINES)))].split()
        if rng.random() < 0.3:
            line = line[: int(rng.integers(1, len(line) + 1))]
        if rng.random() < 0.2:
            line.insert(int(rng.integers(len(line))), "um")
        speaker = [None, "A", "B"][int(rng.integers(3))]
        for w in line:
            d = float(np.round(rng.uniform(0.1, 0.5), 3))
            words.append({"ord": len(words), "start": round(t, 3), "end": round(t + d, 3), "text": w, "speaker": speaker, "conf": None if rng.random() < 0.2 else float(np.round(rng.random(), 3)), "estimated": bool(rng.random() < 0.05), "cue_start": bool(rng.random() < 0.3), "cue_end": False})
            t += d + 0.05
        t += float(rng.choice([0.3, 0.6, 1.0, 4.0, 30.0], p=[0.2, 0.4, 0.2, 0.15, 0.05]))
    return words


@pytest.mark.parametrize("options", [{}, {"keep": "best", "min_run": 2, "sim": 0.5}, {"keep": "confident", "people": "one"}, {"people": "many", "window": 4}, {"keep": "best", "max_gap": 200.0, "aside_words": 4}])
def test_retakes_against_memory(spark, monkeypatch, options):
    monkeypatch.setattr(retakes, "CHUNK", 8)
    monkeypatch.setattr(retakes, "BACK_STEP", 2)
    rng = np.random.default_rng(len(str(options)))
    recs = {k: talk(rng, int(rng.integers(1, 70))) for k in range(24)}
    want = []
    for k, words in recs.items():
        if len(words) >= 2 * max(2, options.get("min_run", 3)):
            want += [(k, c["start"], c["end"], c["text"], c["reason"], c["estimated"]) for c in Retakes(words, **options).run()]
    rows = [(k, *[w[n] for n in ("ord", "start", "end", "text", "speaker", "conf", "estimated", "cue_start", "cue_end")], 1, "g") for k, words in recs.items() for w in words]
    df = spark.createDataFrame(rows, "rec_id long, ord long, start double, end double, text string, speaker string, conf double, estimated boolean, cue_start boolean, cue_end boolean, p long, why string")
    got = [tuple(r) for r in retakes.repeated_takes(df.repartition(3), **options).collect()]
    assert len({r[4] for r in want}) >= 3
    assert sorted(got) == sorted(want)


def test_tidy_is_that_of_memory(spark):
    rng = np.random.default_rng(9)
    cuts = [{"start": float(k) / 10 + j * 1e-4, "end": float(k) / 10 + float(rng.choice([0.05, 0.12, 0.3, 1.0])), "text": ["a", "b", "", "a / b"][int(rng.integers(4))], "reason": str(j), "estimated": bool(rng.integers(2))} for j, k in enumerate(rng.integers(0, 60, 40))]
    df = spark.createDataFrame([(1, c["start"], c["end"], c["text"], c["reason"], c["estimated"], 0, j) for j, c in enumerate(cuts)], "rec_id long, start double, end double, text string, reason string, estimated boolean, kind int, p long")
    want = [(1, c["start"], c["end"], c["text"], c["reason"], c["estimated"]) for c in tidy(cuts)]
    assert sorted(tuple(r) for r in retakes.tidy(df).collect()) == sorted(want)


def test_no_words_no_takes(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 1.0, None), (1, 1, 1.0, 2.0, "")], "rec_id long, ord long, start double, end double, text string")
    assert retakes.repeated_takes(df).count() == 0 and retakes.repeated_takes(df.limit(0)).count() == 0
