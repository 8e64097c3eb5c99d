"""Breaking subtitles in two: every break measured whole, and long cues in time that follows their length."""

from __future__ import annotations

import math
import time

import numpy as np

from chronoweft.functions import text as words_
from chronoweft.operators import captions

SAID = "we go to the shop, and then home. Dr. Smith said no! 1,200 dollars in New York because he can… हम बाजार जाते हैं। यह एक लंबा वाक्य है ok? élan naïve ाक ؀ éte 👩‍👩‍👧 kya hai".split()


def by_measuring(text, per_line=42):
    ws = (text or "").split()
    if len(ws) < 2 or words_.visible(" ".join(ws)) <= per_line:
        return " ".join(ws)
    mixed = captions.hinglish(ws)

    def score(k):
        top, low = words_.visible(" ".join(ws[:k])), words_.visible(" ".join(ws[k:]))
        cost = captions.break_cost(ws[k - 1], ws[k], mixed)
        return (max(0, top - per_line) + max(0, low - per_line)) * 10 + (100 if cost == math.inf else 2 * cost) + abs(top - 0.95 * low) / per_line * 6 + (4 if k in (1, len(ws) - 1) and len(ws) >= 3 else 0)

    k = min(range(1, len(ws)), key=score)
    return " ".join(ws[:k]) + "\n" + " ".join(ws[k:])


def test_same_breaks_as_by_measuring():
    rng = np.random.default_rng(5)
    latin = [w for w in SAID if w.isascii()]
    for k in range(400):
        text = " ".join(str(w) for w in rng.choice(latin if k % 2 else SAID, int(rng.integers(0, 60))))
        assert captions.two_lines(text) == by_measuring(text), text
    assert captions.two_lines(None) == "" and captions.two_lines("a" * 50) == "a" * 50


def test_long_cue_in_time():
    text = " ".join(["élan", "und", "ein", "Wort"] * 2_000)
    start = time.perf_counter()
    top, low = captions.two_lines(text).split("\n")
    assert time.perf_counter() - start < 5 and abs(len(top) - len(low)) < 2_500
