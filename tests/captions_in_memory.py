"""Captions of one recording in memory, word by word: what the windows and stretches have to give."""

from __future__ import annotations

import math

from chronoweft.functions import text as words_
from chronoweft.operators.captions import RULES, _frame, _split, break_cost, hinglish, rate, sentence_end


def group(words, most_words=0, fits=None, rules=None):
    rules, mixed = rules or RULES, hinglish([w["text"] for w in words])
    fits, length = fits or (lambda a, b: True), lambda k: words_.visible(words[k]["text"]) + 1
    out, start = [], 0
    for k, w in enumerate(words):
        nxt = words[k + 1] if k + 1 < len(words) else None
        if nxt is None or sentence_end(w["text"]) or nxt["start"] - w["end"] >= rules["pause"] - 1e-9 or (w.get("speaker") and nxt.get("speaker") and w["speaker"] != nxt["speaker"]):
            while k + 1 - start > 300:
                cut = min(range(start + 150, start + 251), key=lambda c: break_cost(words[c - 1]["text"], words[c]["text"], mixed))
                out += _split(words, start, cut, most_words, fits, mixed, rules, length)
                start = cut
            out += _split(words, start, k + 1, most_words, fits, mixed, rules, length)
            start = k + 1
    return out


def time_groups(words: list[dict], groups: list[tuple[int, int]], fps: float, rules: dict | None = None) -> list[dict]:
    """Captions on frames: s, e and the frame of every word. Each starts on its first word, lasts long enough to see and to read, lingers into silence, and is two frames or at least half a second from the next."""
    rules = rules or RULES
    f = rate(fps)
    half, gap, last, caps = _frame(0.5 * f), rules["gap_frames"], -math.inf, []
    for a, b in groups:
        at = []
        for w in words[a:b]:
            last = max(_frame(w["start"] * f), last + 1)
            at.append(last)
        caps.append({"a": a, "b": b, "words": at, "s": at[0], "spoken": max(last + 1, _frame(words[b - 1]["end"] * f))})
        last += gap
    for k, c in enumerate(caps):
        text = " ".join(w["text"] for w in words[c["a"] : c["b"]])
        many = c["b"] - c["a"] > 1
        want = max(c["spoken"] + _frame(rules["linger"] * f), c["s"] + math.ceil((rules["least_many"] if many else rules["least_one"]) * f - 1e-6))
        speed = rules["cps_deva"] if any("ऀ" <= x <= "ॿ" for x in text) else rules["cps"]
        want = max(want, c["s"] + math.ceil(len(text) / speed * f))
        most = _frame(rules["most"] * f)
        end = min(want, max(c["spoken"], c["s"] + most))
        if k + 1 < len(caps):
            nxt = caps[k + 1]["s"]
            end = min(end, nxt - gap)
            if nxt - end < half:
                chained, apart = nxt - gap, nxt - half
                end = chained if chained - c["s"] <= max(most, c["spoken"] - c["s"]) or apart < c["words"][-1] + 1 else apart
        c["e"] = max(end, c["words"][-1] + 1)
    return caps
