"""Captions by stretches and windows against word by word in memory."""

from __future__ import annotations

import numpy as np
import pytest

from chronoweft.functions import text as words_
from chronoweft.operators import captions
from tests import captions_in_memory as memory

SAID = "we go to the shop, and then home. Dr. Smith said no! it is a very extraordinarily long word 1,200 dollars in New York the U.S. market because he can… हम बाजार जाते हैं। यह एक लंबा वाक्य है e.g. ok? élan naïve".split()


def talk(rng, n):
    out, t = [], 0.0
    for k in range(n):
        d = float(np.round(rng.uniform(0.05, 0.6), 3))
        out.append({"ord": k, "start": round(t, 3), "end": round(t + d, 3), "text": SAID[int(rng.integers(len(SAID)))] if rng.random() < 0.98 else "", "speaker": [None, "", "A", "B"][int(rng.integers(4))] if rng.random() < 0.1 else "A"})
        t += d + float(rng.choice([0.0, 0.06, 0.5, 2.0], p=[0.3, 0.55, 0.1, 0.05]))
    return out


def frame(spark, talks):
    rows = [(r, w["ord"], w["start"], w["end"], w["text"] or None, w["speaker"], 1, 2) for r, ws in talks.items() for w in ws]
    return spark.createDataFrame(rows, "rec_id long, ord long, start double, end double, text string, speaker string, k int, caption int").repartition(3)


@pytest.mark.parametrize(("fps", "most_words", "max_chars"), [(29.97, 0, 42), (25.0, 3, 0), (60.0, 5, 18), (23.976, 0, 0)])
def test_captions_against_memory(spark, monkeypatch, fps, most_words, max_chars):
    monkeypatch.setattr(captions, "DEALT", 2)
    rng = np.random.default_rng(int(fps))
    talks = {k: talk(rng, int(rng.integers(1, 160))) for k in range(10)}
    talks[50] = [{"ord": k, "start": 0.3 * k, "end": 0.3 * k + 0.3, "text": "on" if k % 7 else "and", "speaker": None} for k in range(700)]
    groups, timed = [], []
    for r, ws in talks.items():
        found = memory.group(ws, most_words, (lambda a, b, ws=ws: words_.visible(" ".join(w["text"] for w in ws[a:b])) <= max_chars) if max_chars else None)
        groups += [(r, k, ws[a]["start"], max(max(w["end"] for w in ws[a:b]), ws[a]["start"]), " ".join(w["text"] for w in ws[a:b]), b - a) for k, (a, b) in enumerate(found)]
        caps = memory.time_groups(ws, found, fps)
        timed += [(r, k, c["s"], c["e"], c["words"], [w["text"] for w in ws[c["a"] : c["b"]]]) for k, c in enumerate(caps)]
        assert all(n["s"] - c["e"] >= 2 for c, n in zip(caps, caps[1:], strict=False))
    df = frame(spark, talks)
    assert sorted(tuple(x) for x in captions.caption_groups(df, most_words, max_chars).collect()) == sorted(groups)
    assert sorted(tuple(x) for x in captions.timed(captions.grouped(df, most_words, max_chars), fps).collect()) == sorted(timed)


def test_frames_of_every_mode(spark):
    df = frame(spark, {1: [{"ord": k, "start": k * 0.4, "end": k * 0.4 + 0.3, "text": t, "speaker": None} for k, t in enumerate(["1st", "Éa", "wORD", "two."])]})
    got = {m: [(r["frame"], r["active"], r["reveal"]) for r in captions.caption_frames(df, 25.0, mode=m).orderBy("caption", "frame").collect()] for m in ("static", "karaoke", "reveal", "build")}
    assert got["static"] == [(0, None, None)] and got["karaoke"] == [(k, k, None) for k in range(4)] and got["reveal"] == [(k, k, k + 1) for k in range(4)] and got["build"] == [(k, None, k + 1) for k in range(4)]
    case = lambda c: captions.caption_frames(df, 25.0, case=c).first()["words"]
    assert case("lower") == ["1st", "éa", "word", "two."] and case("upper") == ["1ST", "ÉA", "WORD", "TWO."] and case("title") == ["1st", "Éa", "WORD", "Two."] and case("sentence") == ["1st", "éa", "word", "two."]
    rows = captions.caption_frames(df, 25.0, mode="karaoke").orderBy("frame").collect()
    assert all(a["end"] == b["start"] for a, b in zip(rows, rows[1:], strict=False)) and rows[0]["start"] == 0.0
    assert captions.caption_frames(df.limit(0)).count() == 0 and captions.caption_groups(df.limit(0)).count() == 0
