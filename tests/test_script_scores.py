"""The table of word likeness, and script takes that read it, against scoring every pair."""

from __future__ import annotations

import numpy as np

from chronoweft.functions.text import word_likeness
from chronoweft.operators import likeness, script

WORDS = ["returns", "रिटेंस", "return", "institutions", "institution", "instetutions", "hai", "है", "ye", "a", "ka", "की", "kaam", "2026", "26", "1026", "6", "infrastructure", "infrastructures", "infastracture", "commercial", "comercial", "real", "reel", "estate", "steate", "", "cat", "cats", "challenges", "चैलेंजिस", "oh", "phone", "fone"]


def test_every_alike_pair_meets(spark):
    rng = np.random.default_rng(4)
    more = ["".join("bcdfgklmnprstvaeiou"[int(j)] for j in rng.integers(0, 19, int(rng.integers(1, 14)))) for _ in range(150)]
    more += [w[:k] + w[k + 1 :] for w in more for k in (2, 5) if len(w) > 8]
    left, right = [*WORDS, *more[::2], None], [*WORDS, *more[1::2]]
    df = lambda words: spark.createDataFrame([(w, w, 1) for w in words], "word string, key string, score int")
    got = {(r["a"], r["b"]): r["score"] for r in likeness.likeness(df(left), df(right)).collect()}
    want = {(a, b): s for a in left if a for b in right if b and (s := word_likeness(a, b)) > 0.3}
    assert got == want and len(want) > 100
    a, b = [w for w in left if w is not None], right
    assert (script.Scores(a, b, got).full == script.Scores(a, b).full).all()


def test_script_cuts_with_the_table_are_those_without(spark):
    rng = np.random.default_rng(6)
    lines = ["we bring institutions into commercial real estate", "returns are never sure in 2026", "infrastructure needs patience and time", "challenges remain for every phone maker", "please call before you sell the estate"]
    words, scripts = [], []
    for rec in range(6):
        t, mine = 0.0, []
        for _ in range(3):
            for line in lines:
                said = line.split()
                if rng.random() < 0.5:
                    said = said[: int(rng.integers(1, len(said)))] + said
                for w in said:
                    w = WORDS[int(rng.integers(len(WORDS)))] if rng.random() < 0.1 else w
                    mine.append((rec, len(mine), round(t, 2), round(t + 0.3, 2), w))
                    t += 0.35
                t += float(rng.choice([0.1, 1.5]))
        words += mine
        scripts.append((rec, "\n".join(f"{line}." for line in lines) + ("\nHOST: [smiles] thank you all for coming today" if rec % 2 else "")))
    w = spark.createDataFrame(words, "rec_id long, ord long, start double, end double, text string").repartition(2)
    s = spark.createDataFrame([*scripts, (99, None)], "rec_id long, script string")
    total = 0
    for table, kernel in ((script.script_takes, lambda m, x: script.script_takes_of(m, script.script_words(x))), (script.script_keep, script.script_keep_of)):
        want = []
        for rec, text in scripts:
            mine = [{"start": a, "end": b, "text": x} for r, _, a, b, x in words if r == rec]
            want += [(rec, *c.values()) for c in kernel(mine, text)]
        got = [tuple(r) for r in table(w, s).collect()]
        assert sorted(got) == sorted(want)
        total += len(want)
    assert total > 5
