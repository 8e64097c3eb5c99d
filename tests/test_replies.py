"""Model replies: the cuts as rows against the cuts of the row-by-row reading."""

from __future__ import annotations

import json

import numpy as np

from chronoweft.operators import replies

NAMES = ["start", "end", "text", "reason", "label", "confidence", "from_idx", "to_idx", "needs_review"]


def random_reply(rng, words):
    pick = lambda of: of[int(rng.integers(len(of)))]
    items = []
    for _ in range(int(rng.integers(0, 6))):
        a = int(rng.integers(-1, len(words) + 2))
        b = a + int(rng.integers(-1, 4))
        item = {"from": pick([a, a, a, float(a), f"[{a}]", f"w{a}", [a], a + 0.5, None, True]), "to": pick([b, b, b, str(b)])}
        if rng.random() < 0.7:
            at = max(0, a + int(rng.integers(-7, 8)))
            item["words"] = " ".join(w["text"] for w in words[at : at + int(rng.integers(1, 4))]) + pick(["", "", "!", " —", " x"])
        if rng.random() < 0.2:
            item["words"] = pick(["--", " ", "you know", "like", 7])
        item |= pick([{}, {"category": pick(["Filler words", "retake", "", "x"])}, {"type": "tangent", "label": "um"}])
        item |= pick([{}, {"confidence": pick([0.4, 80, "75", "0.2 or so", "high", None, 101, True])}])
        item |= pick([{}, {"reason": "why " * int(rng.integers(0, 30))}])
        items.append(item if rng.random() < 0.9 else pick([3, None, [1, 2], {"index": a}, {"span": [a, b]}]))
    body = pick([{"cuts": items}, {"cuts": items}, {"cuts": items, "note": "x"}, {"edits": items}, items, {"a": {"b": {"items": items}}}, {"Cuts": items, "ranges": []}])
    text = json.dumps(body, ensure_ascii=False)
    return pick([text, text, text, f"Here {{you}} go: ```{text}```", text.replace("]", ",]"), text[: int(len(text) * 0.8)], text + " }", "no", "", None, text.replace('"', "“", 1)])


def test_cuts_as_rows_against_the_kernel(spark):
    rng = np.random.default_rng(2)
    said = ["um", "you", "know", "what", "like", "ten", "the", "shop", "--", "…", "café", "नमस्ते", "So,", "so", "know"]
    words, texts, want = [], [], []
    for rec in range(120):
        mine = [{"ord": k, "start": k * 0.4, "end": k * 0.4 + float(rng.choice([0.3, 0.0, 30.0], p=[0.9, 0.05, 0.05])), "text": said[int(rng.integers(len(said)))]} for k in range(int(rng.integers(1, 60)))]
        for k, w in enumerate(mine):
            w["end"] = max(w["end"], w["start"]) if k + 1 < len(mine) else w["end"]
        words += [(rec, w["ord"], w["start"], w["end"], w["text"], "x") for w in mine]
        for text in (random_reply(rng, mine), random_reply(rng, mine)):
            texts.append((rec, text, 1, "w"))
            want += [(rec, rec, *[c[n] for n in NAMES])[1:] for c in replies.cleanup(text, mine)]
    w = spark.createDataFrame(words, "rec_id long, ord long, start double, end double, text string, label string").repartition(3)
    r = spark.createDataFrame(list(dict.fromkeys(texts)), "rec_id long, reply string, k long, words string")
    distinct = []
    for rec, text, *_ in dict.fromkeys(texts):
        mine = [{"ord": o, "start": s, "end": e, "text": t} for i, o, s, e, t, _ in words if i == rec]
        distinct += [(rec, *[c[n] for n in NAMES]) for c in replies.cleanup(text, mine)]
    got = [(x["rec_id"], *[x[n] for n in NAMES]) for x in replies.cleanup_cuts(w, r).collect()]
    assert len(got) > 60 and sorted(got, key=repr) == sorted(distinct, key=repr)
    some = replies.cleanup_cuts(w, r, 0.6, ("filler", "cut")).collect()
    assert sorted((x["rec_id"], *[x[n] for n in NAMES]) for x in some) == sorted(x for x in distinct if x[6] >= 0.6 and x[5] in ("filler", "cut"))
    assert replies.cleanup_cuts(w.limit(0), r).count() == 0 and replies.cleanup_cuts(w, r.limit(0)).count() == 0


def test_only_what_needs_it_is_mended(spark):
    good = '{"cuts":[{"from":1,"to":2,"words":"a b","confidence":0.5},{"from":3,"to":3,"category":"um"}]}'
    rows = [(k, t) for k, t in enumerate([good, '{"cuts":[]}', f"so: {good}", good[:-1], '{"cuts":[{"from":"1","to":2}]}', '{"cuts":[{"from":1,"to":2}],"edits":[]}', None])]
    from pyspark.sql import functions as F

    plain = F.coalesce(F.schema_of_variant(F.try_parse_json("reply")).rlike(replies.PLAIN), F.lit(False))
    assert [r[0] for r in spark.createDataFrame(rows, "rec_id long, reply string").orderBy("rec_id").select(plain).collect()] == [True, True, False, False, False, False, False]
