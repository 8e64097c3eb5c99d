"""The pipeline's stages against brute force on a small table, and on hostile and empty ones."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as P
from tests.llm.test_operators import HOSTILE, components, removed

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS)


def test_stages_keep_the_columns(spark):
    docs = table(spark, [*HOSTILE, (None, HOSTILE[0][1], "en", "a"), (13, "of another id", None, None)])
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert all(r["n_chars"] == len(r["text"] or "") for r in out.collect()), name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    assert P.STAGES[-1][1](spark, docs, "").count() > 0


def test_near_duplicate_stage(spark):
    rows = HOSTILE
    _, root = components(rows, 5, 80)
    empty = [not (r[1] or "").split() for r in rows]
    want = {r[0] for k, r in enumerate(rows) if empty[k] or k == min(j for j in range(len(rows)) if root[j] == root[k])}
    assert {r["doc_id"] for r in P.near_duplicates(spark, table(spark, rows), "").collect()} == want


def test_passage_stage(spark):
    rows = HOSTILE
    texts = [(r[1] or "").encode() for r in rows]
    left = {r[0]: bytes(x for x, c in zip(b, cover, strict=True) if not c).decode("utf-8", "ignore") for r, b, cover in zip(rows, texts, removed(texts, 100), strict=True)}
    got = {r["doc_id"]: r["text"] for r in P.repeated_passages(spark, table(spark, rows), "").collect()}
    assert got == {d: t for d, t in left.items() if t.split() or not t}


def test_run(spark):
    out = P.run(spark, "/root/testdata/sf0.001").collect()
    held = Counter()
    for r in out:
        held[r["sequence_id"]] += r["length"]
    assert out and max(held.values()) <= 1024
