"""Runs, source divergence and decontamination against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from chronoweft.llm import decontaminate, divergence, lexical, periodic, queries
from tests.llm.test_operators import documents, hostile, nothing  # noqa: F401

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PERIODIC = [
    (20, "a b a b a b a b c", "en", "a"), (21, "x " * 5, "en", "a"), (22, "x\n" * 6, "en", "a"), (23, "p q r " * 3, "en", "a"), (24, "p q r " * 3 + "p q r s t " + "s t " * 5, "en", "a"),
    (25, "a a b a a b a a b a a b", "en", "a"), (26, "u v w " * 4 + "z " + "u v w " * 4, "de", "b"), (27, "m m m m m m n n n n n n m m m m m m", "de", "b"), (28, "é ü é ü é ü é ü", "de", "b"), (30, "1 2 3 4 " * 2000, "en", "a"),
    (31, "tail one two three four five six", "en", "a"), (32, "one two three four five six tail", "en", "a"),
]
COLUMNS = "doc_id long, text string, lang string, source string, runs long, n_words string, collapsed string, _w string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", "c", "w") for r in rows], COLUMNS)


def runs_by_definition(words, least=6, ratio=4):
    codes = {}
    w = np.array([codes.setdefault(x, len(codes)) for x in words], np.int64)
    found = set()
    for q in range(1, len(w) // ratio + 1):
        equal = np.concatenate(([0], w[:-q] == w[q:], [0])).astype(int)
        for i, j in zip(np.flatnonzero(np.diff(equal) == 1), np.flatnonzero(np.diff(equal) == -1), strict=True):
            size = int(j - i + q)
            if size >= max(least, ratio * q) and not any((w[i : i + size - r] == w[i + r : i + size]).all() for r in range(1, q)):
                found.add((int(i), size, q))
    return sorted(found)


def op11_by_definition(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_definition(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = max(((size, -s, -q) for s, size, q in runs), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (-best[1], best[0], -best[2], 1000 * best[0] // -best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("rule", [periodic.Runs(), periodic.Runs(2, 2), periodic.Runs(7, 3)])
def test_runs_of_random_words(rule):
    rng = np.random.default_rng(11)
    for _ in range(300):
        some = rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(0, 20))).tolist()
        w = some + rng.integers(0, 3, int(rng.integers(1, 6))).tolist() * int(rng.integers(1, 7)) + some[:4]
        assert periodic.runs_of(w, rule) == runs_by_definition(w, rule.least, rule.ratio)


def test_op11_against_brute_force(spark, documents, hostile, nothing):  # noqa: F811
    mine = [*PERIODIC, *[(None, "k k k k k k k", "en", "a")] * 2, (20, "other words of the same id", "en", "a"), *[(d, t * 3, "en", "a") for d, t, *_ in PERIODIC[:6] for d in range(d, 200, 7)]]
    some = [r for r in documents[0] if len(r[1] or "") < 2500][:60]
    for rows, df in ((mine, rows_of(spark, mine)), hostile, (some, rows_of(spark, some))):
        got = periodic.digest(periodic.periodic_runs(periodic.planted(df))).collect()
        assert Counter(tuple(r) for r in got) == Counter(op11_by_definition(d, t) for d, t, *_ in rows)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, *_ in mine if d is not None) > 3
    assert periodic.digest(periodic.periodic_runs(periodic.planted(nothing))).count() == 0


def test_runs_and_carried_columns(spark):
    got = periodic.periodic_runs(rows_of(spark, PERIODIC), carry=("text", "lang")).orderBy("doc_id").collect()
    for row, (_, text, lang, _) in zip(got, PERIODIC, strict=True):
        assert (row["text"], row["lang"]) == (text, lang)
        assert [tuple(r) for r in row["runs"]] == runs_by_definition(WORD.findall(text))


def test_op11_query(spark):
    assert queries.op11_periodic_runs(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


# ---- 12 -----------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def audit_by_definition(rows, least, top=50):
    counts, docs = Counter(), Counter()
    groups = {(r[2] or "", r[3] or "") for r in rows}
    for _, text, lang, source in rows:
        terms = TERM.findall(ascii_lower(text or ""))
        counts.update((lang or "", source or "", t) for t in terms)
        docs.update((lang or "", t) for t in set(terms))
    kept = {lang: [t for (own, t), n in docs.items() if own == lang and n >= least] for lang, _ in groups}
    share = lambda n, total, v: 1 + 10**9 * (n + 5) // (total + 5 * v)
    p, q = {}, {}
    for lang, source in groups:
        total = sum(counts[lang, source, t] for t in kept[lang])
        p[lang, source] = {t: share(counts[lang, source, t], total, len(kept[lang])) for t in kept[lang]}
        every = {t: sum(counts[lang, s, t] for own, s in groups if own == lang) for t in kept[lang]}
        q[lang] = {t: share(every[t], sum(every.values()), len(kept[lang])) for t in kept[lang]}
    out = Counter()
    for lang, source in groups:
        mine = p[lang, source]
        parts = {"pair": [(s, sum(abs(mine[t] - p[lang, s][t]) for t in kept[lang])) for own, s in groups if own == lang and s != source]}
        parts["term"] = [(t, mine[t] - q[lang][t]) for t in kept[lang] if counts[lang, source, t] and mine[t] > q[lang][t]]
        for part, found in parts.items():
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out.update((lang, source, part, item, value, rank) for rank, (item, value) in enumerate(found, 1) if part == "pair" or rank <= top)
    return out


NAMED = ["lang", "source", "part", "item", "value", "rank"]


@pytest.mark.parametrize("audit", [divergence.Audit(documents=1), divergence.Audit(documents=2, shard=100, tile=2, block=3, dense=2), divergence.Audit(documents=1, top=3, tile=1), divergence.Audit(documents=99)])
def test_audit_against_brute_force(spark, hostile, nothing, audit):  # noqa: F811
    rng = np.random.default_rng(12)
    words = ["a", "B", "b", "éa", "ÉA", "extraordinarily", "extraordinary", "extraordinaril", "abcdefgh", "abcdefghi", "ABCDEFGHIJKLMNOPQ", "日本", "x1y", "10"]
    some = [(k, " ".join(words[int(j)] for j in rng.integers(0, 1 + k % 14, k % 30)), ["en", "de", None, ""][k % 4], [None, "s1", "s2", "S1", "é", "s10", "t"][int(rng.integers(0, 7))]) for k in range(90)]
    for rows, df in (hostile, (some * 2, rows_of(spark, some * 2).repartition(3))):
        got = divergence.audit_sources(df, audit).select(NAMED).collect()
        assert Counter(map(tuple, got)) == audit_by_definition(rows, audit.documents, audit.top)
    assert divergence.audit_sources(nothing, audit).count() == 0


def test_pointers_are_sorted():
    rng = np.random.default_rng(1)
    terms = ["".join("abé"[int(j)] for j in rng.integers(0, 3, int(rng.integers(1, 30)))) * int(rng.integers(1, 3)) for _ in range(300)] * 2
    raw = " ".join(terms).encode()
    buf = np.frombuffer(raw, np.uint8)
    start, end, _ = lexical.word_spans(buf, np.array([0, len(buf)]), divergence.NO_TERM)
    slices = rng.integers(0, 3, len(start))
    order, new = divergence.sorted_pointers(buf, start, end, slices)
    got = [(int(slices[k]), terms[k].encode()) for k in order]
    assert got == sorted((int(s), t.encode()) for s, t in zip(slices, terms, strict=True))
    assert list(new) == [k == 0 or got[k] != got[k - 1] for k in range(len(got))]


def same_as_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    rows = got.select(names).collect()
    assert len(rows) > 0 and Counter(map(tuple, rows)) == Counter(want.fetchall())


def test_op12_equals_its_sql(spark):
    same_as_sql(spark, "op12_source_divergence", "/root/testdata/sf0.01")


# ---- 13 -----------------------------------------------------------------------------

LETTERS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def passages_by_definition(rows, items, size):
    """doc_id, n_words and the longest matches of every row."""
    out = Counter()
    tests = [(i, LETTERS.findall(ascii_lower(t or ""))) for i, t in items]
    for d, text, *_ in rows:
        w, found = LETTERS.findall(ascii_lower(text or "")), []
        for i, v in tests:
            least = min(size, len(v))
            for a in range(len(v)):
                for b in range(len(w)):
                    n = 0
                    if a and b and v[a - 1] == w[b - 1]:
                        continue
                    while a + n < len(v) and b + n < len(w) and v[a + n] == w[b + n]:
                        n += 1
                    if n and n >= least:
                        found.append((i, a, b, n))
        out[d, len(w), tuple(sorted(found, key=repr))] += 1
    return out


ITEMS = [(1, "One two THREE four five"), (2, "two,three;four"), (3, None), (4, "..."), (5, "Four"), (6, "one two three four five"), (None, "a b c d a b c d"), (6, "fourteen fifteen sixteen seventeen eighteen nineteen twenty, twenty-one"), (7, "日本語 é"), (10, "a b")]


@pytest.mark.parametrize(("size", "block"), [(3, 100), (4, 1), (2, 5), (10, 3)])
def test_passages_against_brute_force(spark, hostile, nothing, size, block):  # noqa: F811
    rows = [r for r in hostile[0] if len(r[1] or "") < 2000] + [(40, "two. Three -- four", "en", "a"), (41, "a b c d a b c d a b", "en", "a"), (42, "x four", "en", "a"), (43, "日本語 É", "ja", "b"), (44, "a b c d " * 20, "en", "b")]
    items = spark.createDataFrame([(*i, 1, "t") for i in ITEMS], "item_id long, text string, item long, doc_id string")
    found = decontaminate.find_passages(rows_of(spark, rows), items, size, ("lang", "runs"), block)
    got = Counter((r["doc_id"], r["n_words"], tuple(sorted((tuple(m) for m in r["matches"]), key=repr))) for r in found.collect())
    assert got == passages_by_definition(rows, ITEMS, size)
    assert decontaminate.find_passages(nothing, items, size, block=block).count() == 0
    clean = decontaminate.decontaminate(rows_of(spark, rows), items.filter("item_id = 5"), size)
    assert sorted(r["doc_id"] for r in clean.filter("doc_id is not null").collect()) == sorted(r[0] for r in rows if r[0] is not None and "four" not in LETTERS.findall(ascii_lower(r[1] or "")))
    none = decontaminate.digest(decontaminate.find_passages(rows_of(spark, rows), items.limit(0), size)).collect()
    assert len(none) == len(rows) and all((r["n_hit"], r["n_items"], r["contaminated"], r["items_sha256"]) == (0, 0, False, hashlib.sha256(b"").hexdigest()) for r in none)


def test_suffix_array_has_the_order_of_words():
    rng = np.random.default_rng(5)
    for depth in (1, 2, 3, 7, 10):
        n = [0, 1, 40, 3, 200, 17]
        h = rng.integers(0, 3, sum(n)).astype(np.uint64)
        until = np.repeat(np.cumsum(n), n)
        left = until - np.arange(len(h))
        order = decontaminate.suffix_array(h, left, depth)
        key = [tuple(h[k : min(k + depth, until[k])].tolist()) for k in range(len(h))]
        assert sorted(order.tolist()) == list(range(len(h)))
        assert [key[k] for k in order] == sorted(key)


def test_op13_equals_its_sql(spark):
    same_as_sql(spark, "op13_suffix_decontamination", "/root/testdata/sf0.01")
