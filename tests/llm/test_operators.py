"""The training-data operators against brute force, on small hostile tables and on the smallest data."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoweft.llm import ann, mixing, near_dup, packing, quality, queries, sharding, substring_dup, tokens, training_order, urlfilter, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twenty-one twenty-two"
HOSTILE = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE + " more", "en", None), (4, None, "en", "b"), (5, "", None, "b"), (6, "One TWO", "en", "b"), (7, "one two", "en", ""),
    (8, "x" * 300, "en", "a"), (9, "a b c d " * 4000, "en", "a"), (10, "日本語 " * 60 + "é" * 150, "ja", "c"), (11, "日本語 " * 60 + "é" * 150, "ja", "c"), (12, " \n\t ", "en", "c"),
    (13, "y" * 50 + BASE[:120], "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, doc_id_x long, size long, num long, node long, label string"


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls, empty and long texts, ties, repeats and columns with clashing names; two rows share an id, two have none."""
    more = [(13, "another text of the same id", "en", "b"), (None, BASE, "en", "a"), (None, "no id at all", "en", "a"), (1, BASE, "en", "a")]
    rows = [(*r, 1, 2, 3, 4, "z") for r in [*HOSTILE, *more]]
    return [r[:4] for r in rows], spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def plain(spark):
    return [tuple(r) for r in HOSTILE], spark.createDataFrame([(*r, 1, 2, 3, 4, "z") for r in HOSTILE], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()], df


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ---- 1 ------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_permutation_is_a_bijection(size):
    p = training_order.Permutation(size, 99)
    out = p.forward(np.arange(size))
    assert sorted(out) == list(range(size)) and (p.inverse(out) == np.arange(size)).all()


def test_training_order(spark, documents, hostile, nothing):
    encode = tokens.encoder(queries.TOKENIZER)
    for rows, df in (documents, hostile):
        got = training_order.training_order(df, queries.TOKENIZER, length=64, shard_bytes=1 << 16).collect()
        want = Counter((d, k, zlib.crc32(ids[a : a + 64].astype("<u4").tobytes())) for d, t, *_ in rows for ids in [np.append(encode(t or ""), np.uint32(2)).astype(np.uint32)] for k, a in enumerate(range(0, len(ids), 64)))
        assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got) == want
        assert sorted(r["slot"] for r in got) == list(range(len(got)))
    assert training_order.training_order(nothing, queries.TOKENIZER).count() == 0
    layout, manifest = training_order.materialise(documents[1], queries.TOKENIZER, length=64, shard_bytes=1 << 16)
    slots = sorted(r["slot"] for r in training_order.read_from(spark, layout, manifest, 777).collect())
    assert slots[0] == 777 and slots == list(range(777, layout.size)) and layout.width == 2
    sizes = [r["records"] for r in manifest.orderBy("shard").collect()]
    assert len(sizes) > 3 and set(sizes[:-1]) == {layout.per_shard} and sum(sizes) == layout.size


def feistel(index, size, key):
    """The permutation in plain whole numbers."""
    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 % 2**64
        x ^= x >> 27
        x = x * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    while True:
        a, b = divmod(index, 2**half)
        for k in range(1, 7):
            a, b = b, a ^ mix(b ^ mix((k * 0x9E3779B97F4A7C15 + key) % 2**64)) % 2**half
        index = a * 2**half + b
        if index < size:
            return index


def test_slot_is_the_permuted_index(documents):
    encode = tokens.encoder(queries.TOKENIZER)
    got = training_order.training_order(documents[1].repartition(3), queries.TOKENIZER, length=64, shard_bytes=1 << 16, key=5).collect()
    order = [(d, k) for d, t, *_ in sorted(documents[0], key=lambda r: r[0]) for k in range(len(encode(t or "")) // 64 + 1)]
    want = {sequence: feistel(i, len(order), 5) for i, sequence in enumerate(order)}
    assert {(r["doc_id"], r["piece"]): r["slot"] for r in got} == want and all(r["byte_offset"] % (20 + 128) == 0 for r in got)


def test_slots_do_not_depend_on_how_files_are_split(spark, documents, tmp_path):
    """Between the count and the write, partitions change; repeated rows are in several of them."""
    path = str(tmp_path / "docs")
    documents[1].unionByName(documents[1].limit(20)).repartition(2).write.option("parquet.block.size", 1 << 16).parquet(path)
    docs = spark.read.parquet(path)
    want = Counter((r["doc_id"], r["piece"], r["slot"]) for r in training_order.training_order(docs, queries.TOKENIZER, length=64, key=5).collect())
    counted = training_order._indexed
    keep = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def other(*args):
        out = counted(*args)
        for c in keep:
            spark.conf.set(c, "40k")
        return out

    try:
        training_order._indexed = other
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1g")
        got = Counter((r["doc_id"], r["piece"], r["slot"]) for r in training_order.training_order(docs, queries.TOKENIZER, length=64, key=5).collect())
        assert docs.rdd.getNumPartitions() > 2
    finally:
        training_order._indexed = counted
        for c, v in keep.items():
            spark.conf.set(c, v)
    assert got == want and sorted(s for _, _, s in got) == list(range(len(got)))


def test_ranks_give_the_ids_of_the_vocabulary_file(documents):
    import public_tokenizers

    a, b = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json")), tokens.encoder(queries.TOKENIZER)
    assert all((a(t) == b(t)).all() for _, t, *_ in [*documents[0], (0, "x<|endoftext|>y  \né\U0001f600", "", "")] if t)


# ---- 2 ------------------------------------------------------------------------------


def test_archives(spark):
    long = "<p>" + "z" * 1200
    rows = [(1, "http://b.example.com/x?q=1#f", long), (2, "http://a.example.com/", long), (3, None, None), (4, "not a url", ""), (5, "http://www.b.example.com/x?q=1", long), (6, "http://c.example.org/é", "short"), (7, "http://c.example.org/é", "short"), (None, "http://d.example.org/", "é" * 700), (4, "not a url", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, key string")
    got = warc.round_trip(df, file_bytes=500, block_lines=2).collect()
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        to = 5 if b == long.encode() and i != 5 else None
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to else "response", to)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert warc.round_trip(df.limit(0)).count() == 0
    assert df.select(warc.url_key(F.col("url"))).first()[0] == "com,example,b)/x?q=1"


# ---- 3 ------------------------------------------------------------------------------


def brute_search(rows, queries_, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i, v in queries_:
        s = (x * np.array(v, np.float32).astype(float)).sum(axis=1)
        s[ids == i] = -np.inf
        order = [j for j in np.lexsort((ids, -s)) if s[j] > -np.inf][:k]
        out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_search_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute_search(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = defaultdict(list)
    for r in sorted(ann.search(df, df.filter("vec_id % 20 = 0"), 20).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_search_recall_with_unequal_norms(spark):
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(4000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    longer = np.ones((4000, 1))
    longer[3] = 10
    for by in (longer, np.exp(rng.normal(size=(4000, 1)) / 2)):
        rows = [(i, v) for i, v in enumerate((unit * by).tolist())]
        want = brute_search(rows, [r for r in rows if r[0] % 20 == 0], 20)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        got = defaultdict(set)
        for r in ann.search(df, df.filter("vec_id % 20 = 0"), 20).collect():
            got[r["query_id"]].add(r["vec_id"])
        assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95


def test_share_looked_at_falls_as_vectors_grow():
    """Random directions: recall at 20, and the share of all vectors that a query looks at."""
    rng = np.random.default_rng(7)
    unit = rng.normal(size=(24000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    shares = []
    for n in (1500, 6000, 24000):
        x, asked = unit[:n], unit[:40]
        tables = ann.Tables(64, (n,), (1.0 + 1e-12,))
        row, code = (np.concatenate(k) for k in zip(*((r + lo, c) for lo in range(0, n, 2000) for r, c in [tables.bucket(x[lo : lo + 2000], np.zeros(len(x[lo : lo + 2000]), int))]), strict=True))
        found = [np.unique(row[np.isin(code, c)]) for c in tables.probe(asked)]
        near = asked @ x.T
        near[np.arange(40), np.arange(40)] = -2
        top = np.argsort(-near, axis=1)[:, :20]
        assert np.mean([np.isin(t, f).mean() for t, f in zip(top, found, strict=True)]) >= 0.92
        shares.append(np.mean([len(f) / n for f in found]))
    assert shares[1] < 0.8 * shares[0] and shares[2] < 0.75 * shares[1] and shares[2] < 0.4


def test_search_without_any_bucket(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate((np.eye(1, 16) + rng.normal(size=(400, 16)) / 1000).tolist())]
    far = [(1000, [-1.0] + [0.0] * 15)]
    df, asked = (spark.createDataFrame(x, "vec_id long, embedding array<float>") for x in (rows, far))
    got = sorted(ann.search(df, asked, 5).collect(), key=lambda r: r["rank"])
    assert [r["vec_id"] for r in got] == [i for i, _ in brute_search(rows, far, 5)[1000]]


def test_search_with_repeated_ids(spark):
    v, w = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    turned = [[1.0 + j / 8, 1.0, j / 8, 0.0] for j in range(9)]
    rows = [(0, v)] * 9 + [(i, v) for i in (5, 6, 7, 8, 9)] + [(1, x) for x in turned] + [(2, w)] * 2 + [(3, [0.5, 0.0, 0.0, 0.0]), (3, [0.0, 0.0, 1.0, 0.0])] + [(4, turned[8])]
    asked = [(0, v), (1, turned[8]), (3, w), (77, v)]
    df, queries_ = (spark.createDataFrame(x, "vec_id long, embedding array<float>") for x in (rows, asked))
    got = defaultdict(list)
    for r in sorted(ann.search(df, queries_, 4).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == brute_search(rows, asked, 4)
    few = df.filter("vec_id > 1")
    assert len(ann.search(few, queries_.filter("vec_id = 77"), 20).collect()) == few.count()


def test_search_of_every_length(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=(4, 4, 7, 16)[i % 4]).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = defaultdict(list)
    for r in sorted(ann.search(df, df.filter("vec_id % 5 = 0"), 3).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = {}
    for n in (4, 7, 16):
        some = [r for r in rows if len(r[1]) == n]
        want |= brute_search(some, [r for r in some if r[0] % 5 == 0], 3)
    assert got == want and len(got) == 40


def test_search_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.integers(1, 4)]) for i in range(12)] + [(i, [1.0] * 8) for i in range(20, 60)]
    bad = [(100, None), (101, [0.0] * 8), (102, [float("nan")] + [1.0] * 7), (103, [None] + [1.0] * 7), (104, []), (105, [1.0] * 5), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<float>, node long")
    got = defaultdict(list)
    for r in sorted(ann.search(df, df.filter("vec_id % 20 = 0"), 5).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["vec_id"])
    want = brute_search(rows, [r for r in rows if r[0] % 20 == 0], 5)
    assert got[20] == [i for i, _ in want[20]] and set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert len(ann.search(df.filter("vec_id < 3"), df.filter("vec_id = 0"), 5).collect()) == 2
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


# ---- 4 ------------------------------------------------------------------------------


def best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in range(len(gaps)) if gaps[g] >= n]
        if fit:
            gaps[min(fit, key=lambda g: gaps[g])] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_plan_opens_as_many_sequences_as_best_fit(spark):
    rng = np.random.default_rng(4)
    for capacity, width in ((5, 512), (16, 4), (64, 16)):
        lengths = rng.integers(1, capacity + 1, 200).tolist()
        counts = spark.createDataFrame(sorted(Counter(lengths).items()), "length int, n long")
        held, placed = defaultdict(dict), defaultdict(set)
        for r in packing.plan(counts, capacity, width).collect():
            for k in range(r["n"]):
                placed[r["length"]].add(r["rank"] + k)
                held[r["sequence"] + k // r["each"]][r["offset"] + k % r["each"] * r["length"]] = r["length"]
        assert placed == {n: set(range(c)) for n, c in Counter(lengths).items()}
        for parts in held.values():
            ends = [o + n for o, n in sorted(parts.items())]
            assert sorted(parts) == [0, *ends[:-1]] and ends[-1] <= capacity
        assert len(held) == best_fit(lengths, capacity)


def test_rounds_of_the_query_are_spread_over_ranges(spark, documents):
    """At the query's capacity documents of several ranges are matched in tasks of their own."""
    cut = packing.pieces(documents[1], queries.TOKENIZER, 1024, 2)
    lengths = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("sequence", "long"), ("each", "long"), ("offset", "int"))]
    docs = lengths.select(F.lit(packing.DOCUMENT).alias("kind"), F.col("length").cast("int").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long"), *none)
    gaps = spark.range(20, 1024, 7).select(F.lit(packing.GAP).alias("kind"), F.col("id").cast("int").alias("size"), F.col("id").alias("first"), F.lit(1).cast("long").alias("n"), *none)
    state = docs.unionByName(gaps).repartition(2)
    band = F.expr(f"greatest(size - 1, 0) div {packing.RANGE}")
    step = state.groupBy(band).applyInArrow(packing._superstep(1024, False), packing._STATE)
    placed = step.filter(F.col("kind") == packing.PLACED).withColumn("band", band)
    assert placed.select("band").distinct().count() > 4
    # a document went to a gap of its own range
    assert placed.filter(F.expr(f"(1024 - offset - 1) div {packing.RANGE} <> band")).count() == 0


def test_packing(documents, hostile, nothing):
    encode = tokens.encoder(queries.TOKENIZER)
    for rows, df in (documents, hostile):
        got = packing.pack_documents(df, queries.TOKENIZER, 128).collect()
        want = Counter()
        for d, t, *_ in rows:
            ids = np.append(encode(t or ""), np.uint32(2)).astype("<u4")
            first = len(ids) % 128 or 128
            for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 128)], range(first, len(ids) + 1, 128), strict=True)):
                want[(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        held = defaultdict(list)
        for r in got:
            held[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in held.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 128
        assert len(held) == best_fit([r["length"] for r in got], 128)
    assert packing.pack_documents(nothing, queries.TOKENIZER).count() == 0


# ---- 5 ------------------------------------------------------------------------------


def removed(texts, length):
    """Covered bytes of each text, in order."""
    seen, out = set(), []
    for b in texts:
        cover = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                cover[s] += 1
                cover[s + length] -= 1
            seen.add(w)
        out.append(np.cumsum(cover)[:-1] > 0)
    return out


def test_repeats(documents, plain, nothing):
    for rows, df in (documents, plain):
        rows = sorted(rows)
        got = by_id(substring_dup.remove_repeats(df, with_text=True))
        texts = [(t or "").encode() for _, t, *_ in rows]
        for (d, *_), b, c in zip(rows, texts, removed(texts, 100), strict=True):
            left = bytes(np.frombuffer(b, np.uint8)[~c])
            assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"]) == (len(b), c.sum(), (np.diff(c.astype(int), prepend=0) == 1).sum())
            assert got[d]["kept_sha256"] == hashlib.sha256(left).hexdigest() and got[d]["left"] == left.decode("utf-8", "ignore")
    assert substring_dup.remove_repeats(nothing).count() == 0


def test_repeats_with_missing_and_shared_ids(hostile):
    rows, df = hostile
    got = substring_dup.remove_repeats(df).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want = Counter((r[0], int(c.sum())) for r, c in zip(order, removed([(r[1] or "").encode() for r in order], 100), strict=True))
    assert Counter((r["doc_id"], r["n_removed"]) for r in got) == want


def test_places_hold_any_offset(monkeypatch, hostile):
    want = Counter(tuple(r) for r in substring_dup.remove_repeats(hostile[1]).collect())
    monkeypatch.setattr(substring_dup, "PLACE_BITS", 4)
    assert Counter(tuple(r) for r in substring_dup.remove_repeats(hostile[1]).collect()) == want
    run = substring_dup._extract(substring_dup.Cut(bits=8), 1)
    part = pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int64()), pa.array(["x" * 255, "y" * 256])], names=["num", "text"])
    assert len(list(run(iter([part[:1]])))) == 1
    with pytest.raises(ValueError, match="bytes or more"):
        list(run(iter([part])))


def test_column_order_is_that_of_sorted_suffixes():
    rng = np.random.default_rng(5)
    m = rng.integers(0, 3, (40, 12)).astype(np.int16)
    m[rng.random((40, 12)) < 0.05] = -1
    for c, order, shared in substring_dup.column_order(m):
        suffixes = [tuple(m[r, c:]) for r in order]
        assert suffixes == sorted(suffixes)
        for k in range(1, len(suffixes)):
            a, b = suffixes[k - 1], suffixes[k]
            assert shared[k] == next((j for j in range(len(a)) if a[j] != b[j] or a[j] < 0), len(a))


# ---- 6 ------------------------------------------------------------------------------


def test_shards(documents, hostile, nothing):
    for rows, df in (documents, hostile):
        got = sharding.assign_shards(df).collect()
        want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(nothing).count() == 0


def test_shards_are_even_and_follow_weights(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sizes = [r["count"] for r in sharding.assign_shards(df).groupBy("shard").count().collect()]
    assert len(sizes) == 40 and min(sizes) > 800 and max(sizes) < 1200
    # shard 3 weighs three times as much: rows move only into its region, and there only into its rack and itself
    key = F.col("doc_id")
    both = df.select(sharding.place(key, sharding.topology(40)).alias("a"), sharding.place(key, sharding.topology(40, weights={3: 3.0})).alias("b"))
    moved = Counter({(r["a"], r["b"]): r["count"] for r in both.groupBy("a", "b").count().collect()})
    assert {b // 10 for a, b in moved if a != b} == {0}
    assert all(b // 5 == 0 or a // 10 > 0 for a, b in moved if a != b) and all(b == 3 or a // 5 > 0 for a, b in moved if a != b)
    assert 2700 < sum(n for (_, b), n in moved.items() if b == 3) < 3000


# ---- 7 ------------------------------------------------------------------------------


def components(rows, k, percent):
    low = str.maketrans({chr(65 + j): chr(97 + j) for j in range(26)})
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return sets, [find(x) for x in range(len(rows))]


def test_near_duplicates(documents, hostile, nothing):
    for rows, df in (documents, hostile):
        sets, root = components(rows, 4, 80)
        first = {}
        for r, c in zip(rows, root, strict=True):
            if r[0] is not None:
                first[c] = min(first.get(c, r[0]), r[0])
        want = Counter((r[0], len(s), first.get(c) if s else r[0], (first.get(c) if s else r[0]) == r[0]) for r, s, c in zip(rows, sets, root, strict=True))
        got = near_dup.near_duplicates(df, 4, 80, carry=("text",)).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == want
        assert sum(r["one"] for r in got) == len({c for c, s in zip(root, sets, strict=True) if s}) + sum(not s for s in sets)
    assert near_dup.near_duplicates(nothing).count() == 0


def test_large_candidate_components(spark, monkeypatch):
    """More blocks than one: chains and groups across blocks are found all the same."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    words = [f"w{j}" for j in range(60)]
    rows = []
    for k in range(30):
        own = list(words)
        for j in range(k % 6):
            own[(7 * k + 11 * j) % 60] = f"x{k}-{j}"
        rows.append((k, " ".join(own)))
    got = by_id(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80))
    _, root = components(rows, 4, 80)
    first = {c: min(r[0] for r, x in zip(rows, root, strict=True) if x == c) for c in root}
    assert all(got[r[0]]["component_id"] == first[c] for r, c in zip(rows, root, strict=True))


# ---- 8 ------------------------------------------------------------------------------


def targets(sizes):
    """Targets by the rule, one source after the other."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), list(order), {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * each > 2 * sizes[s]]
        if not full:
            return out | {s: weight[s] * each for s in open_}
        for s in full:
            out[s] = 2 * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def sums(rows):
    size = Counter()
    for _, t, *_, s in rows:
        size[s] += len(WORD.findall(t or ""))
    return size


def test_mixing(documents, hostile, nothing):
    for rows, df in (documents, hostile):
        goal, size, source = targets(sums(rows)), sums(rows), {d: s for d, _, _, s in rows}
        got = mixing.mix_sources(df).collect()
        assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, len(WORD.findall(t or ""))) for d, t, *_ in rows)
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
        assert sum(goal.values()) == pytest.approx(1.5 * sum(size.values())) and all(goal[s] <= 2 * size[s] + 1e-9 for s in size)
        again = mixing.mix_sources(df.repartition(3)).collect()
        assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in again)
        if rows is documents[0]:
            per = Counter()
            for r in got:
                per[source[r["doc_id"]]] += r["taken"]
                assert r["target"] == pytest.approx(goal[source[r["doc_id"]]]) and r["source_size"] == size[source[r["doc_id"]]]
            assert all(abs(per[s] - goal[s]) <= max(30, 0.05 * goal[s]) for s in size)
    assert mixing.mix_sources(nothing).count() == 0


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "w " * int(rng.integers(0, 4) ** 4), "en", f"host{i % 150}" if i % 150 else None) for i in range(600)]
    want, got = targets(sums(rows)), defaultdict(set)
    for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect():
        got[rows[r["doc_id"]][3]].add(r["target"])
    assert {s: pytest.approx(min(t)) for s, t in got.items() if len(t) == 1} == want
    empty = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("text", F.lit(""))
    assert {(r["target"], r["taken"]) for r in mixing.mix_sources(empty).collect()} == {(0.0, 0)}


def test_every_source_lands_near_its_target(spark):
    """Twenty sources of one to twenty blocks, with repeated rows; the rates are fractional."""
    rng = np.random.default_rng(12)
    rows = [(i, "w " * int(rng.lognormal(3, 1)), f"s{s:02d}") for s in range(20) for i in range(50 * (s + 1))]
    rows += [(7, "w " * 9, "s19")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    per, goal = Counter(), {}
    got = mixing.mix_sources(df.select("doc_id", "text", "source"), weights=(3, 1, 2, 7), block_rows=50, carry=("source",)).collect()
    for r in got:
        per[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    assert len(got) == len(rows) and all(abs(per[s] - goal[s]) <= np.median([r["size"] for r in got if r["source"] == s]) for s in goal)
    again = mixing.mix_sources(df.repartition(7), weights=(3, 1, 2, 7), block_rows=50, carry=("source",)).collect()
    assert Counter((r["doc_id"], r["source"], r["taken"]) for r in got) == Counter((r["doc_id"], r["source"], r["taken"]) for r in again)


def test_flight_keeps_the_sums():
    rng = np.random.default_rng(8)
    size = rng.integers(1, 500, 400)
    none = np.zeros(400, bool)
    out = mixing.fly(np.full(400, 0.3), size, np.random.default_rng(1), none, False)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(120) and (out * size).sum() == pytest.approx(0.3 * size.sum())


# ---- 9 ------------------------------------------------------------------------------


def test_quality(documents, hostile, nothing):
    for rows, df in (documents, hostile):
        want = Counter()
        for d, t, *_ in rows:
            t = t or ""
            w = WORD.findall(t)
            seen, dup = set(), 0
            for line in t.split("\n"):
                if WORD.search(line):
                    dup += line in seen
                    seen.add(line)
            runs = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
            hit = {j for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
            want[(d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w))] += 1
        got = quality.clean_lines(df).collect()
        assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
        assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality.clean_lines(nothing).count() == 0


def verdict(text):
    """Kept or not and the words left, by the rules as README and docstrings state them, on characters."""
    left, seen, all_ = 0, set(), len(WORD.findall(text))
    stock = "all rights reserved|copyright (?:\\(c\\)|©|[0-9])|licensed under|under the [a-z0-9 ]{2,40}licen[cs]e|(?:accept|uses?) cookies|cookie policy|privacy policy|terms of (?:use|service)|enable javascript|subscribe to our|sign up for|click here|read more|skip to (?:main )?content|lorem ipsum"
    for line in text.split("\n"):
        w = WORD.findall(line)
        if not w:
            continue
        again = line in seen
        seen.add(line)
        marked = [x for x in w if re.search(r"[#*$%&|<>]|[!?]{2,}", x)]
        bars = [x for x in w if re.fullmatch(r"[|/>*\-»·›•]+", x)]
        odd = re.search(r"[#*$%&|<>]|[!?]{2,}", line) is not None
        bad = again or (odd and ((len(w) >= 3 and 4 * len(bars) >= len(w)) or len(marked) > 0.3 * len(w)))
        if len(w) >= 6:
            cased = [c for c in line if c.isascii() and c.isalpha()]
            loud = bool(cased) and all(c.isupper() for c in cased)
            upper = [x for x in w if any(c.isascii() and c.isalpha() for c in x) and all(c.isupper() for c in x if c.isascii() and c.isalpha())]
            bad = bad or sum(a == b for a, b in zip(w, w[1:], strict=False)) >= 0.5 * len(w) or (loud and len(upper) >= 0.8 * len(w))
        elif len(w) < 3:
            bad = bad or not w[-1].endswith((".", "!", "?", ":", ";", '"', "'", ")", "…", "»", "”", "。"))
        bad = bad or (len(w) <= 30 and re.search(stock, line, re.IGNORECASE | re.ASCII) is not None)
        left += 0 if bad else len(w)
    return left, left >= 0.5 * all_


def test_line_verdicts_against_brute_force(documents, hostile):
    for rows, df in (documents, hostile):
        got = Counter((r["doc_id"], r["words_left"], r["kept"]) for r in quality.clean_lines(df).filter("not base_failed").collect())
        want = Counter((d, *verdict(t or "")) for d, t, *_ in rows)
        assert got and not got - want


def test_line_rules():
    rules = quality.LineRules()
    assert rules.fault(b"Home | News | Sports | About", False) == "navigation"
    assert rules.fault(b"word$$$ other### more***", False) == "punctuation"
    assert rules.fault(b"Licensed under CC BY-NC 4.0.", False) == "boilerplate"
    assert rules.fault(b"The same line.", True) == "boilerplate"
    assert rules.fault(b"the the the the the the the", False) == "boilerplate"
    assert rules.fault("Une phrase ordinaire, avec des mots accentués et un point.".encode(), False) == ""


def test_quality_agrees_with_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    both = quality.clean_lines(docs).join(labels, "doc_id").filter("not base_failed").collect()
    assert all(r["kept"] == (r["quality"] == 1) for r in both)


# ---- 10 -----------------------------------------------------------------------------


def test_lists_at_fetch_time(spark):
    events = [("spam", "block", "bad.example.com", 10, True), ("spam", "block", "bad.example.com", 20, False), ("spam", "block", "bad.example.com", 20, True), ("spam", "block", "bad.example.com", 30, False), ("all", "block", "example.com", 0, True), ("ok", "allow", "bad.example.com/en", 15, True), (None, "block", "x", 1, True)]
    ev = spark.createDataFrame(events, "list string, verdict string, pattern string, at long, active boolean")
    valid = urlfilter.intervals(ev)
    assert {(r["pattern"], r["valid_from"], r["valid_to"]) for r in valid.collect()} == {("bad.example.com", 10, 30), ("example.com", 0, None), ("bad.example.com/en", 15, None)}
    caps = [(1, "http://BAD.example.com/de", 12), (2, "http://bad.example.com/en/1", 12), (3, "http://bad.example.com/en/1", 15), (4, "http://bad.example.com./x", 30), (5, None, 12), (6, "http://example.com", None), (7, "http://other.org/", 1), (1, "http://BAD.example.com/de", 12)]
    got = urlfilter.judge(spark.createDataFrame([(*c, "x") for c in caps], "capture_id long, url string, fetched_at long, pattern string"), valid).collect()
    assert Counter((r["capture_id"], r["blocked"], r["pattern"]) for r in got) == Counter({(1, True, "bad.example.com"): 2, (2, True, "bad.example.com"): 1, (3, False, "bad.example.com/en"): 1, (4, True, "example.com"): 1, (5, False, None): 1, (6, False, None): 1, (7, False, None): 1})
    assert urlfilter.judge(spark.createDataFrame([], "capture_id long, url string, fetched_at long"), valid).count() == 0


def test_lists_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pick = lambda of: of[int(rng.integers(len(of)))]
    patterns = ["a.example.com", "example.com", "b.org", "a.example.com/x", "b.org/y"]
    events = [(pick(["l1", "l2", "l3"]), pick(["block", "allow"]), pick(patterns), int(rng.integers(0, 40)), bool(rng.integers(2))) for _ in range(150)]
    urls = ["http://a.example.com/x/1", "http://a.example.com/z", "https://example.com", "http://b.org/y", "http://c.b.org/y?q=1", "ftp://other.net/"]
    captures = [(k, pick(urls), int(rng.integers(0, 45))) for k in range(300)]

    def judged(url, at):
        host, _, path = url.split("://")[1].partition("/")
        labels = host.split(".")
        mine = {host, *(".".join(labels[k:]) for k in range(len(labels) - 1)), *([f"{host}/{path.split('?')[0].split('/')[0]}"] if path.split("?")[0].split("/")[0] else [])}
        best = None
        for name, verdict, pattern in {e[:3] for e in events}:
            before = [(e[3], e[4]) for e in events if e[:3] == (name, verdict, pattern) and e[3] <= at]
            if pattern in mine and before and max(before)[1]:
                best = min(filter(None, (best, (-len(pattern), verdict != "allow", name, pattern))))
        return (best[1], best[2], best[3]) if best else (False, None, None)

    valid = urlfilter.intervals(spark.createDataFrame(events, "list string, verdict string, pattern string, at long, active boolean"))
    got = urlfilter.judge(spark.createDataFrame([(*c, "own", "own", 1) for c in captures], "capture_id long, url string, fetched_at long, list string, pattern string, valid_from long"), valid).collect()
    assert {r["capture_id"]: (r["blocked"], r["list"], r["pattern"]) for r in got} == {k: judged(u, t) for k, u, t in captures}
