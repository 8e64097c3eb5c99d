"""Approximate nearest neighbours by cross-polytope hashing.

Vectors become unit vectors (largest inner product turns into smallest angle by one added coordinate, as for
maximum inner product search).  Beside one long vector all others would point along that coordinate, so vectors
are parted into narrow ranges of norm, each scaled by its own largest norm, with buckets of its own; a query looks
into all ranges, and into one of few vectors as a whole.  A pseudo-rotation of three rounds of random signs and a
fast Hadamard transform precedes every hash, which is the nearest signed axis.  Each of several tables joins a few
hashes to a bucket, as many and over as many axes as leave ``LOAD`` vectors in a bucket at any number of vectors; a
query looks into its nearest buckets in every table, together at about ``REACH`` times the 0.65th power of the
vectors, so that the share of all vectors that it looks at falls as they grow.  Candidates are ranked by their exact
score.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.llm import lexical
from chronoweft.llm.store import forget, settle

#: Vectors of a bucket on average, up to a factor of two.
LOAD = 24
#: A query looks at REACH * n**0.65 of n vectors, those seen in several tables counted each time; measured on random
#: directions in 64 dimensions, which have no close neighbours.
REACH = 13.0
#: Vectors of a bucket that one cell holds, and vectors and queries of a task.
CELL, TASK_VECTORS, TASK_QUERIES = 4096, 8192, 8192
#: Ranges of norm in a factor of two; 32-bit floats have norms of fewer than 300 such factors.
RANGES = 8


@dataclass(frozen=True)
class Tables:
    """Buckets for each range of norm. counts: the vectors of each range; norms: the largest norm in each; exact: every range is one bucket."""

    dimension: int
    counts: tuple[int, ...]
    norms: tuple[float, ...]
    tables: int = 8
    reach: float = REACH
    seed: int = 11
    exact: bool = False

    @property
    def size(self) -> int:
        """The power of two that holds the dimension and one more coordinate."""
        return 1 << self.dimension.bit_length()

    def looks(self, count: int) -> float:
        """Vectors of a range that a query looks at."""
        return self.reach * count**0.65

    def axes_of(self, count: int) -> tuple[int, ...]:
        """Axes of each hash in a range of so many vectors, both signs of each; none where the range is one bucket."""
        if self.exact or self.looks(count) >= count:
            return ()
        bits, full = max(1, (count // LOAD).bit_length() - 1), self.size.bit_length()
        return tuple([self.size] * (bits // full) + ([1 << bits % full - 1] if bits % full else []))

    def probes(self, count: int) -> int:
        """Buckets of each table that a query looks into."""
        return max(1, math.ceil(self.looks(count) / count * math.prod(2 * n for n in self.axes_of(count)) / self.tables))

    @property
    def whole(self) -> np.ndarray:
        """Whether a range is one bucket, into which every query looks."""
        return np.array([not self.axes_of(n) for n in self.counts])

    @property
    def base(self) -> np.ndarray:
        """The first bucket of each range."""
        own = [self.tables * math.prod(2 * n for n in self.axes_of(count)) for count in self.counts]
        return np.concatenate(([0], np.cumsum(own, dtype=np.int64)[:-1]))

    def rotations(self, x: np.ndarray, norm: np.ndarray | None, hashes: int) -> np.ndarray:
        """Every vector, or without ``norm`` every query, rotated: table, hash, row, coordinate."""
        scaled = np.zeros((len(x), self.size))
        if norm is None:
            scaled[:, : self.dimension] = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        else:
            scaled[:, : self.dimension] = x / norm[:, None]
            scaled[:, self.dimension] = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))
        out = np.empty((self.tables, hashes, len(x), self.size))
        for t, h in itertools.product(range(self.tables), range(hashes)):
            draw = np.random.Generator(np.random.PCG64([self.seed, t, h]))
            y = scaled
            for _ in range(3):
                y = hadamard(y * draw.choice([-1.0, 1.0], self.size))
            out[t, h] = y
        return out

    def bucket(self, x: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and bucket of each vector of the ranges ``band`` in each table, once where the range is one bucket."""
        rows, codes = [], []
        for b in np.unique(band):
            own, axes = np.flatnonzero(band == b), self.axes_of(self.counts[b])
            if not axes:
                rows.append(own)
                codes.append(np.full(len(own), self.base[b]))
                continue
            y = self.rotations(x[own], np.full(len(own), self.norms[b]), len(axes))
            code = np.repeat(np.arange(self.tables, dtype=np.int64)[:, None], len(own), axis=1)
            for h, n in enumerate(axes):
                code = code * (2 * n) + np.concatenate((y[:, h, :, :n], -y[:, h, :, :n]), axis=2).argmax(axis=2)
            rows.append(np.tile(own, self.tables))
            codes.append((code + self.base[b]).ravel())
        return (np.concatenate(rows), np.concatenate(codes)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def probe(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The buckets of each query: in each range and table the nearest, and those that are a range."""
        shapes = [self.axes_of(n) for n in self.counts]
        y = self.rotations(x, None, max((len(a) for a in shapes), default=0))
        near = [self.nearest(y, axes, self.probes(n)) + base if axes else np.full((len(x), 1), base) for axes, n, base in zip(shapes, self.counts, self.base, strict=True) if n]
        yield from np.concatenate(near, axis=1)

    def nearest(self, y: np.ndarray, axes: tuple[int, ...], probes: int) -> np.ndarray:
        """The nearest buckets of each rotated query in each table: of those made of its nearest axes, the ones with the least sum of shortfalls."""
        code = np.zeros((self.tables, y.shape[2], 1), np.int64) + np.arange(self.tables)[:, None, None]
        cost = np.zeros((self.tables, y.shape[2], 1))
        for h, n in enumerate(axes):
            to = np.concatenate((y[:, h, :, :n], -y[:, h, :, :n]), axis=2)
            short = to.max(axis=2, keepdims=True) - to
            # a bucket among the nearest has each of its axes among the ``probes`` nearest
            order = np.argsort(short, axis=2, kind="stable")[..., :probes]
            code = (code[..., None] * (2 * n) + order[:, :, None]).reshape(*code.shape[:2], -1)
            cost = (cost[..., None] + np.take_along_axis(short, order, 2)[:, :, None]).reshape(*cost.shape[:2], -1)
            take = np.argsort(cost, axis=2, kind="stable")[..., :probes]
            code, cost = np.take_along_axis(code, take, 2), np.take_along_axis(cost, take, 2)
        return np.moveaxis(code, 0, 1).reshape(y.shape[2], -1)


#: A row for each query and task.
_FOUND = [("q", pa.int64()), ("query_id", pa.int64()), ("node", pa.list_(pa.int64())), ("score", pa.list_(pa.float64())), ("ids", pa.list_(pa.list_(pa.int64())))]


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row, whose length is a power of two: one pass for every four of its factors of two."""
    rows, n = x.shape
    done = 1
    while done < n:
        radix = min(16, n // done)
        sign = np.array([[-1.0 if (a & b).bit_count() % 2 else 1.0 for b in range(radix)] for a in range(radix)])
        x = (x.reshape(-1, radix) @ sign).reshape(rows, n // radix, radix).transpose(0, 2, 1).reshape(rows, n)
        done *= radix
    return x / math.sqrt(n)


def _matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimension)


def valid(rows: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    v = F.col("embedding")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & sound & F.exists(v, lambda x: x != 0))


def _parts(code: np.ndarray, known: np.ndarray, split: np.ndarray) -> np.ndarray:
    """The number of cells of each bucket, from those of the ``known`` ones in order; 1 for all others."""
    if not len(known):
        return np.ones(len(code), np.int64)
    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
    return np.where(known[at] == code, split[at], 1)


def _coded(tables: Tables):
    """Each vector with its buckets."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo in range(0, len(part), 2048):
                own = part.slice(lo, 2048)
                row, code = tables.bucket(_matrix(own.column("embedding"), tables.dimension), own.column("band").to_numpy())
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(len(own) + 1))
                codes = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(code[order]))
                yield pa.RecordBatch.from_arrays([*own.select(["node", "embedding", "ids"]).columns, codes], names=["node", "embedding", "ids", "codes"])

    return run


def _cells(known: np.ndarray, split: np.ndarray, tasks: int):
    """A row for each vector and bucket: task, cell."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo in range(0, len(part), 2048):
                own = part.slice(lo, 2048)
                codes = own.column("codes")
                code, row = codes.flatten().to_numpy(), np.repeat(np.arange(len(own)), codes.value_lengths().to_numpy())
                own = own.select(["node", "embedding", "ids"]).take(pa.array(row))
                cell = code * 65536 + own.column("node").to_numpy() % _parts(code, known, split)
                task = (lexical.mix(cell) % lexical.U(tasks)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(cell), *own.columns], names=["task", "cell", *own.schema.names])

    return run


def _probes(tables: Tables, known: np.ndarray, split: np.ndarray, tasks: int):
    """A row for each query and task in which it looks into cells."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo in range(0, len(part), 256):
                own = part.slice(lo, 256)
                row, task, cells = [], [], []
                for r, code in enumerate(tables.probe(_matrix(own.column("embedding"), tables.dimension))):
                    parts_of = _parts(code, known, split)
                    cell = np.repeat(code * 65536 - np.cumsum(parts_of) + parts_of, parts_of) + np.arange(parts_of.sum())
                    to = (lexical.mix(cell) % lexical.U(tasks)).astype(np.int32)
                    by = np.argsort(to, kind="stable")
                    heads = np.flatnonzero(np.diff(to[by], prepend=-1))
                    for a, b in zip(heads, np.append(heads, len(by))[1:], strict=True):
                        row.append(r)
                        task.append(to[by[a]])
                        cells.append(cell[by[a:b]])
                own = own.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(task, pa.int32()), pa.array(cells, pa.list_(pa.int64())), *own.columns], names=["task", "cells", *own.schema.names])

    return run


def _stands(ids: list[list[int]]) -> np.ndarray:
    """For each class its least id, and the least of its others, which is the same where it has one id only."""
    return np.array([(k[0], next((i for i in k if i != k[0]), k[0])) for k in ids], np.int64).reshape(-1, 2).T


def _score(dimension: int, keep: int):
    """Of a task's vectors, the ``keep`` nearest of each of its queries that not only the query's own id has, with exact scores."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({n: pa.array([], k) for n, k in _FOUND})
        if not len(vectors) or not len(queries):
            return empty
        x, y = _matrix(vectors["embedding"], dimension), _matrix(queries["embedding"], dimension)
        node, cell = vectors["node"].to_numpy(), vectors["cell"].to_numpy()
        first, other = _stands(vectors["ids"].to_pylist())
        self_ = queries["query_id"].to_numpy()
        order = np.argsort(cell, kind="stable")
        heads = np.flatnonzero(np.diff(cell[order], prepend=-1))
        members = {int(cell[order[a]]): order[a:b] for a, b in zip(heads, [*heads[1:], len(order)], strict=True)}
        askers = defaultdict(list)
        for r, cells in enumerate(queries["cells"].to_pylist()):
            for c in cells:
                if c in members:
                    askers[c].append(r)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for c, who in askers.items():
            of, who = members[c], np.array(who)
            for lo in range(0, len(who), 1024):
                some = who[lo : lo + 1024]
                s = y[some] @ x[of].T
                own = np.flatnonzero((first[of] == other[of]) & np.isin(first[of], self_[some]))
                s[:, own] = np.where(self_[some][:, None] == first[of[own]], -np.inf, s[:, own])
                if len(of) > keep:
                    # products differ in their last bits from the exact scores below
                    least = -np.partition(-s, keep - 1, axis=1)[:, keep - 1 : keep]
                    a, b = np.nonzero(s >= least - 1e-9 * np.maximum(1.0, np.abs(least)))
                else:
                    a, b = (k.ravel() for k in np.indices(s.shape))
                sound = s[a, b] > -np.inf
                a, b = a[sound], b[sound]
                found.append((some[a], of[b], s[a, b]))
        if not found:
            return empty
        q, v, near = (np.concatenate(k) for k in zip(*found, strict=True))
        _, one = np.unique(q * np.int64(1 << 32) + np.unique(node, return_inverse=True)[1][v], return_index=True)
        one = one[np.lexsort((-near[one], q[one]))]
        q, v, near = q[one], v[one], near[one]
        # what can be among the nearest by the products, is scored exactly
        head = np.flatnonzero(np.diff(q, prepend=-1))
        count = np.diff(np.append(head, len(q)))
        least = np.repeat(near[head + np.minimum(count, keep) - 1], count)
        some = near >= least - 1e-9 * np.maximum(1.0, np.abs(least))
        q, v = q[some], v[some]
        score = (y[q] * x[v]).sum(axis=1)
        order = np.lexsort((np.where(first[v] == self_[q], other[v], first[v]), -score, q))
        q, v, score = q[order], v[order], score[order]
        head = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q))))
        q, v, score = (k[rank < keep] for k in (q, v, score))
        head = np.flatnonzero(np.diff(q, prepend=-1))
        cut = pa.array(np.append(head, len(q)), pa.int32())
        lists = [pa.array(node[v]), pa.array(score), vectors["ids"].combine_chunks().take(pa.array(v))]
        return pa.table([queries["q"].take(pa.array(q[head])), queries["query_id"].take(pa.array(q[head])), *[pa.ListArray.from_arrays(cut, x) for x in lists]], names=[n for n, _ in _FOUND])

    return run


def _merge(k: int):
    """The k nearest of each query, from rows of one query in a row."""

    def best(q: int, query_id: int, rows: list[dict]) -> list[tuple]:
        node = np.concatenate([r["node"] for r in rows])
        score = np.concatenate([r["score"] for r in rows])
        ids = [x for r in rows for x in r["ids"]]
        _, one = np.unique(node, return_index=True)
        first, other = _stands([ids[j] for j in one])
        one = one[np.lexsort((np.where(first == query_id, other, first), -score[one]))][:k]
        found = sorted((-score[j], i) for j in one for i in ids[j] if i != query_id)[:k]
        return [(q, query_id, n + 1, i, -s) for n, (s, i) in enumerate(found)]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["q", "query_id", "rank", "vec_id", "score"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for part in parts:
            out: list[tuple] = []
            for row in part.to_pylist():
                if held and held[0]["q"] != row["q"]:
                    out += best(held[0]["q"], held[0]["query_id"], held)
                    held = []
                held.append(row)
            yield batch(out)
        if held:
            yield batch(best(held[0]["q"], held[0]["query_id"], held))

    return run


def _candidates(classes: DataFrame, asked: DataFrame, tables: Tables, k: int) -> DataFrame:
    """The nearest found of each query: q, query_id, rank, vec_id, score."""

    coded = settle(classes.select("node", "embedding", "ids", "band").mapInArrow(_coded(tables), "node long, embedding array<float>, ids array<long>, codes array<long>"), "buckets")
    # a row for each bucket of several cells; as buckets have LOAD vectors on average, these are the hot ones
    sizes = sorted(coded.select(F.explode("codes").alias("code")).groupBy("code").count().filter(F.col("count") > CELL).collect())
    known, split = np.array([r["code"] for r in sizes], np.int64), np.array([-(-r["count"] // CELL) for r in sizes], np.int64)
    tasks = max(1, -(-sum(n * (1 if whole else tables.tables) for n, whole in zip(tables.counts, tables.whole, strict=True)) // TASK_VECTORS))
    vectors = coded.mapInArrow(_cells(known, split, tasks), "task int, cell long, node long, embedding array<float>, ids array<long>")
    queries = asked.select("q", "query_id", "embedding").mapInArrow(_probes(tables, known, split, tasks), "task int, cells array<long>, q long, query_id long, embedding array<float>")
    queries = settle(queries, "probes")
    # a row for each task
    crowd = queries.groupBy("task").agg(F.ceil(F.count(F.lit(1)) / TASK_QUERIES).cast("int").alias("parts")).filter("parts > 1")
    queries = queries.join(crowd, "task", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("q"), F.col("parts"))).cast("int")).drop("parts")
    vectors = vectors.join(crowd, "task", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    near = vectors.groupBy("task", "part").cogroup(queries.groupBy("task", "part")).applyInArrow(_score(tables.dimension, k), "q long, query_id long, node array<long>, score array<double>, ids array<array<long>>")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return near.repartition(parts, "q").sortWithinPartitions("q").mapInArrow(_merge(k), "q long, query_id long, rank int, vec_id long, score double")


def search(rows: DataFrame, queries: DataFrame, k: int = 20, **options) -> DataFrame:
    """The k nearest found of each query: query_id, rank, vec_id, score (inner product in double precision), ties to the smaller vec_id.

    rows and queries: vec_id, embedding.  A query's own vec_id is no candidate of its.  Rows without vec_id and
    vectors that are null, empty, zero or hold a null, NaN or infinity take no part.  Vectors of each length are
    searched by themselves, as an inner product needs equal lengths.  Equal vectors are one candidate that stands for its 2 * k smallest ids, of each id at
    most k rows; a query's own id has at most k of them, so that this loses none of the k nearest.  A query that finds fewer than k in its buckets looks into all.  Repeated query rows
    are answered each; an empty table gives an empty result.
    """
    rows, queries = valid(rows), valid(queries)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    # a row for each length of vectors
    lengths = rows.groupBy(F.size("embedding").alias("n")).agg(F.max(square).alias("m")).orderBy("n").collect()
    asked = {r["n"] for r in queries.select(F.size("embedding").alias("n")).distinct().collect()}
    found = None
    for r in lengths:
        if r["n"] in asked:
            part = _search(*(t.filter(F.size("embedding") == r["n"]) for t in (rows, queries)), r["n"], r["m"], k, options)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), F.col("vec_id"), F.lit(0.0).alias("score")).filter("false")
    return found


def _search(rows: DataFrame, queries: DataFrame, dimension: int, most: float, k: int, options: dict) -> DataFrame:
    """The search among vectors of one length; ``most``: the largest squared norm."""
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    few = rows
    for key, limit in ((["embedding", "vec_id"], k), (["embedding"], 2 * k)):
        each = Window.partitionBy(*key).orderBy("vec_id")
        few = few.withColumn("_n", F.row_number().over(each)).filter(F.col("_n") <= limit)
    grouped = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    # the range of norm, counted from the largest
    classes = settle(grouped.withColumn("band", F.round(F.log2(F.lit(most) / square) * (RANGES / 2)).cast("int")), "vectors", numbered="node")
    bands = classes.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.max(square).alias("m")).collect()
    counts, norms = [0] * (max(r["band"] for r in bands) + 1), [1.0] * (max(r["band"] for r in bands) + 1)
    for r in bands:
        counts[r["band"]], norms[r["band"]] = r["c"], math.sqrt(r["m"]) * (1 + 1e-12)
    asked = settle(queries.select(F.col("vec_id").alias("query_id"), "embedding"), "queries", numbered="q")
    tables = Tables(dimension, tuple(counts), tuple(norms), **options)
    found = settle(_candidates(classes, asked, tables, k), "near")
    all_ = classes.agg(F.sum(F.size("ids")).alias("n")).first()["n"] or 0
    counts = found.groupBy("q").agg(F.count(F.lit(1)).alias("c"))
    short = settle(asked.join(counts, "q", "left").filter(F.coalesce("c", F.lit(0)) < min(k, all_)).select("q", "query_id", "embedding"), "short")
    if short.isEmpty():
        forget(short)
    else:
        everywhere = Tables(tables.dimension, tables.counts, tables.norms, exact=True)
        more = settle(_candidates(classes, short, everywhere, k), "more")
        found = found.join(short.select("q"), "q", "left_anti").unionByName(more)
    return found.select("query_id", "rank", "vec_id", "score")
