"""Mixing sources to target weights by the cube method.

Each source's documents share one rate, its target over its size.  A document is taken ``floor(rate)`` times
and, with probability the rest, once more.  These rests are the inclusion probabilities that the cube method
moves: in the flight phase three documents at a time move along a direction that keeps the sum of
probabilities and the sum of probability times size, until one of them is in or out.  Blocks of documents fly
apart from each other; the at most two undecided ones of each block meet in a further round, and so on, until
one block for a source is left.  A few documents of every source, the largest and some drawn by a hash, wait on
the ground from the start; these and the last two undecided ones are the landing problem, solved by trying
every way to have them in or out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.llm.ranking import parts_for, ranked
from chronoweft.llm.store import forget, settle

WORD = r"[^\x20\x09-\x0D]+"
_EDGE = 1e-9
#: Documents of a source that wait for the landing, which tries 2**(HELD_BACK + 2) ways.
HELD_BACK = 12
#: So many of them are the source's largest, as the flight can leave any sizes over; the others are drawn by a hash.
LARGEST = 4
#: Documents of a task, about; a block has fewer.
TASK_ROWS = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quotas(totals: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Each source's number in order of code points (null last) and target, from source, s (its size) and n: adds k and target.

    Targets are ``share`` of all sizes by weight; what lies above ``most`` times a source's size goes to the others by
    weight.  All sources that lie above at one level of the open ones' share give to the others at once; the level only
    grows, so a source that is full stays full, and a round is one aggregate over the sources.
    """
    named = totals.withColumn("_none", F.col("source").isNull())
    order = settle(ranked(named, [], ["_none", "source"], "k", "mix-ranks").drop("_none"), "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    all_ = order.agg(F.sum("s")).first()[0]
    level, open_ = 0.0, -1
    while True:
        full = weight * F.lit(level) > F.lit(most) * F.col("s")
        now = order.agg(F.count(F.when(~full, 1)).alias("n"), F.sum(F.when(full, F.col("s"))).alias("s"), F.sum(F.when(~full, weight)).alias("w")).first()
        if now["n"] in (open_, 0):
            break
        open_, level = now["n"], (share * all_ - most * (now["s"] or 0)) / now["w"]
    return order.withColumn("target", F.when(full, F.lit(most) * F.col("s")).otherwise(weight * F.lit(level)).cast("double"))


def _step(p: list[float], u: tuple[float, ...], rng: np.random.Generator) -> None:
    """Move p along u or against it, as far as the unit cube goes, so that its expectation stays."""
    up = min(((1 - a) / b if b > 0 else a / -b) for a, b in zip(p, u, strict=True) if b)
    down = min((a / b if b > 0 else (1 - a) / -b) for a, b in zip(p, u, strict=True) if b)
    by = up if rng.random() * (up + down) < down else -down
    for k, b in enumerate(u):
        p[k] += by * b


def _land(out: np.ndarray, last: np.ndarray, size: np.ndarray) -> None:
    """Of all ways to have the last documents in or out, the one whose sum of sizes, then number, comes nearest to what their probabilities give."""
    ways = (np.arange(1 << len(last))[:, None] >> np.arange(len(last))) & 1
    words = np.abs(ways @ size[last].astype(float) - out[last] @ size[last].astype(float))
    number = np.abs(ways.sum(axis=1) - out[last].sum())
    out[last] = ways[np.lexsort((number, words))[0]]


def fly(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator, held: np.ndarray, land: bool) -> np.ndarray:
    """Probabilities after the flight of all documents that are not ``held``: of these at most two are not 0 or 1; with ``land`` the held ones and these are decided too.

    The sum of probability times size, and nearly that of probability, are kept as far as the landing can.
    """
    out = prob.astype(float).copy()
    active: list[int] = []

    def settle_edges() -> None:
        for k in active:
            out[k] = 0.0 if out[k] < _EDGE else 1.0 if out[k] > 1 - _EDGE else out[k]
        active[:] = [k for k in active if 0.0 < out[k] < 1.0]

    def move(members: list[int], u: tuple[float, ...]) -> None:
        p = [float(out[k]) for k in members]
        _step(p, u, rng)
        out[members] = p
        settle_edges()

    open_ = (out > _EDGE) & (out < 1 - _EDGE)
    for k in np.flatnonzero(open_ & ~held):
        active.append(int(k))
        while len(active) == 3:
            a, b, c = (float(size[j]) for j in active)
            scale = max(abs(b - c), abs(c - a), abs(a - b))
            move(list(active), ((b - c) / scale, (c - a) / scale, (a - b) / scale) if scale else (1.0, -1.0, 0.0))
    out[(out <= _EDGE) & (out > 0)], out[(out >= 1 - _EDGE) & (out < 1)] = 0.0, 1.0
    while len(active) == 2 and size[active[0]] == size[active[1]]:
        move(list(active), (1.0, -1.0))
    if land:
        _land(out, np.concatenate((np.flatnonzero(open_ & held), np.array(active, np.int64))), size)
    return out


def _flights(seed: int, level: int):
    """The flights of a task's blocks, and the landing of a source that has one block left (_land)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("_k", "_block", "doc_id", "size", "_copy")])
        k, block, p, size, held, land = (table[c].to_numpy() for c in ("_k", "_block", "_p", "size", "_held", "_land"))
        p = p.copy()
        cut = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (block[1:] != block[:-1]), [True])))
        for lo, hi in zip(cut, cut[1:], strict=False):
            key = np.array([seed, (int(k[lo]) << 32) + (level << 28) + int(block[lo])], np.uint64)
            p[lo:hi] = fly(p[lo:hi], size[lo:hi], np.random.Generator(np.random.Philox(key=key)), held[lo:hi], bool(land[lo]))
        return table.set_column(table.schema.get_field_index("_p"), "_p", pa.array(p))

    return run


def _copies(rows: DataFrame) -> DataFrame:
    """Add _copy: 0, 1, ... for the rows that agree in source, doc_id and size, so that they can be told apart whatever partition they come from."""
    same = ["_source", "doc_id", "size"]
    more = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c")
    more = settle(more.select(*[F.col(c).alias(f"_r{c}") for c in same]), "mix-repeats")
    if more.isEmpty():
        forget(more)
        return rows.withColumn("_copy", F.lit(0).cast("long"))
    on = rows["_source"].eqNullSafe(more["_r_source"]) & rows["doc_id"].eqNullSafe(more["_rdoc_id"]) & (rows["size"] == more["_rsize"])
    again = ranked(rows.join(more, on, "left_semi"), same, ["_row"], "_copy", "mix-copies")
    return rows.join(more, on, "left_anti").withColumn("_copy", F.lit(0).cast("long")).unionByName(again.withColumn("_copy", F.col("_copy").cast("long")))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_rows: int = 4096, seed: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken; with ``carry`` also those columns of ``docs``, and times, how often it is taken.

    size is the number of words (null text: 0).  A null source is a source of its own, the last in order.
    taken is size times the number of times the document is taken; a document of size 0 has taken 0.  Repeated
    rows are documents of their own.  Which are taken depends on the rows and the seed, not on partitions;
    rows equal in doc_id, size and source may change places.  An empty table gives an empty result.
    """
    held = settle(docs.select("doc_id", word_count(F.col("text")).alias("size"), F.col("source").alias("_source"), *[F.col(c).alias(f"_c_{c}") for c in carry]), "mix-sizes", numbered="_row")
    rows = held.select("doc_id", "size", "_source", "_row")
    wanted = quotas(rows.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")), weights, share, most)
    rate = F.when(F.col("s") > 0, F.col("target") / F.col("s")).otherwise(0.0)
    wanted = wanted.withColumn("_whole", F.floor(rate).cast("int")).select(
        F.col("source").alias("_qs"), F.col("k").alias("_k"), F.col("s").alias("source_size"), "target", "_whole", (rate - F.col("_whole")).alias("_p"), F.ceil(F.col("n") / block_rows).cast("int").alias("_blocks"), F.col("n").alias("_n")
    )
    wanted = settle(wanted, "mix-quotas")
    known = wanted.agg(F.max("_blocks").alias("blocks"), F.sum("_n").alias("rows")).first()
    now = _copies(rows).join(wanted, F.col("_source").eqNullSafe(F.col("_qs"))).drop("_qs", "_source", "_n")
    now = now.withColumn("_draw", F.xxhash64("doc_id", "size", "_copy", F.lit(seed)))
    now = now.withColumn("_block", F.pmod("_draw", F.col("_blocks")).cast("int"))
    # the last of the documents that wait, by size and by the draw; Spark cuts each task's rows to that many before they meet
    big, any_ = F.struct("size", "_draw"), F.col("_draw")
    waits = None
    for name, order, most_, last in (("_big", big.desc(), LARGEST, F.min(big)), ("_any", any_.asc(), HELD_BACK - LARGEST, F.max(any_))):
        drawn = now.filter("_p > 0").select("_k", "size", "_draw").withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(order))).filter(F.col("_r") <= most_)
        drawn = drawn.groupBy(F.col("_k").alias("_w")).agg(last.alias(name))
        waits = drawn if waits is None else waits.join(drawn, "_w")
    waits = settle(waits, "mix-waits")
    now = now.join(waits, F.col("_k") == F.col("_w"), "left").withColumn("_held", F.coalesce((big >= F.col("_big")) | (any_ <= F.col("_any")), F.lit(False)))
    now = settle(now.drop("_w", "_big", "_any", "_draw"), "mix-start")
    blocks, level, done = known["blocks"] or 1, 0, []
    ground, flying = now.filter("_held"), now.filter("not _held")
    while True:
        last = blocks <= 1
        if last:
            flying = flying.unionByName(ground.withColumn("_block", F.lit(0)))
        tasks = max(parts_for(docs), -(-(known["rows"] or 0) // TASK_ROWS))
        dealt = flying.withColumn("_land", F.lit(last)).groupBy(F.pmod(F.xxhash64("_k", "_block"), F.lit(tasks)))
        flown = settle(dealt.applyInArrow(_flights(seed, level), flying.withColumn("_land", F.lit(last)).schema).drop("_land"), "mix-flight")
        open_ = (F.col("_p") > 0) & (F.col("_p") < 1)
        if last:
            done.append(flown)
            break
        done.append(flown.filter(~open_))
        flying = flown.filter(open_).withColumn("_block", F.expr("_block div 1024").cast("int"))
        blocks, level = -(-blocks // 1024), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.withColumn("times", F.col("_whole") + F.col("_p").cast("int"))
    columns = ["doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken")]
    if not carry:
        return out.select(*columns)
    texts = held.select(F.col("_row").alias("_r"), *[F.col(f"_c_{c}").alias(c) for c in carry])
    return out.join(texts, F.col("_row") == F.col("_r")).select(*columns, *carry, "times")
