"""MinHash near-duplicates with tensored banding.

A document's set is its distinct word shingles.  Two small collections of sub-keys, each of a few combined
minhashes, are drawn for every set; a table is a pair of one sub-key from either collection, so that ``side``
squared tables need only ``2 * side`` sub-keys.  Two sets meet in some table if they share a sub-key on both
sides.  Equal sets are one class first; the classes that meet are compared on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm import lexical
from chronoweft.llm.graph import components
from chronoweft.llm.ranking import parts_for, ranked
from chronoweft.llm.store import forget, settle

U = lexical.U
#: Sets of a block; a task compares two blocks at a time.
BLOCK = 512
#: Keys, and minhashes in each, for candidate components of several blocks that stay of several labels.
SHARP_KEYS, SHARP_WIDTH = 108, 10


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts as sorted (text number, hash). A text of fewer than k words is one shingle; one without words has none."""
    start, end, text = lexical.word_spans(buf, offsets)
    words = lexical.span_hashes(lexical.prefix_sums(buf, fold=True), start, end)
    at, h = lexical.windows(words, text, k)
    no = text[at]
    count = np.bincount(text, minlength=len(offsets) - 1)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        first = np.searchsorted(text, few)
        whole = np.zeros(len(few), U)
        for j in range(k - 1):
            more = count[few] > j
            whole[more] = lexical.mix(whole[more] * U(lexical.BASE) + words[first[more] + j] + U(j + 1))
        no, h = np.concatenate((no, few)), np.concatenate((h, whole))
    order = np.lexsort((h, no))
    no, h = no[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (no[1:] != no[:-1])
    return no[new], h[new]


def _signature(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits for each set, as rows of 16 bytes."""
    parts = [np.add.reduceat(lexical.mix(h ^ U(salt)), first) for salt in (0x1357, 0x2468ACE0)]
    return np.stack(parts, axis=1)


def _subkeys(h: np.ndarray, first: np.ndarray, count: int, width: int, seed: int) -> np.ndarray:
    """``count`` sub-keys, each of ``width`` minhashes, for each set."""
    draw = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((len(first), count), U)
    for c in range(count):
        for _ in range(width):
            salt, odd = (int(x) for x in draw.integers(0, 2**63, 2, dtype=np.uint64))
            out[:, c] = lexical.mix(out[:, c] + np.minimum.reduceat((h ^ U(salt)) * U(odd * 2 + 1), first))
    return out


def sketch(docs: DataFrame, k: int, side: int, width: int, seed: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, sig (of the set), keys (2 * side sub-keys), carried columns as _c_*; sig and keys are null for an empty set."""
    held = docs.select("doc_id", "text", *[F.col(c).alias(f"_c_{c}") for c in carry])
    carried = [f for f in held.schema.fields if f.name.startswith("_c_")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, hi, buf, offsets in lexical.batches(part.column("text")):
                no, h = shingles(buf, offsets, k)
                n = np.bincount(no, minlength=hi - lo)
                has = np.flatnonzero(n)
                sig: list = [None] * (hi - lo)
                keys: list = [None] * (hi - lo)
                if len(has):
                    first = np.searchsorted(no, has)
                    s, q = _signature(h, first), _subkeys(h, first, 2 * side, width, seed).view(np.int64)
                    for r, d in enumerate(has):
                        sig[d], keys[d] = s[r].tobytes(), q[r]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(sig, pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())), *[part.column(f.name).slice(lo, hi - lo) for f in carried],
                    ],
                    names=["doc_id", "n_shingles", "sig", "keys", *[f.name for f in carried]],
                )

    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in carried)
    return held.mapInArrow(run, "doc_id long, n_shingles long, sig binary, keys array<long>" + more)


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node and its sorted 64-bit shingles, for the classes in ``wanted`` (node, sig, min_doc)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, hi, buf, offsets in lexical.batches(part.column("text")):
                no, h = shingles(buf, offsets, k)
                node, sig, out = part.column("node").slice(lo, hi - lo).to_numpy(), part.column("sig").slice(lo, hi - lo).to_pylist(), []
                cut = np.searchsorted(no, np.arange(hi - lo + 1))
                for r in range(hi - lo):
                    own = h[cut[r] : cut[r + 1]]
                    # rows that share a doc_id can have other texts
                    if len(own) and _signature(own, np.array([0]))[0].tobytes() == sig[r]:
                        out.append((node[r], own.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["node", "shingles"])

    texts = docs.select(F.col("doc_id").alias("_d"), "text")
    found = texts.join(wanted, texts["_d"].eqNullSafe(wanted["min_doc"])).select("node", "sig", "text").mapInArrow(run, "node long, shingles binary")
    return found.dropDuplicates(["node"])


def _joined(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> np.ndarray:
    """Smallest position that each set's links reach, in x and y together. With y, only links between the two count."""
    sets = x + y
    size = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(len(sets)), size)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times > 1
    column, keep = np.cumsum(common) - 1, common[code]
    row, column = of[keep], column[code[keep]]
    left, right = (slice(0, len(x)), slice(len(x), None)) if y else (slice(None), slice(None))
    both = np.zeros((len(sets[left]), len(sets[right])), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(common.sum()), 8192):
        a, b = np.searchsorted(column, (lo, lo + 8192))
        part = np.zeros((len(sets), 8192), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        both += part[left] @ part[right].T
    both = both.astype(np.int64)
    near = np.zeros((len(sets), len(sets)), bool)
    near[left, right] = 100 * both >= percent * (size[left, None] + size[None, right] - both)
    near |= near.T
    np.fill_diagonal(near, True)
    label = np.arange(len(sets))
    while True:
        least = np.where(near, label[None, :], len(sets)).min(axis=1)
        if (least == label).all():
            return label
        label = least


def _blocks(percent: int):
    """Links of a task's block pairs, as a link of each set to the smallest that it reaches there."""

    def run(table: pa.Table) -> pa.Table:
        pair, second, node = table["pair"].to_numpy(), table["second"].to_numpy(), table["node"].to_numpy()
        order = np.lexsort((node, second, pair))
        sets = table["shingles"].take(pa.array(order)).to_pylist()
        pair, second, node = pair[order], second[order], node[order]
        cut = [*np.flatnonzero(np.diff(pair, prepend=pair[0] - 1)), len(pair)]
        a, b = [], []
        for lo, hi in zip(cut, cut[1:], strict=False):
            own = [np.frombuffer(v, U) for v in sets[lo:hi]]
            split = int((~second[lo:hi]).sum())
            label = _joined(own[:split], own[split:], percent)
            linked = np.flatnonzero(label != np.arange(hi - lo))
            a.append(node[lo:hi][linked])
            b.append(node[lo:hi][label[linked]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join whatever links join in each block pair. pairs: node, pair, second (the node is of the pair's second block)."""
    tasks = max(parts_for(pairs), -(-pairs.count() // (4 * BLOCK)))
    dealt = pairs.join(sets, "node").withColumn("task", F.pmod(F.xxhash64("pair"), F.lit(tasks)))
    return settle(dealt.groupBy("task").applyInArrow(_blocks(percent), "a long, b long"), "links")


def _relabel(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with the label of their node; a node without a link is its own."""
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _own_blocks(rows: DataFrame, order: list[str]) -> DataFrame:
    """Each component's nodes in blocks of BLOCK, in order: component, node, block and what else rows have."""
    return settle(ranked(rows, ["component"], order, "_rank").withColumn("block", F.expr(f"_rank div {BLOCK}")).drop("_rank"), "blocks")


def _inside(blocks: DataFrame) -> DataFrame:
    """Every block with itself."""
    return blocks.select("node", F.xxhash64("component", "block").alias("pair"), F.lit(False).alias("second"))


def _meeting(classes: DataFrame, side: int) -> DataFrame | None:
    """Classes that meet in tables, directly or through others: node, component."""
    sub = classes.select("node", F.posexplode("keys").alias("pos", "val"))
    shared = sub.groupBy("pos", "val").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    own = sub.join(shared, ["pos", "val"]).groupBy("node").agg(
        F.collect_list(F.when(F.col("pos") < side, F.struct("pos", "val"))).alias("u"), F.collect_list(F.when(F.col("pos") >= side, F.struct("pos", "val"))).alias("v")
    )  # at most 2 * side sub-keys of a node
    keyed = own.select("node", F.explode("u").alias("u"), "v").select("node", "u", F.explode("v").alias("v")).select(F.xxhash64("u", "v").alias("key"), "node")
    return _together(settle(keyed, "tables"))


def _together(keyed: DataFrame) -> DataFrame | None:
    """Nodes that share a key, directly or through others: node, component. keyed: settled key, node; it is deleted."""
    first = keyed.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    edges = settle(keyed.join(first, "key").filter("node <> first").select("node", "first").distinct(), "meets")
    forget(keyed)
    return None if edges.isEmpty() else components(edges, "node", "first").withColumnRenamed("label", "component")


def _sharper(sets: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """node and its sharper keys, from its shingles."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo in range(0, len(part), 256):
                own = part.slice(lo, 256)
                h = [np.frombuffer(x, U) for x in own.column("shingles").to_pylist()]
                first = np.cumsum([0, *map(len, h[:-1])])
                keys = _subkeys(np.concatenate(h), first, SHARP_KEYS, SHARP_WIDTH, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([own.column("node"), pa.array(list(keys), pa.list_(pa.int64()))], names=["node", "keys"])

    return settle(sets.join(nodes.select("node"), "node").mapInArrow(run, "node long, keys array<long>"), "sharper")


def _links(classes: DataFrame, docs: DataFrame, k: int, percent: int, side: int, seed: int) -> DataFrame | None:
    """Component labels of the classes that link with another: node, label.

    Classes that meet in tables form candidate components, and all pairs within one are compared, block by
    block, as products of 0/1 matrices; no pair becomes a row.  Of a component of several blocks, first each
    block is compared with itself and then one member of every label so far.  Where several labels are left, as
    among texts that only share boilerplate, sharper tables part the component once more, and only what meets
    in these is compared across blocks, without block pairs that are one label by then.
    """
    met = _meeting(classes, side)
    if met is None:
        return None
    met = settle(met, "candidates")
    sets = settle(_sets(docs, classes.join(met, "node").select("node", "sig", "min_doc"), k), "sets")
    blocks = _own_blocks(met, ["node"])
    links = _compare(_inside(blocks), sets, percent)
    large = settle(blocks.filter("block > 0").select("component").distinct().join(blocks, "component").select("component", "node"), "large")
    forget(met, blocks)
    if not large.isEmpty():
        one = _relabel(large, components(links, "a", "b")).filter("node = label").select("component", "node")
        links = links.union(_compare(_inside(_own_blocks(one, ["node"])), sets, percent))
        links = links.union(_across(_relabel(large, components(links, "a", "b")), sets, percent, seed))
    found = None if links.isEmpty() else components(links, "a", "b")
    forget(sets, large)
    return found


def _across(labelled: DataFrame, sets: DataFrame, percent: int, seed: int) -> DataFrame:
    """Links between blocks of the components (component, node, label) that have several labels."""
    labelled = settle(labelled.select("component", "node", "label"), "labelled")
    mixed = labelled.groupBy("component").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("component")
    sharper = _sharper(sets, labelled.join(mixed, "component", "left_semi"), seed + 1)
    met = _together(settle(sharper.select("node", F.posexplode("keys").alias("pos", "val")).select(F.xxhash64("pos", "val").alias("key"), "node"), "sharp-tables"))
    if met is None:
        return labelled.select(F.col("node").alias("a"), F.col("label").alias("b")).limit(0)
    blocks = _own_blocks(met.join(labelled.select("node", "label"), "node"), ["label", "node"])
    pure = blocks.groupBy("component", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    other = pure.select("component", F.col("block").alias("block2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    todo = pure.join(other, "component").filter("block <= block2 and not (lo = hi and lo2 = hi2 and lo = lo2)")
    todo = settle(todo.select("component", "block", "block2", F.xxhash64("component", "block", "block2").alias("pair")), "block-pairs")
    first = blocks.join(todo, ["component", "block"]).select("node", "pair", F.lit(False).alias("second"))
    second = blocks.withColumnRenamed("block", "block2").join(todo.filter("block < block2"), ["component", "block2"]).select("node", "pair", F.lit(True).alias("second"))
    found = _compare(first.union(second), sets, percent)
    forget(labelled, sharper, blocks, todo)
    return found


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, side: int = 12, width: int = 2, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; with ``carry`` also those columns, and one, which is true for one row of each component.

    Documents link at 100 * intersection >= percent * union of their shingle sets; component_id is the smallest
    doc_id that links reach.  Two sets of similarity s miss each other in all tables with a probability of about
    2 * (1 - s**width)**side, below 0.00001 at 0.8, and within large components of several labels, where sharper
    tables follow, below 0.00003; every link is confirmed on the full sets.
    A text without words, or null, has an empty set and links with nothing, not even with its like.  Repeated
    rows are documents of their own that link by their texts; all that have the component's doc_id are kept, and
    ``one`` tells one of them.  A null doc_id names a component, and is kept, only if all ids in it are null.
    An empty table gives an empty result.
    """
    rows = settle(sketch(docs, k, side, width, seed, carry), "sketch", numbered="_row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("_row").alias("row"))
    classes = settle(rows.filter("n_shingles > 0").groupBy("sig", "n_shingles", "keys").agg(F.min(order).alias("best")).withColumn("min_doc", F.col("best.doc_id")), "classes", numbered="node")
    labels = _links(classes, docs, k, percent, side, seed)
    named = classes.select("sig", "best", "node")
    if labels is not None:
        named = settle(_relabel(named, labels), "named")
        named = named.drop("best").join(named.groupBy("label").agg(F.min("best").alias("best")), "label")
    out = rows.join(named.select(F.col("sig").alias("_sig"), "best"), F.col("sig") == F.col("_sig"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("best.doc_id")).otherwise(F.col("doc_id"))
    columns = ["doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")]
    if not carry:
        return out.select(*columns)
    one = (F.col("n_shingles") == 0) | (F.col("_row") == F.col("best.row"))
    return out.select(*columns, one.alias("one"), *[F.col(f"_c_{c}").alias(c) for c in carry])
