"""Sharding by a hierarchical weighted hash tree.

A tree has region, rack and shard levels.  At each level a row draws ``ln(u) / weight`` for every child, with
u a hash of the row's key and the child's name, and goes down to the child with the largest draw.  A child's
draw depends on nothing but the key, the child's name and its weight: where a weight grows, rows move only
into that child, and all other children keep theirs.  A shard added as a region of its own therefore takes
rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.ranking import ranked

ROOT = "root"


@dataclass(frozen=True)
class Tree:
    """children: (name, weight, shard or -1) of each inner node, by its name."""

    children: dict[str, list[tuple[str, float, int]]]
    depth: int = 3


def topology(shards: int, base: int = 40, racks_per_region: int = 2, shards_per_rack: int = 5, weights: dict[int, float] | None = None) -> Tree:
    """The tree of ``shards`` shards, of weight 1 or what ``weights`` says; a rack or region weighs what its shards do.

    The first ``base`` fill racks and regions in turn; every later one stands in a region and rack of its own,
    so that topology(n + 1) is topology(n) with one more child of the root.
    """
    nodes: dict[str, dict[str, tuple[float, int]]] = {ROOT: {}}
    for s in range(shards):
        rack = s // shards_per_rack if s < base else f"x{s}"
        region = s // (shards_per_rack * racks_per_region) if s < base else f"x{s}"
        region, rack = f"region-{region}", f"rack-{rack}"
        for parent, child, leaf in ((ROOT, region, -1), (region, rack, -1), (rack, f"shard-{s}", s)):
            weight, _ = nodes.setdefault(parent, {}).get(child, (0.0, leaf))
            nodes[parent][child] = (weight + (weights or {}).get(s, 1.0), leaf)
    return Tree({p: [(c, w, leaf) for c, (w, leaf) in kids.items()] for p, kids in nodes.items()})


def _draw(key: Column, child: Column, seed: int) -> Column:
    """ln(u) / weight with u in (0, 1) from 52 bits of the hash."""
    bits = F.shiftrightunsigned(F.xxhash64(key, child["name"], F.lit(seed)), 12)
    return F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))) / child["weight"]


def place(key: Column, tree: Tree, seed: int = 0) -> Column:
    """The shard of a key: one weighted draw at each level. A null key is a key like any other; equal draws go to the larger name."""
    nodes = F.create_map(
        *[
            x
            for parent, kids in tree.children.items()
            for x in (F.lit(parent), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(s).alias("shard")) for n, w, s in kids]))
        ]
    )
    at = F.lit(ROOT)
    for _ in range(tree.depth):
        drawn = F.transform(F.element_at(nodes, at), lambda c: F.struct(_draw(key, c, seed).alias("draw"), c["name"].alias("name"), c["shard"].alias("shard")))
        best = F.array_max(drawn)
        at = best["name"]
    return best["shard"]


def assign_shards(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 16 (null text: 16) and text_crc32 the checksum of the bytes (null: of
    none).  slot counts 0, 1, ... in each shard by doc_id, nulls first, then size and checksum; rows equal in all
    of these may change places.  Repeated rows stay separate rows.  Other columns of ``docs`` play no part.
    An empty table gives an empty result.
    """
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    key = F.col("doc_id")
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.select(
        "*",
        F.lit("key").alias("law"),
        place(key, topology(shards), seed).alias("shard"),
        place(key, topology(shards + 1), seed).alias("grown_shard"),
    )
    out = ranked(rows, ["shard"], ["doc_id", "size", "text_crc32"], "slot", "shards")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """Write every document into a folder for its shard, in slot order; many tasks write a large shard.

    Rows of ``docs`` and ``assigned`` meet by doc_id, which must be unique and not null here.
    """
    both = docs.join(assigned.select("doc_id", "shard", "slot"), "doc_id")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
