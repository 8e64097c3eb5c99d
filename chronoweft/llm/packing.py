"""Best-fit packing in bulk-synchronous rounds.

Lengths and gaps are whole numbers up to the sequence length, and documents of equal length, like neighbouring
sequences of equal gap, stand for each other; both are kept as runs in one small table, whose size the sequence
length bounds and not the corpus.  A round is a job over that table:

1. Documents and gaps are parted into ranges of size.  In each range a sweep from large to small finds every
   document's successor, the smallest gap that holds it, among the gaps that no longer document took: gaps go on
   a stack, documents take from its top as many sequences as their number needs.  Which of the equal documents
   gets which of the equal sequences follows from their ranks.
2. What finds nothing in its range is carried into one sweep over all that is left of the ranges.
3. Documents longer than every gap are left over; of those whose length is within ``SPREAD`` of the longest,
   new sequences open for the longest ones, as many as their total length needs at least.
4. Gaps that were filled in part are there again, smaller, in the next round.

Ranks, and the sequence and offset of every document, are computed where the documents are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from chronoweft.llm.store import forget, settle
from chronoweft.llm.tokens import ids_of

#: Sizes of a range of a sweep; a task holds the runs of one range.
RANGE = 128
#: Sequences open in one round only for lengths of at least the longest one's divided by this.
SPREAD = 1.5
#: Rounds of a job, between two tables in the shared folder; a round without documents changes nothing.
ROUNDS = 6
#: Rows of a round's table: documents, gaps, gaps of the next round, placements, and the number of sequences.
DOCUMENT, GAP, FRESH, PLACED, OPENED = range(5)
_STATE = "kind int, size int, first long, n long, sequence long, each long, offset int"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32, and where each stands among those of its length in its task (_part, _nth)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part in parts:
            out: list[tuple] = []
            source = []
            for row, ids in enumerate(ids_of(part.column("text"), tokenizer, end)):
                raw = ids.astype("<u4").tobytes()
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    out.append((k, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), task, seen[b - a]))
                    source.append(row)
                    seen[b - a] += 1
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            doc = part.column("doc_id").take(pa.array(source, pa.int64())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([doc, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_nth"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _nth long")


class _Sweep:
    """One range of a round: matches documents (length, first rank, number) with gaps (gap, first sequence, number)."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.rows: list[tuple] = []

    def put(self, length: int, rank: int, left: int, gap: int, first: int, sequences: int) -> tuple[int, int]:
        """Fill sequences of one gap with documents of one length; the documents placed and the sequences used."""
        each = gap // length
        full = min(sequences, left // each)
        done = full * each
        parts = [(first, full, each)] if full else []
        if full < sequences and done < left:
            parts.append((first + full, 1, left - done))
        at = rank
        for sequence, n, in_each in parts:
            self.rows.append((PLACED, length, at, n * in_each, sequence, in_each, self.capacity - gap))
            if gap > in_each * length:
                self.rows.append((FRESH, gap - in_each * length, sequence, n, None, None, None))
            at += n * in_each
        return at - rank, sum(n for _, n, _ in parts)

    def match(self, documents: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]]) -> tuple[list, list]:
        """The successor sweep; what is left of both."""
        gaps = sorted(gaps)
        stack: list[list[int]] = []
        unplaced = []
        for length, rank, left in sorted(documents, reverse=True):
            while gaps and gaps[-1][0] >= length:
                stack.append(list(gaps.pop()))
            need = -(-left // (stack[-1][0] // length)) if stack else 0
            while need and left and stack:
                gap, first, n = stack[-1]
                placed, used = self.put(length, rank, left, gap, first, min(n, need))
                rank, left, need = rank + placed, left - placed, need - used
                stack[-1][1:] = first + used, n - used
                if used == n:
                    stack.pop()
            if left:
                unplaced.append((length, rank, left))
        return unplaced, [*stack, *gaps]

    def open(self, documents: list[tuple[int, int, int]], top: int, opened: int) -> tuple[list, int]:
        """New sequences for the longest of the documents that are longer than ``top``; what is left, and the number of sequences."""
        documents = sorted(documents, reverse=True)
        long = [d for d in documents if d[0] > top and d[0] * SPREAD > documents[0][0]]
        wanted = -(-sum(length * n for length, _, n in long) // self.capacity)
        left_over = documents[len(long) :]
        for length, rank, left in long:
            if wanted:
                placed, used = self.put(length, rank, left, self.capacity, opened, wanted)
                rank, left, wanted, opened = rank + placed, left - placed, wanted - used, opened + used
            if left:
                left_over.append((length, rank, left))
        return left_over, opened


def _superstep(capacity: int, last: bool):
    """The sweep of one range; in the last one, which is all, new sequences open."""

    def run(table: pa.Table) -> pa.Table:
        kinds: list[list[tuple]] = [[] for _ in range(5)]
        for row in zip(*(c.to_pylist() for c in table.columns), strict=True):
            kinds[row[0]].append(row)
        sweep = _Sweep(capacity)
        documents, gaps = sweep.match([r[1:4] for r in kinds[DOCUMENT]], [r[1:4] for r in kinds[GAP]])
        rows = sweep.rows + kinds[FRESH] + kinds[PLACED] + ([] if last else kinds[OPENED])
        if last:
            top = max([g[0] for g in gaps] + [r[1] for r in rows if r[0] == FRESH], default=0)
            sweep.rows = []
            documents, opened = sweep.open(documents, top, sum(r[3] for r in kinds[OPENED]))
            least = min((d[0] for d in documents), default=capacity + 1)
            # what is too small for all documents is done with
            rows = [(GAP, *r[1:]) if r[0] == FRESH else r for r in rows + sweep.rows if r[0] != FRESH or r[1] >= least]
            gaps = [g for g in gaps if g[0] >= least]
            rows.append((OPENED, 0, 0, opened, None, None, None))
        rows += [(DOCUMENT, *d, None, None, None) for d in documents] + [(GAP, *g, None, None, None) for g in gaps]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "size", "first", "n", "sequence", "each", "offset"])

    return run


def plan(counts: DataFrame, capacity: int, width: int = RANGE) -> DataFrame:
    """Where the documents of each length go, from length and n: length, first rank, number, first sequence, documents in each sequence, offset of the first.

    Documents of a row follow each other in rank, filling one sequence after the other.
    """
    state = counts.select(F.lit(DOCUMENT).alias("kind"), F.col("length").cast("int").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long"), *[F.lit(None).cast(t).alias(c) for c, t in (("sequence", "long"), ("each", "long"), ("offset", "int"))])
    state, placed, left = settle(state, "packing-lengths"), [], 1
    levels = max(0, -(-capacity // width) - 1).bit_length()
    while left:
        seen, step = Observation(), state.filter(F.col("kind") != PLACED)
        for level in ([0, levels] if levels else [0]) * ROUNDS:
            band = F.shiftright(F.expr(f"greatest(size - 1, 0) div {width}").cast("int"), level)
            step = step.groupBy(band).applyInArrow(_superstep(capacity, level == levels), _STATE)
        state = settle(step.observe(seen, F.count_if(F.col("kind") == DOCUMENT).alias("left")), "packing-rounds")
        left = seen.get["left"]
        placed.append(state)
    rows = state.filter(F.col("kind") == PLACED)
    for more in placed[:-1]:
        rows = rows.union(more.filter(F.col("kind") == PLACED))
    out = settle(rows.select(F.col("size").alias("length"), F.col("first").alias("rank"), "n", "sequence", "each", "offset").coalesce(1), "packing-plan")
    forget(*placed)
    return out


def pack(cut: DataFrame, capacity: int, width: int = RANGE) -> DataFrame:
    """Add sequence_id and offset to settled rows that have length, _part and _nth."""
    # a row for each task and length that occurs in it
    sums = cut.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    # a few rows for each length and round, however large the corpus
    found = plan(sums.groupBy("length").agg(F.sum("_n").alias("n")), capacity, width).collect()
    rows = np.array([tuple(r) for r in found], np.int64).reshape(-1, 6)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # rows of the plan as one sorted key: length, then rank
    key = (rows[:, 0] << 44) + rows[:, 1]
    rows, key = rows[np.argsort(key)], np.sort(key)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            length, rank = part.column("length").to_numpy(), part.column("_base").to_numpy() + part.column("_nth").to_numpy()
            row = rows[np.searchsorted(key, (length << 44) + rank, "right") - 1]
            at = rank - row[:, 1]
            names = [n for n in part.schema.names if not n.startswith("_")]
            placed = [pa.array(row[:, 3] + at // row[:, 4]), pa.array(row[:, 5] + at % row[:, 4] * length)]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *placed], names=[*names, "sequence_id", "offset"])

    both = cut.join(base, ["_part", "length"])
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields if not f.name.startswith("_")]
    return both.mapInArrow(run, ", ".join([*names, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then ``end``; a null or empty text is ``end`` alone.  A longer document than
    ``capacity`` is cut so that only its first piece may be shorter than that.  Offsets of a sequence are gapless
    from 0.  Repeated rows are documents of their own.  Which of equally long pieces stands where depends on how
    the table is read; the number of sequences doesn't.  Fewer than 2**44 pieces; an empty table gives none.
    """
    return pack(settle(pieces(docs, tokenizer, capacity, end), "pieces"), capacity)
