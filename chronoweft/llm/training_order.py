"""Training-order materialisation by a keyed permutation.

Sequences are counted first: a document's first index is the number of sequences of all documents before it, in
order of doc_id, and its sequences follow each other.  A keyed Feistel network over the next power of four,
walked along its cycle until it lands below the number of sequences, permutes the indices, and a permuted index
is the sequence's slot.  Equal ranges of slots are shards; a task gets one range, sorts it and writes it as
records of one fixed size.  Shard and byte offset of a slot follow by division and multiplication, so that
training reads straight on and resumes at any slot.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweft.llm import lexical
from chronoweft.llm.ranking import running
from chronoweft.llm.store import filesystem, fresh, settle
from chronoweft.llm.tokens import encoder, ids_of, vocabulary

U = np.uint64
#: doc_id, whether there is one, place in the document and number of ids, before the ids of a record.
HEAD = "<q?3xii"
#: Rows of a file whose first indices are read at once.
BLOCK_ROWS = 1 << 16


@dataclass(frozen=True)
class Permutation:
    """A keyed bijection of 0 to size - 1."""

    size: int
    key: int
    rounds: int = 6

    def _half(self) -> int:
        return max(1, (max(self.size - 1, 1).bit_length() + 1) // 2)

    def _keys(self) -> np.ndarray:
        return lexical.mix(np.arange(1, self.rounds + 1).astype(U) * U(lexical.BASE) + U(self.key % 2**64))

    def _pass(self, x: np.ndarray, back: bool) -> np.ndarray:
        half = U(self._half())
        mask = (U(1) << half) - U(1)
        left, right = x >> half, x & mask
        for k in self._keys()[::-1] if back else self._keys():
            if back:
                left, right = right ^ (lexical.mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (lexical.mix(right ^ k) & mask)
        return (left << half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._pass(np.asarray(x).astype(U), back)
        while (outside := out >= U(self.size)).any():
            out[outside] = self._pass(out[outside], back)
        return out.astype(np.int64)

    def forward(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, False)

    def inverse(self, place: np.ndarray) -> np.ndarray:
        return self._walk(place, True)


@dataclass(frozen=True)
class Layout:
    """Everything that reads and writes must agree on. size: the number of sequences; width: bytes of an id."""

    path: str
    shards: int
    length: int
    size: int
    key: int
    width: int

    @property
    def stride(self) -> int:
        return struct.calcsize(HEAD) + self.length * self.width

    @property
    def per_shard(self) -> int:
        return max(1, -(-self.size // self.shards))

    @property
    def ids(self) -> np.dtype:
        return np.dtype(f"<u{self.width}")

    @property
    def permutation(self) -> Permutation:
        return Permutation(self.size, self.key)


def _count(tokenizer: str, length: int):
    """The number of sequences of each document, with one id at its end."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for part in parts:
            for lo in range(0, len(part), 512):
                own = part.slice(lo, 512)
                n = [(len(encode(t)) + length) // length if t else 1 for t in own.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in ("file", "row", "doc_id", "h")], pa.array(n, pa.int64())], names=["file", "row", "doc_id", "h", "n"])

    return run


class _Firsts:
    """First indices by file and row, read a block of rows at a time."""

    def __init__(self, path: str) -> None:
        self.path, self.fs = path, filesystem(path)
        self.held: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, file: int, block: int) -> np.ndarray:
        if (file, block) not in self.held:
            fs, root = self.fs
            found = np.full(BLOCK_ROWS, -1, np.int64)
            for info in fs.get_file_info(pafs.FileSelector(f"{root}/file={file}/block={block}", allow_not_found=True)):
                if info.base_name.endswith(".parquet"):
                    rows = pq.read_table(info.path, filesystem=fs, columns=["row", "first"], partitioning=None)
                    found[rows["row"].to_numpy() % BLOCK_ROWS] = rows["first"].to_numpy()
            if len(self.held) > 16:
                self.held.clear()
            self.held[file, block] = found
        return self.held[file, block]

    def of(self, file: np.ndarray, row: np.ndarray) -> np.ndarray:
        out = np.empty(len(row), np.int64)
        key = np.stack((file, row // BLOCK_ROWS))
        for f, b in np.unique(key, axis=1).T.tolist():
            mine = (key[0] == f) & (key[1] == b)
            out[mine] = self._block(f, b)[row[mine] % BLOCK_ROWS]
        if (out < 0).any():
            raise RuntimeError("documents that were not there when they were counted")
        return out


def _sequences(layout: Layout, index_path: str, tokenizer: str, end: int):
    """Each sequence's shard, slot and record."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = _Firsts(index_path)
        for part in parts:
            for lo in range(0, len(part), 512):
                own, index, records = part.slice(lo, 512), [], []
                places = firsts.of(own.column("file").to_numpy(), own.column("row").to_numpy())
                for doc_id, first, ids in zip(own.column("doc_id").to_pylist(), places.tolist(), ids_of(own.column("text"), tokenizer, end), strict=True):
                    raw = ids.astype(layout.ids)
                    for k, a in enumerate(range(0, len(ids), layout.length)):
                        index.append(first + k)
                        ids_there = raw[a : a + layout.length]
                        records.append(struct.pack(HEAD, doc_id or 0, doc_id is not None, k, len(ids_there)) + ids_there.tobytes())
                slot = layout.permutation.forward(np.array(index, np.int64))
                shard = (slot // layout.per_shard).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(slot), pa.array(records, pa.binary())], names=["shard", "slot", "record"])

    return run


def _write(layout: Layout):
    """Write the shards of a task, each to a new file; a row for each shard tells its file and number of records."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(layout.path)
        now, out, name, count, done = None, None, "", 0, []
        blank = bytes(layout.stride)
        for part in parts:
            for shard, record in zip(part.column("shard").to_pylist(), part.column("record"), strict=True):
                if shard != now:
                    if out:
                        out.close()
                        done.append((now, name, count))
                    now, name, count = shard, f"shard-{shard:06d}-{uuid.uuid4().hex}.bin", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20)
                record = record.as_buffer()
                out.write(record)
                out.write(blank[: layout.stride - record.size])
                count += 1
        if out:
            out.close()
            done.append((now, name, count))
        columns = list(zip(*done, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["shard", "file", "records"])

    return run


def _read(layout: Layout):
    """Every record of the shards from a slot on."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(layout.path)
        step = max(1, (1 << 20) // layout.stride)
        for part in parts:
            for row in part.to_pylist():
                skip = max(0, row["from_slot"] - row["first_slot"])
                with fs.open_input_file(f"{root}/{row['file']}") as data:
                    data.seek(skip * layout.stride)
                    for k in range(skip, row["records"], step):
                        n = min(step, row["records"] - k)
                        chunk = data.read(n * layout.stride)
                        heads = [struct.unpack_from(HEAD, chunk, j * layout.stride) for j in range(n)]
                        at = np.arange(k, k + n)
                        ids = [chunk[j * layout.stride + struct.calcsize(HEAD) :][: h[3] * layout.width] for j, h in enumerate(heads)]
                        wide = [np.frombuffer(x, layout.ids).astype("<u4").tobytes() for x in ids]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(at + row["first_slot"]),
                                pa.array(np.full(n, row["shard"], np.int32)),
                                pa.array(at * layout.stride),
                                pa.array([h[0] if h[1] else None for h in heads], pa.int64()),
                                pa.array([h[2] for h in heads], pa.int32()),
                                pa.array([h[3] for h in heads], pa.int64()),
                                pa.array([zlib.crc32(x) for x in wide], pa.int64()),
                                pa.array(ids, pa.binary()),
                            ],
                            names=["slot", "shard", "byte_offset", "doc_id", "piece", "length", "ids_crc32", "ids"],
                        )

    return run


_READ = "slot long, shard int, byte_offset long, doc_id long, piece int, length long, ids_crc32 long, ids binary"


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id and text with where each row stands: a number for its file, and its row there. These stay the same however the files are split; rows that come from no Parquet file are written first."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    try:
        placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        _ = placed.schema
        return placed
    except AnalysisException:
        return _identified(settle(rows, "documents"))


def _indexed(docs: DataFrame, tokenizer: str, length: int) -> tuple[DataFrame, str, int]:
    """The documents with their file and row, the table of their first indices, and the number of all sequences.

    The table is parted by file and blocks of rows, so that a task reads what it needs of it, whatever part of which
    file it got, and no text is shuffled.
    """
    placed = _identified(docs)
    hashed = placed.select("file", "row", "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    each = settle(hashed.mapInArrow(_count(tokenizer, length), "file long, row long, doc_id long, h long, n long").withColumn("none", F.col("doc_id").isNull()), "counts")
    size = each.agg(F.sum("n").alias("size")).first()["size"] or 0
    path = fresh(docs.sparkSession, "first-index")
    first = running(each, ["none", "doc_id", "h", "file", "row"], "n", "first").select("file", F.expr(f"row div {BLOCK_ROWS}").alias("block"), "row", "first")
    first.repartition("file", "block").write.partitionBy("file", "block").parquet(path)
    return placed, path, size


def materialise(docs: DataFrame, tokenizer: str, length: int = 512, key: int = 20240229, end: int = 2, shard_bytes: int = 32 << 20) -> tuple[Layout, DataFrame]:
    """Write all sequences in training order. Returns the layout and the manifest: shard, file, records, first_slot.

    A document is its ids and then ``end`` (a null or empty text is ``end`` alone), cut into sequences of
    ``length``; the last may be shorter and is padded in its record.  Documents are numbered by doc_id (null
    last), those that share one by a hash of the text; repeated rows are documents of their own.  ``docs`` is
    read twice; rows are known by their file and place in it, so that executors may come and go and files may be
    split otherwise in between.  An id takes two bytes, or four if the vocabulary needs them.  An empty table has no shard.  The slot of a sequence
    depends on the table, ``length`` and ``key`` alone.  Files of tasks that were repeated are left over and not
    in the manifest.
    """
    spark = docs.sparkSession
    rows, index_path, size = _indexed(docs, tokenizer, length)
    width = 2 if max(vocabulary(tokenizer) - 1, end) < 1 << 16 else 4
    path = fresh(spark, "training-order")
    shards = max(1, round(size * (struct.calcsize(HEAD) + length * width) / shard_bytes))
    layout = Layout(path, shards, length, size, key, width)
    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)
    cut = rows.mapInArrow(_sequences(layout, index_path, tokenizer, end), "shard int, slot long, record binary")
    # slots are ranges of shards already: no sample is needed to part them
    ranges = cut.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    files = settle(ranges.mapInArrow(_write(layout), "shard int, file string, records long"), "manifest")
    manifest = files.withColumn("first_slot", F.col("shard") * F.lit(layout.per_shard).cast("long"))
    with fs.open_output_stream(f"{root}/layout.json") as out:
        out.write(json.dumps(asdict(layout)).encode())
    return layout, manifest


def read_from(spark: SparkSession, layout: Layout, manifest: DataFrame, slot: int = 0) -> DataFrame:
    """Records from a slot on: slot, shard, byte_offset, doc_id, piece, length, ids_crc32, ids. Each task reads its shards from front to back."""
    tail = manifest.filter(F.col("first_slot") + F.col("records") > slot).withColumn("from_slot", F.lit(slot).cast("long"))
    return tail.repartition(layout.shards).mapInArrow(_read(layout), _READ)


def training_order(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Materialise, then read all records back: doc_id, piece, length, ids_crc32, slot, shard, byte_offset."""
    layout, manifest = materialise(docs, tokenizer, **options)
    back = read_from(docs.sparkSession, layout, manifest)
    return back.select("doc_id", "piece", "length", "ids_crc32", "slot", "shard", "byte_offset")
