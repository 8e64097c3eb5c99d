"""Removal of repeated substrings, with column-wise construction over many short strings.

Every ``length``-byte string that also starts earlier in the collection is removed.  Inserting one symbol of
every document each round takes as many rounds as the longest document has bytes, so whole documents cannot be
the strings that are inserted.  They are first cut where equal strings cut alike:

1. The anchor of a window of ``length`` bytes is its leftmost minimal hash of ``gram`` bytes.  Windows in a row
   with one anchor form a block of less than ``2 * length`` bytes.  Equal windows have equal anchors at equal
   distances, so only blocks of one anchor can share a window.
2. Blocks of equal bytes are one class; all but the first are covered.  An anchor with one class needs no more.
3. First blocks of anchors with several classes go through column-wise construction: from the last column to
   the first, one symbol of each block is inserted per round, and the sorted order of the suffixes, whose
   preceding symbols are the collection's Burrows-Wheeler transform, and the lengths of common prefixes are
   updated in sequential passes.  Neighbours with a common prefix of ``length`` are equal windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm import lexical
from chronoweft.llm.ranking import parts_for, ranked
from chronoweft.llm.store import forget, settle

U = lexical.U
#: A place is document number * 2**bits + byte, with at least so many bits, and as many as the longest text needs.
PLACE_BITS = 28
#: Bytes of text whose blocks meet in one task.
BUCKET_BYTES = 24 << 20


@dataclass(frozen=True)
class Cut:
    length: int = 100
    gram: int = 32
    bits: int = PLACE_BITS

    @property
    def grams(self) -> int:
        """Grams of a window."""
        return self.length - self.gram + 1


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, in two passes over blocks of that width."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def blocks(buf: np.ndarray, offsets: np.ndarray, cut: Cut) -> tuple[np.ndarray, ...]:
    """Blocks of all texts: anchor hash, content hash, text number, first byte in the text, windows, anchor's distance from the first byte."""
    p = lexical.prefix_sums(buf)
    n = len(buf) - cut.gram + 1
    size = np.diff(offsets)
    if n <= 0 or not (size >= cut.length).any():
        return (np.zeros(0, U), np.zeros(0, U), *[np.zeros(0, np.int64)] * 4)
    at = np.arange(n)
    h = lexical.span_hashes(p, at, at + cut.gram)
    least = sliding_least((h & U(0xFFFFFFFF00000000)) | at.astype(U), cut.grams)
    # windows that lie in one text
    text = np.repeat(np.arange(len(size)), np.maximum(size - cut.length + 1, 0))
    count = np.maximum(size - cut.length + 1, 0)
    start = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + offsets[text]
    anchor = (least[start] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    windows = np.diff(np.append(head, len(start)))
    first, a = start[head], anchor[head]
    return h[a], lexical.span_hashes(p, first, first + windows + cut.length - 1), text[head], first - offsets[text[head]], windows, a - first


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as maximal ones, in order."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return start[head], reach[np.append(head[1:] - 1, len(start) - 1)]


_PACKED = [("ah", np.uint64), ("ch", np.uint64), ("place", np.int64), ("windows", np.uint8), ("shift", np.uint8)]


def _extract(cut: Cut, buckets: int):
    """Blocks of a batch of documents, packed by bucket; of equal blocks in the batch only the first, the others as covered spans."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            num = part.column("num").to_numpy()
            got: list[list[np.ndarray]] = [[] for _ in range(5)]
            for lo, _, buf, offsets in lexical.batches(part.column("text")):
                if (np.diff(offsets) >= 1 << cut.bits).any():
                    raise ValueError(f"a text of 2**{cut.bits} bytes or more")
                ah, ch, text, first, windows, shift = blocks(buf, offsets, cut)
                for k, x in enumerate((ah, ch, (num[lo + text] << cut.bits) + first, windows, shift)):
                    got[k].append(x)
            ah, ch, place, windows, shift = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in got)
            order = np.lexsort((place, ch, ah))
            ah, ch, place, windows, shift = (x[order] for x in (ah, ch, place, windows, shift))
            first = np.ones(len(ah), bool)
            first[1:] = (ah[1:] != ah[:-1]) | (ch[1:] != ch[:-1])
            start, end = merge_spans(place[~first], place[~first] + windows[~first] + cut.length - 1)
            bucket = (lexical.mix(ah[first]) % U(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            columns = [x[first][by] for x in (ah, ch, place, windows, shift)]
            out: dict[str, list] = {name: [] for name in ("bucket", *[n for n, _ in _PACKED], "start", "end")}
            # only the buckets that the batch has something for
            some, low = np.unique(bucket[by], return_index=True)
            for b, lo, hi in zip(some.tolist(), low, np.append(low, len(by))[1:], strict=True):
                out["bucket"].append(b)
                for (name, kind), x in zip(_PACKED, columns, strict=True):
                    out[name].append(x[lo:hi].astype(kind).tobytes())
                out["start"].append(b"")
                out["end"].append(b"")
            if len(start):
                # covered spans go with any bucket; there is one if there is a span
                own = int(num[0] % len(some))
                out["start"][own], out["end"][own] = start.astype(np.int64).tobytes(), end.astype(np.int64).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *[pa.array(v, pa.binary()) for k, v in out.items() if k != "bucket"]], names=list(out))

    return run


def _resolve(cut: Cut):
    """Classes of one bucket: covered spans (ah null), and first blocks of anchors with several classes."""

    def run(table: pa.Table) -> pa.Table:
        def whole(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(table[name].to_pylist()), kind)

        ah, ch, place, windows, shift = (whole(n, k) for n, k in _PACKED)
        order = np.lexsort((place, ch, ah))
        ah, ch, place, windows, shift = (x[order] for x in (ah, ch, place, windows, shift))
        head = np.ones(len(ah), bool)
        head[1:] = (ah[1:] != ah[:-1]) | (ch[1:] != ch[:-1])
        anew = np.ones(len(ah), bool)
        anew[1:] = ah[1:] != ah[:-1]
        anchor = np.cumsum(anew) - 1
        several = np.bincount(anchor[head], minlength=1)[anchor] > 1 if len(ah) else head
        start, end = merge_spans(np.concatenate((place[~head], whole("start", np.int64))), np.concatenate((place[~head] + windows[~head] + cut.length - 1, whole("end", np.int64))))
        pick = head & several
        n, m = len(start), int(pick.sum())
        return pa.table(
            {
                "num": pa.array(np.concatenate((start >> cut.bits, place[pick] >> cut.bits))),
                "at": pa.array(np.concatenate((start, place[pick])) & ((1 << cut.bits) - 1)),
                "bytes": pa.array(np.concatenate((end - start, windows[pick].astype(np.int64) + cut.length - 1))),
                "shift": pa.array(np.concatenate((np.zeros(n, np.int64), shift[pick].astype(np.int64)))),
                "ah": pa.array(np.concatenate((np.zeros(n, np.int64), ah[pick].view(np.int64))), mask=np.arange(n + m) < n),
            }
        )

    return run


def column_order(columns: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Insert the columns of a byte matrix (-1: no symbol) from last to first; after each: the column, the rows in order of their suffixes from there, and common prefixes with the row before (at most 255).

    A round sorts the rows, as they stand, by the symbol they get; equal symbols keep their order.  The common
    prefix of two neighbours with an equal symbol is one more than the least one between their old places.
    """
    n = len(columns)
    order, common = np.arange(n), np.zeros(n, np.uint8)
    for c in range(columns.shape[1] - 1, -1, -1):
        symbol = columns[order, c]
        by = np.argsort(symbol, kind="stable")
        least = [common]
        while 2 << len(least) - 1 <= n:
            half, low = 1 << len(least) - 1, least[-1]
            least.append(np.minimum(low[:-half], low[half:]))
        old, new = np.minimum(by[:-1], by[1:]) + 1, np.zeros(n, np.uint8)
        width = by[1:] - by[:-1]
        same = np.flatnonzero((symbol[by][1:] == symbol[by][:-1]) & (symbol[by][1:] >= 0))
        level = np.frexp(width[same])[1] - 1
        flat, base = np.concatenate(least), np.concatenate(([0], np.cumsum([len(x) for x in least])))
        left = flat[base[level] + old[same]]
        right = flat[base[level] + old[same] + width[same] - (1 << level)]
        new[same + 1] = np.minimum(np.minimum(left, right), 254) + 1
        order, common = order[by], new
        yield c, order, common


def _columns(cut: Cut):
    """Covered spans of one bucket's first blocks."""
    lead = cut.grams - 1

    def run(table: pa.Table) -> pa.Table:
        data = table["content"].combine_chunks()
        offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
        raw = np.frombuffer(data.buffers()[2], np.uint8)
        size, shift, place = np.diff(offsets), table["shift"].to_numpy(), table["place"].to_numpy()
        matrix = np.full((len(size), lead + cut.length), -1, np.int16)
        row = np.repeat(np.arange(len(size)), size)
        matrix[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + lead - shift[row]] = raw[offsets[0] : offsets[-1]]
        starts = []
        for c, order, common in column_order(matrix):
            if c > lead:
                continue
            equal = common >= cut.length
            if not equal.any():
                continue
            head = np.flatnonzero(~equal)
            at = place[order] + (c - (lead - shift[order]))
            earliest = np.repeat(np.minimum.reduceat(at, head), np.diff(np.append(head, len(at))))
            starts.append(at[at > earliest])
        at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        start, end = merge_spans(at, at + cut.length)
        return pa.table({"num": pa.array(start >> cut.bits), "at": pa.array(start & ((1 << cut.bits) - 1)), "bytes": pa.array(end - start)})

    return run


def _content(cut: Cut):
    """The bytes of the wanted blocks of each document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text").cast(pa.binary())
            out: list[tuple] = []
            for num, text, wanted in zip(part.column("num").to_pylist(), texts, part.column("wanted").to_pylist(), strict=True):
                text = text.as_buffer().to_pybytes()
                for w in wanted:
                    out.append((w["ah"], (num << cut.bits) + w["at"], w["shift"], text[w["at"] : w["at"] + w["bytes"]]))
                    if len(out) >= 50_000:
                        yield _rows(out)
                        out = []
            yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], names=["ah", "place", "shift", "content"])


def _apply(with_text: bool):
    """Counts and digest of each document after its spans are taken out."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text").cast(pa.binary())
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", *(["left"] * with_text))}
            for text, spans in zip(texts, part.column("spans"), strict=True):
                text = text.as_buffer().to_pybytes() if text.is_valid else b""
                left, start = text, np.zeros(0, np.int64)
                if spans.is_valid:
                    flat = spans.values.flatten()
                    start, end = merge_spans(flat[0].to_numpy(), flat[0].to_numpy() + flat[1].to_numpy())
                    edge = np.concatenate(([0], np.stack((start, end), axis=1).ravel(), [len(text)]))
                    left = b"".join(text[a:b] for a, b in edge.reshape(-1, 2))
                for k, v in (("n_bytes", len(text)), ("n_removed", len(text) - len(left)), ("n_spans", len(start)), ("kept_sha256", hashlib.sha256(left).hexdigest())):
                    out[k].append(v)
                if with_text:
                    out["left"].append(left.decode("utf-8", "ignore"))
            counts = [pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")]
            more = [pa.array(out["left"], pa.string())] if with_text else []
            rest = [n for n in part.schema.names if n not in ("num", "text", "spans")]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in rest], *counts, pa.array(out["kept_sha256"], pa.string()), *more], names=[*rest, *out])

    return run


def _numbered(docs: DataFrame, carry: list[str], bits: int) -> DataFrame:
    """num, doc_id, text and the carried columns; num follows doc_id (nulls last), then the text, and differs for every row."""
    held = docs.select("doc_id", "text", *[F.col(c).alias(f"_c_{c}") for c in carry])
    seen = held.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    if seen["n"] is None or (seen["n"] == 1 and not seen["nulls"] and seen["lo"] >= 0 and seen["hi"] < 1 << (62 - bits)):
        return held.withColumn("num", F.col("doc_id").cast("long"))
    return ranked(held.withColumn("_none", F.col("doc_id").isNull()), [], ["_none", "doc_id", "text"], "num", "numbered").drop("_none")


def remove_repeats(docs: DataFrame, cut: Cut = Cut(), carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:  # noqa: B008
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, ``carry``'s columns, and with ``with_text`` left, the text of the bytes that are left, without characters that a cut went through.

    A byte goes if any ``cut.length`` bytes over it also start earlier: in a document with a smaller doc_id, or
    earlier in its own.  A null text is empty; texts shorter than ``cut.length`` stay whole.  A null doc_id comes
    after all others, and rows that share one are ordered by their texts, so that of repeated rows one stays.
    Documents are at most 2**35, or 2**32 if a text comes near the 2**31 bytes of Spark's longest strings.  An empty table gives an empty result.
    """
    carry = list(carry)
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("total"), F.max(F.octet_length("text")).alias("longest")).first()
    cut = replace(cut, bits=max(PLACE_BITS, (size["longest"] or 0).bit_length()))
    if size["n"] > 1 << (63 - cut.bits):
        raise ValueError(f"more than 2**{63 - cut.bits} documents with texts of up to {size['longest']} bytes")
    rows = _numbered(docs, carry, cut.bits)
    buckets = max(parts_for(docs), -(-(size["total"] or 0) // BUCKET_BYTES))
    packed = rows.select("num", F.col("text")).mapInArrow(_extract(cut, buckets), "bucket int, ah binary, ch binary, place binary, windows binary, shift binary, start binary, end binary")
    first = settle(packed.groupBy("bucket").applyInArrow(_resolve(cut), "num long, at long, bytes long, shift long, ah long"), "blocks")
    wanted = first.filter(F.col("ah").isNotNull()).groupBy("num").agg(F.collect_list(F.struct("ah", "at", "shift", "bytes")).alias("wanted"))
    content = rows.select("num", "text").join(wanted, "num").mapInArrow(_content(cut), "ah long, place long, shift long, content binary")
    keyed = content.withColumn("bucket", F.pmod(F.xxhash64("ah"), F.lit(buckets)))
    more = settle(keyed.groupBy("bucket").applyInArrow(_columns(cut), "num long, at long, bytes long"), "columns")
    spans = first.filter(F.col("ah").isNull()).select("num", "at", "bytes").union(more)
    spans = spans.groupBy("num").agg(F.collect_list(F.struct("at", "bytes")).alias("spans"))
    kept = "".join(f"`_c_{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    out = rows.join(spans, "num", "left").select("doc_id", *[f"_c_{c}" for c in carry], "text", "spans")
    schema = f"doc_id long, {kept}n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", left string" * with_text
    return out.mapInArrow(_apply(with_text), schema).withColumnsRenamed({f"_c_{c}": c for c in carry})
