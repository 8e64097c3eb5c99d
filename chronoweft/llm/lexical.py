"""Words and hashes of many texts at once, in NumPy over their UTF-8 bytes.

A word is a run of bytes other than space and 0x09 to 0x0D; those bytes never occur inside a multi-byte
character.  Hashes are 64 bits, the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
CONTINUES = (np.arange(256) & 0xC0) == 0x80
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: A fixed odd multiplier, its inverse modulo 2**64, and a fixed random number for each byte value.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 2**64)
_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, U)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if len(known) <= 1 << 22:
            _POWERS[base] = known
    return known[:n]


def prefix_sums(buf: np.ndarray, fold: bool = False) -> np.ndarray:
    """p with p[j] - p[i] = the sum of code(buf[k]) * BASE**k over i <= k < j, modulo 2**64."""
    codes = _CODES[FOLD] if fold else _CODES
    p = np.zeros(len(buf) + 1, U)
    np.cumsum(codes[buf] * powers(BASE, len(buf)), out=p[1:])
    return p


def span_hashes(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, whatever its place in the buffer."""
    inverse = powers(_INVERSE, len(p))
    return mix((p[end] - p[start]) * inverse[start] + (end - start).astype(U))


def batches(column: pa.ChunkedArray | pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``most`` bytes: first row, last row + 1, their bytes, and where each starts (one more at the end). A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, len(column))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(buf: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; ``outside`` tells which bytes are in none."""
    inside = ~outside[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | cut[:-1])) if len(buf) else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | cut[1:])) + 1 if len(buf) else np.zeros(0, np.int64)
    return start, end, np.searchsorted(offsets, start, "right") - 1


def windows(word_hash: np.ndarray, text_no: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first word and hash of every run of ``size`` words in one text."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.flatnonzero(text_no[:n] == text_no[size - 1 :])
    h = np.zeros(len(at), U)
    for k in range(size):
        h = h * U(BASE) + word_hash[at + k]
    return at, mix(h)


def joined(buf: np.ndarray, start: np.ndarray, end: np.ndarray, text_no: np.ndarray, texts: int, between: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the spans of each text, in the order given, with ``between`` (one byte or none) between two of one text; where each text begins (one more at the end)."""
    size = end - start
    if between and len(size):
        size = size + np.append(text_no[1:] == text_no[:-1], False)
    to = np.cumsum(size)
    total = int(to[-1]) if len(to) else 0
    edges = np.concatenate(([0], to))[np.searchsorted(text_no, np.arange(texts + 1))]
    source = np.arange(total) + np.repeat(start - to + size, size)
    out = buf[np.minimum(source, len(buf) - 1)] if total else buf[:0]
    if between and len(size):
        out[to[size > end - start] - 1] = between[0]
    return out, edges


def strings(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """An Arrow array of the strings that lie between the edges."""
    return pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the bytes' flags over each text."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]
