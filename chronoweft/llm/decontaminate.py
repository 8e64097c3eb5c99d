"""Benchmark passages in documents, by suffix arrays of the documents.

A task cuts its documents into shards of a few MB and builds the suffix array of each over its words: pointers to
every word, sorted by the words from there on.  Doubling gives it: pointers are sorted by their first word, then by
two, four, eight words, each time only where several are still equal, and the number of words that a benchmark
window has is where it stops.  Words are ordered by a 64-bit hash, the same everywhere.  Every suffix of an item that
has a window is then searched for in every shard by bisection, all of them at once; the pointers between its two
bounds are where it occurs.  Occurrences that follow each other in both texts are one match, which so is the longest
verbatim one around its place.

The windows are sent to the tasks in blocks of a bounded size, and there is one pass over the documents for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft.llm import lexical
from chronoweft.llm.store import settle

U = lexical.U
#: Bytes that are in no word: ASCII other than digits and letters.
NO_WORD = np.ones(256, bool)
NO_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Bytes of text in a suffix array.
SHARD_BYTES = 4 << 20
#: Windows that are sent to the tasks at once, about 100 bytes each.
BLOCK_WINDOWS = 200_000


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word, ASCII letters lower-cased."""
    buf = lexical.FOLD[raw]
    start, end, text = lexical.word_spans(buf, offsets, NO_WORD)
    return lexical.span_hashes(lexical.prefix_sums(buf), start, end), text


def suffix_array(h: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Places of words in the order of the ``depth`` words from there; ``left`` has how many there are to the end of the text."""
    n = len(h)
    order = np.argsort(h)
    new = np.ones(n + 1, bool)
    new[1:n] = h[order][1:] != h[order][:-1]
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new[:n], slots, 0))
    # slots of pointers that are equal to others so far
    slots, have = slots[~(new[:-1] & new[1:])], 1
    while have < depth and len(slots):
        step = min(have, depth - have)
        own = order[slots]
        key = (rank[own] << 32) | np.where(left[own] > step, rank[np.minimum(own + step, n - 1)] + 1, 0)
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[slots] = own
        new = np.ones(len(slots) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        rank[own] = np.maximum.accumulate(np.where(new[:-1], slots, 0))
        slots, have = slots[~(new[:-1] & new[1:])], have + step
    return order


@dataclass(frozen=True)
class Windows:
    """Different windows: hashes of their words (a row each), number of words, and where each stands from ``first`` on: item, its id, and word in it."""

    hashes: np.ndarray
    size: np.ndarray
    first: np.ndarray
    item: np.ndarray
    item_id: pa.Array
    item_at: np.ndarray

    @staticmethod
    def of(rows: pa.Table, depth: int) -> Windows:
        """From rows of item, item_id, item_at and hashes."""
        lists = rows["hashes"].combine_chunks()
        size = np.diff(lists.offsets.to_numpy().astype(np.int64))
        flat = lists.flatten().to_numpy().view(U)
        every = np.zeros((len(size), depth + 1), U)
        row = np.repeat(np.arange(len(size)), size)
        every[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        every[:, depth] = size
        kinds, which = np.unique(every, axis=0, return_inverse=True) if len(size) else (every, np.zeros(0, np.int64))
        by = np.argsort(which.ravel(), kind="stable")
        first = np.searchsorted(which.ravel()[by], np.arange(len(kinds) + 1))
        return Windows(kinds[:, :depth], kinds[:, depth].astype(np.int64), first, rows["item"].to_numpy()[by], rows["item_id"].combine_chunks().take(pa.array(by)), rows["item_at"].to_numpy()[by])

    def _bound(self, h: np.ndarray, left: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, after: bool) -> np.ndarray:
        """First slot from which on suffixes are not below each window, or with ``after`` above it."""
        lo, hi = lo.copy(), hi.copy()
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            middle = (lo[todo] + hi[todo]) // 2
            at = order[middle]
            below = np.full(len(todo), after)
            open_ = np.arange(len(todo))
            for k in range(self.hashes.shape[1]):
                open_ = open_[self.size[todo[open_]] > k]
                if not len(open_):
                    break
                ended = left[at[open_]] <= k
                mine, theirs = h[np.minimum(at[open_] + k, len(h) - 1)], self.hashes[todo[open_], k]
                below[open_[ended | (mine < theirs)]] = True
                below[open_[~ended & (mine > theirs)]] = False
                open_ = open_[~ended & (mine == theirs)]
            lo[todo[below]] = middle[below] + 1
            hi[todo[~below]] = middle[~below]
            todo = todo[lo[todo] < hi[todo]]
        return lo

    def find(self, h: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and window of every occurrence in a shard."""
        order = suffix_array(h, left, self.hashes.shape[1])
        sorted_first = h[order]
        lo, hi = (np.searchsorted(sorted_first, self.hashes[:, 0], side) for side in ("left", "right"))
        lo, hi = self._bound(h, left, order, lo, hi, False), self._bound(h, left, order, lo, hi, True)
        count = hi - lo
        window = np.repeat(np.arange(len(count)), count)
        return order[np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + lo[window]], window


def _chained(text: np.ndarray, item: np.ndarray, item_at: np.ndarray, at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matches that touch or overlap at equal distance in one text and item become one, by text, place, item and place there: text, a row that it begins with, and its words."""
    shift = at - item_at
    by = np.lexsort((at, shift, item, text))
    new = np.ones(len(at), bool)
    new[1:] = (text[by][1:] != text[by][:-1]) | (item[by][1:] != item[by][:-1]) | (shift[by][1:] != shift[by][:-1]) | (at[by][1:] > (at + words)[by][:-1])
    head = np.flatnonzero(new)
    # on one diagonal ends grow with starts
    end = (at + words)[by][np.append(head[1:], len(at)) - 1] if len(at) else at
    row = by[head]
    length = end - at[row]
    by = np.lexsort((item_at[row], item[row], at[row], text[row]))
    return text[row][by], row[by], length[by]


def _matches(texts: int, text: np.ndarray, item: np.ndarray, item_id: pa.Array, item_at: np.ndarray, at: np.ndarray, words: np.ndarray) -> pa.Array:
    """The chained matches of each text as a list."""
    own, row, length = _chained(text, item, item_at, at, words)
    fields = [pa.array(item[row]), item_id.take(pa.array(row)), pa.array(item_at[row]), pa.array(at[row]), pa.array(length)]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(texts + 1)).astype(np.int32)), pa.StructArray.from_arrays(fields, names=["item", "item_id", "item_at", "at", "words"]))


def _search(held, others: list[str]):
    """n_words and matches of each document, with the windows of one block."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = held.value
        for part in parts:
            for lo, hi, raw, offsets in lexical.batches(part.column("text"), SHARD_BYTES):
                h, text = words_of(raw, offsets)
                n_words = np.bincount(text, minlength=hi - lo)
                until = np.cumsum(n_words)
                none = np.zeros(0, np.int64)
                where, window = windows.find(h, until[text] - np.arange(len(h))) if len(h) and len(windows.size) else (none, none)
                # every window stands in an item or more
                stands = windows.first[window + 1] - windows.first[window] if len(window) else none
                row = np.repeat(np.arange(len(window)), stands)
                entry = np.arange(len(row)) - np.repeat(np.cumsum(stands) - stands, stands) + (windows.first[window[row]] if len(row) else none)
                place = where[row]
                own = text[place]
                lists = _matches(hi - lo, own, windows.item[entry], windows.item_id.take(pa.array(entry)), windows.item_at[entry], place - (until - n_words)[own], windows.size[window[row]])
                yield pa.RecordBatch.from_arrays([*[part.column(n).slice(lo, hi - lo) for n in others], pa.array(n_words.astype(np.int64)), lists], names=[*others, "_n_words", "_found"])

    return run


def _rechained(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of several blocks, chained across them."""
    for part in parts:
        lists = part.column("_found")
        edges = lists.offsets.to_numpy()
        flat = lists.flatten()
        text = np.repeat(np.arange(len(lists)), np.diff(edges))
        again = _matches(len(lists), text, flat.field("item").to_numpy(), flat.field("item_id"), *[flat.field(n).to_numpy() for n in ("item_at", "at", "words")])
        yield pa.RecordBatch.from_arrays([part.column("_num"), again], names=["_num", "_found"])


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """item, item_id, item_at and hashes of every window of ``size`` words; of a shorter text with words, all of them. ``items``: item (a number), item_id and text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, hi, raw, offsets in lexical.batches(part.column("text")):
                h, text = words_of(raw, offsets)
                n = np.bincount(text, minlength=hi - lo)
                before = np.cumsum(n) - n
                count = np.where(n, np.maximum(n - size + 1, 1), 0)
                own = np.repeat(np.arange(hi - lo), count)
                at = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                width = np.minimum(n[own], size)
                first = before[own] + at
                edges = np.concatenate(([0], np.cumsum(width)))
                flat = h[np.arange(edges[-1]) - np.repeat(edges[:-1] - first, width)]
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.view(np.int64)))
                ids = [part.column(c).slice(lo, hi - lo).take(pa.array(own)) for c in ("item", "item_id")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(at), lists], names=["item", "item_id", "item_at", "hashes"])

    return items.select("item", "item_id", "text").mapInArrow(run, f"item long, item_id {items.schema['item_id'].dataType.simpleString()}, item_at long, hashes array<long>")


def _passages(docs: DataFrame, items: DataFrame, size: int, carry: tuple[str, ...], block: int) -> DataFrame:
    """doc_id, _n_words, _found (null or empty: none) and _c_ with the columns of ``carry``."""
    spark = docs.sparkSession
    numbered = settle(items.select("item_id", "text"), "items", numbered="item")
    windows = settle(windows_of(numbered, size), "windows")
    blocks = max(1, -(-windows.count() // block))
    held = docs.select("doc_id", "text", *[F.col(c).alias(f"_c_{c}") for c in carry])
    if blocks > 1:
        held = settle(held, "documents", numbered="_num")
    others = [f.name for f in held.schema.fields if f.name != "text"] if blocks == 1 else ["_num"]
    kinds = "".join(f"`{n}` {held.schema[n].dataType.simpleString()}, " for n in others)
    listed = f"_found array<struct<item: long, item_id: {items.schema['item_id'].dataType.simpleString()}, item_at: long, at: long, words: long>>"
    found = None
    for k in range(blocks):
        # the windows of one block: a bounded number
        mine = windows.filter(F.pmod(F.xxhash64("item", F.expr("item_at div 1024")), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast(Windows.of(mine.toArrow(), size))
        part = held.mapInArrow(_search(sent, others), f"{kinds}_n_words long, {listed}")
        found = part if found is None else found.union(part)
    if blocks > 1:
        found = settle(found, "passages")
        every = found.filter(F.size("_found") > 0).groupBy("_num").agg(F.flatten(F.collect_list("_found")).alias("_found"))
        counts = found.groupBy("_num").agg(F.first("_n_words").alias("_n_words"))
        found = held.drop("text").join(counts, "_num").join(every.mapInArrow(_rechained, f"_num long, {listed}"), "_num", "left")
    return found


def find_passages(docs: DataFrame, items: DataFrame, size: int = 10, carry: tuple[str, ...] = (), block: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, matches and the columns of ``carry``.

    Words are runs of ASCII digits and letters and of other characters from U+0080 on, ASCII letters lower-cased;
    what stands between words makes no difference.  ``matches`` has item_id, item_at, at and words of every longest
    verbatim match of at least ``size`` words, or of a whole item with fewer but not none: ``words`` words from
    ``at`` in the document and ``item_at`` in the item.  Words are compared by 64-bit hashes.  A null or empty text
    has no words and no matches.  Repeated rows, null ids and other columns make no difference; items that share an
    id are items of their own in ``matches``.  Without items nothing matches.

    ``items`` with more than ``block`` windows take one pass over the documents for each block of them.
    """
    found = _passages(docs, items, size, carry, block)
    plain = F.transform("_found", lambda m: F.struct(m["item_id"].alias("item_id"), m["item_at"].alias("item_at"), m["at"].alias("at"), m["words"].alias("words")))
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.coalesce(plain, F.array()).alias("matches"), *[F.col(f"_c_{c}").alias(c) for c in carry])


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The documents without a match, as find_passages tells, with all their columns."""
    found = _passages(docs, items, size, tuple(docs.columns), BLOCK_WINDOWS)
    return found.filter(F.coalesce(F.size("_found"), F.lit(0)) <= 0).select([F.col(f"_c_{c}").alias(c) for c in docs.columns])


def hit_words(matches: Column) -> Column:
    """Number of words that lie in a match (matches: by place)."""
    start = F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("n"))

    def add(so_far: Column, m: Column) -> Column:
        end = m["at"] + m["words"]
        more = F.greatest(F.lit(0).cast("long"), end - F.greatest(m["at"], so_far["reach"]))
        return F.struct(F.greatest(so_far["reach"], end).alias("reach"), (so_far["n"] + more).alias("n"))

    return F.aggregate(matches, start, add, lambda x: x["n"])


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit (words in a match), n_items (different ids, without null), their digest as sorted strings, and whether any word is hit."""
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"].cast("string")), lambda x: x.isNotNull())))
    n_hit = hit_words(F.col("matches"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("matches") > 0).alias("contaminated")
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The query in DuckDB's SQL.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
    i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    k AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0),
    x AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS x FROM k),
    s AS (SELECT DISTINCT n FROM x),
    u AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k, len(w) AS total FROM d),
    p AS (SELECT r, k, total - k + 1 AS here, [word, {", ".join(f"lead(word, {j}) OVER o" for j in range(1, 10))}] AS ws FROM u WINDOW o AS (PARTITION BY r ORDER BY k)),
    h AS (SELECT r, k, n, item_id FROM (SELECT r, k, n, array_to_string(ws[1:n], ' ') AS x FROM p JOIN s ON n <= here) JOIN x USING (n, x)),
    c AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM h) GROUP BY r),
    g AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN g USING (r)
"""
