"""Periodic runs of words, by a suffix automaton whose suffix tree remembers last occurrences.

The words of a text are appended one by one.  The suffix links of the automaton form a tree; every state on the
way from a prefix's state to the root is a suffix of that prefix.  Each state has the place where it last ended as
its colour, and states of one colour that follow each other on a way to the root form a path of a link-cut tree.
Appending a word walks up from the new state over such paths: a path of colour e whose deepest state has length l
says that the longest common suffix of the prefixes up to here and up to e is l, so that the words since e - l have
period d = here - e.  That is a square if l >= d, and its left end cannot be extended; the walk recolours all the
way to the new place, which costs O(log n) paths a word, amortised.  Squares of one left end and period belong to
one run, whose end is the last place that finds it.

Only stretches that can hold a run are appended: all words of a run, and more, lie in windows of a few words that
occur again at most a period further on, and such windows are found by hashes of a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm import lexical

U = lexical.U


@dataclass(frozen=True)
class Runs:
    """A run: at least ``least`` words and ``ratio`` (2 or more) of its smallest period."""

    least: int = 6
    ratio: int = 4

    @property
    def window(self) -> int:
        """Words of a window that every run holds again one period later, whatever the period."""
        return min(max(self.least, self.ratio * q) - q for q in range(1, self.least // self.ratio + 2))


def runs_of(words: list[int], rule: Runs) -> list[tuple[int, int, int]]:
    """start, length and smallest period of every run of a sequence, by start and period."""
    # states: 0 is none, 1 the root; of the automaton
    moves: list[dict[int, int]] = [{}, {}]
    size, link = [0, 0], [0, 0]
    # of the link-cut tree: children in the splay tree of a path, parent there or of the path, colour at the tree's root
    left, right, up, colour = [0, 0], [0, 0], [0, 0], [-1, -1]

    def splay(x: int) -> None:
        while True:
            p = up[x]
            if not p:
                return
            if left[p] == x:
                on_left = True
            elif right[p] == x:
                on_left = False
            else:
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                turn(p if (left[g] == p) == on_left else x)
            turn(x)

    def turn(x: int) -> None:
        p = up[x]
        g = up[p]
        if left[p] == x:
            inner = right[x]
            left[p], right[x] = inner, p
        else:
            inner = left[x]
            right[p], left[x] = inner, p
        if inner:
            up[inner] = p
        up[p], up[x] = x, g
        if g and left[g] == p:
            left[g] = x
        elif g and right[g] == p:
            right[g] = x
        else:
            colour[x] = colour[p]

    def state(length: int, to: dict[int, int]) -> int:
        moves.append(to)
        size.append(length)
        for of in (link, left, right, up):
            of.append(0)
        colour.append(-1)
        return len(size) - 1

    found: dict[tuple[int, int], int] = {}
    times, least, last = rule.ratio - 1, rule.least, 1
    for here, word in enumerate(words):
        new = state(here + 1, {})
        p = last
        while p and word not in moves[p]:
            moves[p][word] = new
            p = link[p]
        if not p:
            parent = 1
        else:
            parent = q = moves[p][word]
            if size[p] + 1 != size[q]:
                # the shorter suffixes of q get a state of their own, above q on its path
                parent = state(size[p] + 1, dict(moves[q]))
                splay(q)
                over = left[q]
                left[parent], right[parent], up[parent], colour[parent] = over, q, up[q], colour[q]
                if over:
                    up[over] = parent
                left[q], up[q] = 0, parent
                link[parent], link[q] = link[q], parent
                while p and moves[p].get(word) == q:
                    moves[p][word] = parent
                    p = link[p]
        link[new] = up[new] = parent
        x, u = new, parent
        while u:
            splay(u)
            end, common = colour[u], size[u]
            period = here - end
            if common >= times * period and common + period >= least:
                found[end - common + 1, period] = here
            deeper = right[u]
            if deeper:
                colour[deeper] = end
            right[u] = x
            x, u = u, up[u]
        colour[x] = here
        splay(new)
        last = new
    return sorted((start, end + 1 - start, period) for (start, period), end in found.items())


def _stretches(hashes: np.ndarray, text: np.ndarray, rule: Runs) -> tuple[np.ndarray, np.ndarray]:
    """First word and last word + 1 of the stretches outside which no run has a word.

    A run of period q repeats all its windows at a distance of q, a ``ratio``-th of the run's length at most.  So
    windows without an equal one in the same text go, and then those whose nearest equal is further away than a
    ``ratio``-th of the stretch that is left around them.
    """
    n = len(hashes)
    at, h = lexical.windows(hashes, text, rule.window)
    h = lexical.mix(h + text[at].astype(U) * U(lexical.BASE))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    near = np.full(len(at), n, np.int64)
    gap = at[order][1:][same] - at[order][:-1][same]
    near[order[1:][same]] = gap
    np.minimum.at(near, order[:-1][same], gap)
    keep = near < n
    first = last = np.zeros(0, np.int64)
    for _ in range(2):
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, at[keep], 1)
        np.add.at(step, at[keep] + rule.window, -1)
        # a stretch ends at the end of its text
        inside = np.concatenate(([0], (np.cumsum(step[:-1]) > 0).astype(np.int8), [0]))
        cut = np.concatenate(([True], text[1:] != text[:-1], [True])) if n else np.zeros(1, bool)
        first = np.flatnonzero((inside[1:] > 0) & ((inside[:-1] == 0) | cut)[: n + 1])
        last = np.flatnonzero((inside[:-1] > 0) & ((inside[1:] == 0) | cut))
        if not len(first):
            break
        own = np.maximum(np.searchsorted(first, at, "right") - 1, 0)
        keep &= near * rule.ratio <= (last - first)[own]
    long = last - first >= rule.least
    return first[long], last[long]


def _batch(buf: np.ndarray, offsets: np.ndarray, rule: Runs) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Number of words, runs and text without repeated words of each text."""
    texts = len(offsets) - 1
    start, end, text = lexical.word_spans(buf, offsets)
    hashes = lexical.span_hashes(lexical.prefix_sums(buf), start, end)
    n_words = np.bincount(text, minlength=texts)
    before = np.cumsum(n_words) - n_words
    raw, rows, whose = buf.tobytes(), [], []
    dropped = np.zeros(len(start) + 1, np.int64)
    for a, b in zip(*_stretches(hashes, text, rule), strict=True):
        codes: dict[bytes, int] = {}
        words = [codes.setdefault(raw[i:j], len(codes)) for i, j in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
        for s, length, period in runs_of(words, rule):
            rows.append((a + s - before[text[a]], length, period))
            whose.append(text[a])
            dropped[a + s + period] += 1
            dropped[a + s + length] -= 1
    kept = np.cumsum(dropped[:-1]) == 0
    fields = np.array(rows, np.int64).reshape(-1, 3)
    runs = pa.StructArray.from_arrays([pa.array(fields[:, k]) for k in range(3)], names=["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(np.array(whose, np.int64), np.arange(texts + 1)).astype(np.int32)), runs)
    return n_words, lists, lexical.strings(*lexical.joined(buf, start[kept], end[kept], text[kept], texts))


def periodic_runs(docs: DataFrame, rule: Runs = Runs(), carry: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """One row per document: doc_id, n_words, runs, collapsed and the columns of ``carry``.

    Words are runs of characters other than space and 0x09 to 0x0D, numbered from 0.  ``runs`` has start, length and
    period of every stretch that has smallest period ``period``, is long enough by ``rule`` and cannot be extended
    by a neighbouring word, by start and then period.  ``collapsed`` has the words, joined by one space, without
    those that lie in a run after its first ``period`` words.  A null or empty text has no words, no runs and an
    empty ``collapsed``.  Rows are judged by themselves, so repeated and null ids make no difference; no row is
    shuffled.  A task holds about a MB of text at once, or one text if that is longer, and the automaton of one
    stretch (a few hundred bytes for each of its words).
    """
    held = docs.select("doc_id", "text", *[F.col(c).alias(f"_c_{c}") for c in carry])
    carried = [f for f in held.schema.fields if f.name.startswith("_c_")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, hi, buf, offsets in lexical.batches(part.column("text")):
                n_words, runs, collapsed = _batch(buf, offsets, rule)
                own = [part.column(n).slice(lo, hi - lo) for n in ("doc_id", *[f.name for f in carried])]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n_words.astype(np.int64)), runs, collapsed], names=["doc_id", *[f.name for f in carried], "n_words", "runs", "collapsed"])

    schema = f"doc_id {held.schema['doc_id'].dataType.simpleString()}" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in carried)
    out = held.mapInArrow(run, schema + ", n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnsRenamed({f"_c_{c}": c for c in carry})


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where texts of a tenth of the ids end in a repetition.

    With h the CRC32 of the decimal id, g = h div 10 and n > 0 words, texts with h mod 10 = 0 have the words from
    a = g mod n on replaced by repetitions of the p = 1 + (n - a) div (3 + g mod 8) words there, and their words
    joined by one space.  A null id or text stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("_h"))
    rows = rows.withColumn("_w", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    rows = rows.withColumn("_n", F.when(F.size("_w") > 0, F.size("_w")))
    rows = rows.withColumn("_a", F.expr("cast((_h div 10) % _n as int)"))
    rows = rows.withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + (_h div 10) % 8) as int)"))
    again = F.expr("array_join(concat(slice(_w, 1, _a), transform(sequence(0, _n - 1 - _a), k -> get(_w, _a + k % _p))), ' ')")
    return rows.select("doc_id", F.when(F.col("_n").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period; no run: nulls), and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.withColumn("_b", best)
    length, period = F.col("_b.length"), -F.col("_b.period")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_b.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * _b.length div -_b.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
