"""How the words of each source differ from the other sources and from the whole of their language.

Counting is a sort of pointers.  A task takes the texts of its Arrow batches as one buffer after another, points at
the start of every term, and sorts the pointers of each language by the terms they point at: a multikey quicksort
whose symbols are eight bytes, so that each pass sorts the slices that are equal so far by their next eight bytes and
goes on with those that are still equal and not at their end.  Runs of equal terms then give, for each source, how
often and in how many documents a term occurs there.

These are summed up over all tasks.  Everything after that is exact arithmetic on tables with a row for each term
and source at most; sums over pairs of sources are blocks of a dense product, which has terms against tiles of
sources.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.llm import lexical
from chronoweft.llm.store import settle

U = lexical.U
#: Bytes that are in no term: ASCII other than letters.
NO_TERM = np.ones(256, bool)
NO_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: The bytes of a symbol that belong to a term with 0 to 8 bytes left.
_WITHIN = np.array([0] + [(0xFFFFFFFFFFFFFFFF << (64 - 8 * k)) & 0xFFFFFFFFFFFFFFFF for k in range(1, 9)], U)


@dataclass(frozen=True)
class Audit:
    """A term is kept with ``documents`` documents of its language; ``scale`` parts make one; ``prior`` is added to every count; ``top`` terms are reported."""

    documents: int = 30
    scale: int = 1_000_000_000
    prior: int = 5
    top: int = 50
    #: Bytes of text whose pointers are sorted at once.
    shard: int = 8 << 20
    #: Sources in a tile, and least rows of terms in a block, of the sums over pairs; a block has four rows for each pair of sources in a tile at least.
    tile: int = 512
    block: int = 16_384
    #: Terms of a block that are dense at once.
    dense: int = 4096


def sorted_pointers(buf: np.ndarray, start: np.ndarray, end: np.ndarray, slices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the pointers, by slice and then by the bytes from start to end (none of them 0), and whether each differs from the one before."""
    symbols = np.ndarray(len(buf), ">u8", np.concatenate((buf, np.zeros(8, np.uint8))), strides=(1,))
    order = np.arange(len(start))
    new = np.ones(len(start), bool)
    part = np.argsort(slices, kind="stable")
    order, group, depth = order[part], slices[part], 0
    at = np.arange(len(order))
    while len(at):
        # ``at``: places in the order whose slice is still open; ``group``: the slice of each
        own = order[at]
        left = np.clip(end[own] - start[own] - depth, 0, 8)
        symbol = symbols[np.minimum(start[own] + depth, max(len(buf) - 1, 0))].astype(U) & _WITHIN[left]
        by = np.empty(len(at), np.int64)
        if depth == 0:
            edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                by[a:b] = a + np.argsort(symbol[a:b])
        else:
            by = np.lexsort((symbol, group))
        order[at], symbol, left = own[by], symbol[by], left[by]
        differs = np.ones(len(at), bool)
        differs[1:] = (symbol[1:] != symbol[:-1]) | (group[1:] != group[:-1])
        new[at] = differs
        group = np.cumsum(differs)
        # slices of one pointer, or whose terms end in this symbol, are done
        size = np.bincount(group)[group]
        open_ = (size > 1) & (left == 8)
        at, group, depth = at[open_], group[open_], depth + 8
    return order, new


def _counted(audit: Audit):
    """lang, source, term, count and documents of a task's shards; a row with an empty term has the documents of each source."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            pair = pa.StructArray.from_arrays([part.column("lang"), part.column("source")], names=["lang", "source"])
            lang_codes: dict[str, int] = {}
            pairs: dict[tuple, int] = {}
            codes = np.array([pairs.setdefault((p["lang"], p["source"]), len(pairs)) for p in pair.to_pylist()], np.int64)
            lang_of = np.array([lang_codes.setdefault(lang, len(lang_codes)) for lang, _ in pairs], np.int64)
            names = [pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)]
            seen = np.bincount(codes, minlength=len(pairs))
            zero = np.zeros(len(pairs), np.int64)
            yield pa.RecordBatch.from_arrays([*names, pa.array([""] * len(pairs)), pa.array(zero), pa.array(seen.astype(np.int64))], schema=schema)
            for lo, hi, raw, offsets in lexical.batches(part.column("text"), audit.shard):
                buf = lexical.FOLD[raw]
                start, end, text = lexical.word_spans(buf, offsets, NO_TERM)
                if not len(start):
                    continue
                own = codes[lo:hi]
                order, new = sorted_pointers(buf, start, end, lang_of[own][text])
                run_no = np.cumsum(new) - 1
                head = order[np.flatnonzero(new)]
                # a key for each run and document, then for each run and source
                key = np.sort((run_no << 32) | text[order])
                first = np.concatenate(([True], key[1:] != key[:-1]))
                each = np.diff(np.append(np.flatnonzero(first), len(key)))
                key = key[first]
                source = own[key & 0xFFFFFFFF]
                by = np.argsort(((key >> 32) << 32) | source, kind="stable")
                key, source, each = ((key >> 32) << 32 | source)[by], source[by], each[by]
                edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                n, docs = np.add.reduceat(each, edge), np.diff(np.append(edge, len(key)))
                shown, code = head[key[edge] >> 32], pa.array(source[edge])
                terms = lexical.strings(*lexical.joined(buf, start[shown], end[shown], np.arange(len(shown)), len(shown), b""))
                yield pa.RecordBatch.from_arrays([names[0].take(code), names[1].take(code), terms, pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))], schema=schema)

    return run


def term_counts(docs: DataFrame, audit: Audit = Audit()) -> DataFrame:  # noqa: B008
    """lang, source, term, n (occurrences) and docs (documents with it), and a row with term '' for the documents of each lang and source; nulls count as ''."""
    held = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    found = held.mapInArrow(_counted(audit), "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, terms: str, audit: Audit) -> str:
    """One more than the scaled share of a count with its prior, in whole numbers of 38 digits."""
    return f"1 + cast(({audit.scale} * (cast({count} as decimal(20, 0)) + {audit.prior})) div (cast({total} as decimal(20, 0)) + {audit.prior} * cast({terms} as decimal(20, 0))) as long)"


def _distances(audit: Audit):
    """Sums of absolute differences over one block of terms between the sources of two tiles, and the number of terms that these have in it."""

    def run(table: pa.Table) -> pa.Table:
        no, base, tile = table["no"].to_numpy(), table["base"].to_numpy(), table["own"].to_numpy()
        lang, a, b = (table[c][0].as_py() for c in ("lang", "tile_a", "tile_b"))
        # rows without a term are there once for each source
        marks = np.flatnonzero(table["term"].combine_chunks().is_null().to_numpy(zero_copy_only=False))
        real = table.filter(pc.is_valid(table["term"]))
        term, p, who, where = real["term"].combine_chunks().dictionary_encode().indices.to_numpy(), real["p"].to_numpy(), real["no"].to_numpy(), real["own"].to_numpy()
        order = np.argsort(term, kind="stable")
        term, p, who, where = term[order], p[order], who[order], where[order]
        known = int(term[-1]) + 1 if len(term) else 0
        sides = []
        for t in (a, b):
            own = marks[tile[marks] == t]
            own = own[np.argsort(no[own])]
            sides.append((t, no[own], base[own]))
        f = np.zeros((len(sides[0][1]), len(sides[1][1])), np.int64)
        for low in range(0, known, audit.dense):
            i, j = np.searchsorted(term, (low, low + audit.dense))
            width = min(audit.dense, known - low)
            dense = []
            for t, sources, least in sides:
                mine = np.flatnonzero(where[i:j] == t) + i
                block = np.repeat(least[:, None], width, axis=1)
                block[np.searchsorted(sources, who[mine]), term[mine] - low] = p[mine]
                dense.append(block)
            for k, row in enumerate(dense[0]):
                f[k] += np.abs(row[None, :] - dense[1]).sum(axis=1)
        left, right = np.repeat(sides[0][1], f.shape[1]), np.tile(sides[1][1], f.shape[0])
        both = [(left, right, f.ravel())] + [(right, left, f.ravel())] * (a != b)
        left, right, f = (np.concatenate(x) for x in zip(*both, strict=True))
        return pa.table({"lang": pa.array([lang] * len(f), pa.string()), "left": pa.array(left, pa.int64()), "right": pa.array(right, pa.int64()), "part": pa.array(f, pa.int64()), "seen": pa.array(np.full(len(f), known), pa.int64())})

    return run


def audit_sources(docs: DataFrame, audit: Audit = Audit()) -> DataFrame:  # noqa: B008
    """lang, source, part, item, value and rank (from 1 by value descending and item ascending, for each lang, source and part).

    Part ``pair`` has every other source of the language, with the sum over the language's kept terms of the
    absolute difference of their scaled shares; part ``term`` the ``top`` kept terms of a source whose share is
    above that in the whole language, with the difference.  Null text, lang and source are ''.  A source without
    terms has the shares that the prior alone gives; a language without kept terms has pairs of value 0 and no
    terms.  Repeated rows are documents of their own; an empty table gives an empty result.  Shares are exact up to
    counts of 20 digits.  The pairs are as many as the result has to hold, and grow with the square of the number
    of sources in a language, not with the documents.
    """
    counts = settle(term_counts(docs, audit), "term-counts")
    terms = counts.filter("term <> ''")
    kept = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= audit.documents).drop("docs")
    # one row for each kept term and source that has it
    held = settle(terms.select("lang", "term", "source", "n").join(kept, ["lang", "term"]), "kept-terms")
    by_lang = held.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    by_source = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    blocks = by_source.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.sum("rows") / F.greatest(F.lit(audit.block), 4 * F.pow(F.least(F.count(F.lit(1)), F.lit(audit.tile)), 2)))).cast("int").alias("blocks"))
    groups = counts.filter("term = ''").select("lang", "source").join(by_lang, "lang", "left").join(blocks, "lang", "left").join(by_source.drop("rows"), ["lang", "source"], "left").na.fill(0, ["terms", "lang_total", "total"]).na.fill(1, ["blocks"])
    order = Window.partitionBy("lang").orderBy("source")
    base = _share("0", "total", "terms", audit)
    # a row for each lang and source
    groups = groups.withColumn("no", F.row_number().over(order).cast("long") - 1).withColumn("base", F.expr(f"case when terms > 0 then {base} else 0 end"))
    groups = settle(groups.withColumn("own", F.expr(f"no div {audit.tile}")), "sources")
    rows = held.join(groups, ["lang", "source"]).withColumn("p", F.expr(_share("n", "total", "terms", audit)))

    # pairs: each block of terms meets every pair of tiles once, with a row without term for each source
    last = groups.groupBy("lang").agg(F.max("own").alias("last"))
    marks = groups.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).select("lang", F.lit(None).cast("string").alias("term"), "no", "own", "base", F.lit(None).cast("long").alias("p"), "block")
    spread = rows.select("lang", "term", "no", "own", "base", "p", F.expr("cast(pmod(xxhash64(term), blocks) as int)").alias("block")).unionByName(marks)
    spread = spread.join(last, "lang").withColumn("other", F.explode(F.expr("sequence(0L, last)"))).withColumns({"tile_a": F.least("own", "other"), "tile_b": F.greatest("own", "other")})
    parts = spread.groupBy("lang", "block", "tile_a", "tile_b").applyInArrow(_distances(audit), "lang string, left long, right long, part long, seen long")
    sums = parts.filter(F.col("left") != F.col("right")).groupBy("lang", "left", "right").agg(F.sum("part").alias("part"), F.sum("seen").alias("seen"))
    one = groups.select("lang", F.col("no").alias("left"), "source", "terms", F.col("base").alias("_base"))
    two = groups.select("lang", F.col("no").alias("right"), F.col("source").alias("item"), F.col("base").alias("_other"))
    # terms that neither source has
    rest = (F.col("terms") - F.col("seen")) * F.abs(F.col("_base") - F.col("_other"))
    pairs = sums.join(one, ["lang", "left"]).join(two, ["lang", "right"]).select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("part") + rest).alias("value"))

    above = rows.withColumn("q", F.expr(_share("lang_n", "lang_total", "terms", audit))).filter("p > q")
    best = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    # as many rows as a language has sources, or kept terms
    top = best.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= audit.top)
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(top)


#: The query in DuckDB's SQL.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM t GROUP BY ALL),
    k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
    g AS (SELECT DISTINCT lang, source FROM d),
    v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
    e AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n::HUGEINT AS lang_n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM e GROUP BY ALL),
    p AS (SELECT e.lang, e.source, e.term, e.n, 1 + (1000000000 * (e.n + 5)) // (s.total + 5 * v.v) AS p,
        1 + (1000000000 * (e.lang_n + 5)) // (v.n::HUGEINT + 5 * v.v) AS q FROM e JOIN s USING (lang, source) JOIN v USING (lang)),
    x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
        UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM y)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""
