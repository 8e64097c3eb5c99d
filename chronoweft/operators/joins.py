"""Range, nearest and as-of joins within a recording.

A join on ranges alone would compare every pair of a recording.  Here a range lies in the buckets of its own level,
whose width is the next power of two, so that it touches two or three of them however long it is; a point looks
into its bucket of every level that its recording has, and the join is on recording, level and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "rec_id"


def _bucket(x: Column, width: float | Column) -> Column:
    return F.floor(x / (width if isinstance(width, Column) else F.lit(width))).cast("long")


def _near(points: DataFrame, ranges: DataFrame, at: str, span: tuple[str, str], slack: float = 0) -> DataFrame:
    """Points with all ranges that hold them, and some others nearby; each pair once."""
    low, high = F.col(span[0]) - F.lit(slack), F.col(span[1]) + F.lit(slack)
    width = F.pow(F.lit(2.0), F.col("_level"))
    levels = ranges.withColumn("_level", F.ceil(F.log2(F.greatest((high - low).cast("double"), F.lit(2.0**-10)))))
    laid = levels.withColumn("_bucket", F.explode(F.sequence(_bucket(low, width), F.greatest(_bucket(high, width), _bucket(low, width)))))
    # at most a few dozen levels a recording
    looks = points.join(levels.select(KEY, "_level").distinct(), KEY).withColumn("_bucket", _bucket(F.col(at), width))
    return looks.join(laid, [KEY, "_level", "_bucket"]).drop("_level", "_bucket")


def overlap(left: DataFrame, right: DataFrame, ls: tuple[str, str], rs: tuple[str, str], closed: bool = False) -> DataFrame:
    """Pairs of one recording whose ranges overlap (with ``closed``, or touch). Columns of both; those of ``right`` must have other names, save the key.

    Of two ranges that overlap, one starts inside the other.
    """
    meets = (F.col(ls[0]) <= F.col(rs[1])) & (F.col(ls[1]) >= F.col(rs[0])) if closed else (F.col(ls[0]) < F.col(rs[1])) & (F.col(ls[1]) > F.col(rs[0]))
    later = _near(left, right, ls[0], rs).filter(meets & (F.col(ls[0]) >= F.col(rs[0])))
    earlier = _near(right, left, rs[0], ls).filter(meets & (F.col(ls[0]) < F.col(rs[0])))
    return later.unionByName(earlier)


def within(points: DataFrame, ranges: DataFrame, at: str, test: tuple[Column, Column], span: tuple[str, str], slack: float) -> DataFrame:
    """Points with the ranges that hold them: test[0] <= point < test[1]. ``span`` names the range's columns and ``slack`` how far the test goes beyond them."""
    return _near(points, ranges, at, span, slack).filter((F.col(at) >= test[0]) & (F.col(at) < test[1]))


def in_ranges(points: DataFrame, ranges: DataFrame, at: str = "t", slack: float = 1e-6) -> DataFrame:
    """Points in any range (start inclusive, end exclusive, both less ``slack``); equal points each stay."""
    order = Window.partitionBy(KEY).orderBy("_s", "_e")
    spans = ranges.select(KEY, (F.col("start") - F.lit(slack)).cast("double").alias("_s"), (F.col("end") - F.lit(slack)).cast("double").alias("_e")).filter("_e > _s")
    fresh = F.col("_s") > F.coalesce(F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(float("-inf")))
    merged = spans.withColumn("_new", fresh.cast("int")).withColumn("_g", F.sum("_new").over(order)).groupBy(KEY, "_g").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    # merged ranges are apart, so that the last one that starts at or before the point decides
    found = as_of(points.withColumn("_t", F.col(at).cast("double")), merged, "_t", "_s", ["_e"])
    return found.filter(F.col("_t") < F.col("_e")).drop("_t", "_e")


def band(left: DataFrame, right: DataFrame, a: str, b: str, window: float) -> DataFrame:
    """Pairs of one recording with |a - b| <= window."""
    l = left.withColumn("_b", _bucket(F.col(a), window))  # noqa: E741
    r = right.withColumn("_b0", _bucket(F.col(b), window)).withColumn("_b", F.explode(F.array(F.col("_b0") - 1, F.col("_b0"), F.col("_b0") + 1))).drop("_b0")
    return l.join(r, [KEY, "_b"]).filter(F.abs(F.col(a) - F.col(b)) <= F.lit(window)).drop("_b")


def as_of(points: DataFrame, table: DataFrame, at: str, time: str, take: list[str], inclusive: bool = True) -> DataFrame:
    """Each point with the columns ``take`` of the last row of ``table`` at or before it (before it, if not ``inclusive``); nulls where there is none. Of rows at one time the one with the largest columns counts."""
    row = F.struct(*take)
    side = 0 if inclusive else 1
    kinds = {f.name: f.dataType for f in points.schema.fields}
    empty = [F.lit(None).cast(kinds[c]).alias(c) for c in points.columns if c not in (KEY, at)]
    known = table.select(KEY, F.col(time).cast(kinds[at]).alias(at), *empty, row.alias("_row"), F.lit(side).alias("_side"), F.lit(False).alias("_point"))
    asked = points.withColumn("_row", F.lit(None).cast(known.schema["_row"].dataType)).withColumn("_side", F.lit(1 - side)).withColumn("_point", F.lit(True))
    order = Window.partitionBy(KEY).orderBy(at, "_side", F.col("_row").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = known.unionByName(asked).withColumn("_last", F.last("_row", ignorenulls=True).over(order)).filter("_point")
    return both.select(*points.columns, *[F.col(f"_last.{c}").alias(c) for c in take])


def in_speech(points: DataFrame, runs: DataFrame, at: str = "t", pad: float = 0) -> DataFrame:
    """Adds ``in_speech``: is the point within ``pad`` of the last run that starts at or before it, both ends included."""
    shifted = points.withColumn("_q", F.col(at) + F.lit(pad))
    found = as_of(shifted, runs.select(KEY, F.col("start").alias("_s"), F.col("end").alias("_e")), "_q", "_s", ["_s", "_e"])
    held = F.coalesce((F.col(at) >= F.col("_s") - F.lit(pad)) & (F.col(at) <= F.col("_e") + F.lit(pad)), F.lit(False))
    return found.withColumn("in_speech", held).drop("_q", "_s", "_e")


def nearest_edge(points: DataFrame, runs: DataFrame, at: str = "t", prefer: str = "start") -> DataFrame:
    """Adds ``edge``, the run edge nearest to the point (the point itself without runs). Of equally near ones the earlier run's counts, in it the ``prefer`` side."""
    sides = F.array(F.struct(F.col("start").alias("at"), F.lit(0 if prefer == "start" else 1).alias("rank")), F.struct(F.col("end").alias("at"), F.lit(1 if prefer == "start" else 0).alias("rank")))
    edges = runs.select(KEY, F.col("start").alias("run"), F.explode(sides).alias("e")).select(KEY, F.col("e.at").alias("_edge"), "run", F.col("e.rank").alias("rank"))
    # the last edge at or before and the first after; several edges at one time: the one that counts first
    low = as_of(points, edges.groupBy(KEY, "_edge").agg(F.min(F.struct("run", "rank")).alias("w")).select(KEY, "_edge", F.col("w.run").alias("_run"), F.col("w.rank").alias("_rank")), at, "_edge", ["_edge", "_run", "_rank"])
    low = low.withColumnsRenamed({"_edge": "_e0", "_run": "_r0", "_rank": "_k0"}).withColumn("_neg", -F.col(at))
    turned = edges.groupBy(KEY, "_edge").agg(F.min(F.struct("run", "rank")).alias("w")).select(KEY, (-F.col("_edge")).alias("_m"), F.col("_edge").alias("_e1"), F.col("w.run").alias("_r1"), F.col("w.rank").alias("_k1"))
    both = as_of(low, turned, "_neg", "_m", ["_e1", "_r1", "_k1"])
    before, after = F.struct(F.abs(F.col("_e0") - F.col(at)), F.col("_r0"), F.col("_k0"), F.col("_e0").alias("e")), F.struct(F.abs(F.col("_e1") - F.col(at)), F.col("_r1"), F.col("_k1"), F.col("_e1").alias("e"))
    best = F.when(F.col("_e0").isNull(), F.col("_e1")).when(F.col("_e1").isNull() | (before <= after), F.col("_e0")).otherwise(F.col("_e1"))
    return both.withColumn("edge", F.coalesce(best, F.col(at))).select(*points.columns, "edge")


def nearest_line(points: DataFrame, lines: DataFrame, at: str = "t", id: str = "ord") -> DataFrame:
    """Adds ``line``: the line (by ``id``) that holds the point, else the nearest, the first of equally near ones. Lines of one recording may overlap."""
    spans = lines.select(KEY, F.col(id).alias("_l"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    numbered = points.withColumn("_p", F.struct(*points.columns))
    inside = within(numbered, spans, at, (F.col("_s"), F.col("_e")), ("_s", "_e"), 0).groupBy(KEY, "_p").agg(F.min("_l").alias("_in"))
    by_end = spans.groupBy(KEY, "_e").agg(F.min("_l").alias("_le"))
    by_start = spans.groupBy(KEY, "_s").agg(F.min("_l").alias("_ls")).withColumn("_m", -F.col("_s"))
    low = as_of(numbered.withColumn("_neg", -F.col(at)), by_end, at, "_e", ["_e", "_le"])
    both = as_of(low, by_start, "_neg", "_m", ["_s", "_ls"])
    d0, d1 = F.col(at) - F.col("_e"), F.col("_s") - F.col(at)
    near = F.when(d0.isNull(), F.col("_ls")).when(d1.isNull() | (d0 < d1), F.col("_le")).when(d1 < d0, F.col("_ls")).otherwise(F.least("_le", "_ls"))
    return both.join(inside, [KEY, "_p"], "left").withColumn("line", F.coalesce("_in", near)).select(*points.columns, "line")


def media_to_timeline(items: DataFrame, pieces: DataFrame, min_length: float = 0.05, slack: float = 1e-9) -> DataFrame:
    """Items of the media where the pieces play them: clipped to each piece and moved to its place; an item may play several times. Whole items always stay, slivers of at most ``min_length`` go.

    pieces: rec_id, piece, in_point, out_point, seq_start, speed.
    """
    p = pieces.select(KEY, "piece", F.col("in_point").alias("_i"), F.col("out_point").alias("_o"), F.col("seq_start").alias("_q"), F.when(F.coalesce(F.col("speed"), F.lit(0.0)) > 0, F.col("speed")).otherwise(F.lit(1.0)).alias("_v"))
    hit = overlap(items, p, ("start", "end"), ("_i", "_o"), closed=True)
    s, e = F.greatest("start", "_i"), F.least("end", "_o")
    whole = (s <= F.col("start") + F.lit(slack)) & (e >= F.col("end") - F.lit(slack)) & ((e > s) | ((s >= F.col("_i")) & (s < F.col("_o"))))
    kept = hit.withColumn("_a", s).withColumn("_b", e).filter(F.when(whole, F.col("_b") >= F.col("_a")).otherwise(F.col("_b") - F.col("_a") > F.lit(min_length)))
    moved = kept.withColumn("start", F.col("_q") + (F.col("_a") - F.col("_i")) / F.col("_v")).withColumn("end", F.col("_q") + (F.col("_b") - F.col("_i")) / F.col("_v")).withColumn("whole", whole)
    return moved.drop("_i", "_o", "_q", "_v", "_a", "_b")


def timeline_to_media(items: DataFrame, pieces: DataFrame, id: str = "ord", slack: float = 1e-6) -> DataFrame:
    """Items with piece, media_start and media_end in the first piece that plays their middle; nulls where none does."""
    speed = F.when(F.coalesce(F.col("speed"), F.lit(0.0)) > 0, F.col("speed")).otherwise(F.lit(1.0))
    p = pieces.select(KEY, "piece", F.col("in_point").alias("_i"), F.col("seq_start").alias("_q"), speed.alias("_v"), (F.col("seq_start") + (F.col("out_point") - F.col("in_point")) / speed).alias("_z"))
    middle = items.select(KEY, id, F.col("start").alias("_s"), F.col("end").alias("_e"), ((F.col("start") + F.col("end")) / 2).alias("_m"))
    # both ends of the piece count
    hit = within(middle, p, "_m", (F.col("_q") - F.lit(slack), F.col("_z") + F.lit(2 * slack)), ("_q", "_z"), 2 * slack).filter(F.col("_m") <= F.col("_z") + F.lit(slack))
    first = hit.withColumn("_k", F.row_number().over(Window.partitionBy(KEY, id).orderBy("piece"))).filter("_k = 1")
    media = lambda c: F.col("_i") + (F.col(c) - F.col("_q")) * F.col("_v")
    return items.join(first.select(KEY, id, "piece", media("_s").alias("media_start"), media("_e").alias("media_end")), [KEY, id], "left")


def retime(items: DataFrame, old: DataFrame, new: DataFrame, id: str = "ord") -> DataFrame:
    """Items moved from the old pieces through the media to the new ones; those in no old piece stay, those that no new piece plays go."""
    at = timeline_to_media(items, old, id)
    stay = at.filter(F.col("piece").isNull()).drop("piece", "media_start", "media_end")
    moved = at.filter(F.col("piece").isNotNull()).drop("piece").withColumn("start", F.col("media_start")).withColumn("end", F.col("media_end")).drop("media_start", "media_end")
    return media_to_timeline(moved, new).drop("piece", "whole").unionByName(stay)


def place_lines(lines: DataFrame, words: DataFrame, pieces: DataFrame, min_length: float = 0.05) -> DataFrame:
    """Lines on the pieces that play them, with the words whose middle a piece plays: rec_id, ord, piece, start, end, text. A line whose words a piece doesn't play goes; one without words gets the share of its tokens that lies in the piece.

    lines, words: rec_id, ord, start, end, text.
    """
    placed = media_to_timeline(lines.withColumn("_la", F.col("start")).withColumn("_lb", F.col("end")), pieces, min_length)
    middle = words.filter(F.trim("text") != "").select(KEY, F.col("ord").alias("_w"), ((F.col("start") + F.col("end")) / 2).alias("t"), F.trim("text").alias("_t"))
    owned = nearest_line(middle, lines)
    total = owned.groupBy(KEY, F.col("line").alias("ord")).agg(F.count(F.lit(1)).alias("_all"))
    spans = pieces.select(KEY, "piece", F.col("in_point").alias("_i"), F.col("out_point").alias("_o"))
    played = within(owned, spans, "t", (F.col("_i"), F.col("_o")), ("_i", "_o"), 0)
    said = played.groupBy(KEY, F.col("line").alias("ord"), "piece").agg(F.array_sort(F.collect_list(F.struct("t", "_w", "_t"))).alias("_said"))
    both = placed.join(total, [KEY, "ord"], "left").join(said, [KEY, "ord", "piece"], "left").join(spans, [KEY, "piece"])
    tokens = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    size = F.aggregate(tokens, F.lit(0), lambda a, x: a + F.length(x) + 1)
    upto = lambda k: F.aggregate(F.slice(tokens, 1, k), F.lit(0), lambda a, x: a + F.length(x) + 1)
    low, high = ((F.greatest("_la", "_i") - F.col("_la")) / F.greatest(F.lit(1e-6), F.col("_lb") - F.col("_la")), (F.least("_lb", "_o") - F.col("_la")) / F.greatest(F.lit(1e-6), F.col("_lb") - F.col("_la")))
    share = F.filter(tokens, lambda x, k: ((upto(k) + (F.length(x) + 1) / 2) / size >= low) & ((upto(k) + (F.length(x) + 1) / 2) / size < high))
    heard = F.array_join(F.transform("_said", lambda x: x["_t"]), " ")
    text = F.when(F.col("_all").isNotNull(), F.when((F.size("_said") == F.col("_all")) & F.col("whole"), F.col("text")).otherwise(heard)).when(F.col("whole"), F.col("text")).otherwise(F.array_join(share, " "))
    out = both.withColumn("text", F.coalesce(text, F.lit(""))).filter("text <> ''")
    return out.select(KEY, "ord", "piece", "start", "end", "text")
