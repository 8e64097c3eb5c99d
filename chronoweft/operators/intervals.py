"""Sets of time ranges: union, complement, difference, ripple and remapping.

Rows are ranges ``start``, ``end`` of a recording ``rec_id``, in any number type and unit; parameters are in
the same unit.  All windows are partitioned by recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.operators import joins
from chronoweft.sources.folders import settle

KEY = "rec_id"


def _w(*order: Column | str) -> Window:
    return Window.partitionBy(KEY).orderBy(*order)


def _before(*order: Column | str) -> Window:
    return _w(*order).rowsBetween(Window.unboundedPreceding, -1)


def islands(ranges: DataFrame, gap: float = 0, *order: str) -> DataFrame:
    """Number the groups of ranges that overlap or lie at most ``gap`` apart: adds ``island``."""
    order = order or ("start", "end")
    reach = F.max("end").over(_before(*order))
    fresh = F.when(reach.isNull() | (F.col("start") - reach > F.lit(gap)), 1).otherwise(0)
    return ranges.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(_w(*order)).cast("long")).drop("_new")


def merge(ranges: DataFrame, gap: float = 0, min_length: float | None = None) -> DataFrame:
    """Union: rec_id, start, end, n (ranges joined). Ranges of at most ``min_length`` are left out first."""
    if min_length is not None:
        ranges = ranges.filter(F.col("end") - F.col("start") > F.lit(min_length))
    return islands(ranges, gap).groupBy(KEY, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("island")


def merge_with_text(ranges: DataFrame, gap: float = 0, text: str = "word", ord: str = "ord", separator: str = " ") -> DataFrame:
    """Union with the ranges' texts joined in order of start."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", ord, F.col(text).alias("t")))), lambda x: x["t"]), separator)
    return islands(ranges, gap).groupBy(KEY, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), joined.alias(text)).drop("island")


def tidy(cuts: DataFrame, min_length: float, slack: float) -> DataFrame:
    """Union of cuts no shorter than ``min_length``, ``slack`` apart at most; any doubtful cut makes the union doubtful, and different texts are joined by " / ". Columns: start, end, text, needs_review, estimated, ord."""
    long = cuts.filter(F.col("end") - F.col("start") >= F.lit(min_length))
    texts = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("start", "ord", "text"))), lambda x: x["text"]))
    flag = lambda c: F.coalesce(F.bool_or(F.coalesce(F.col(c), F.lit(False))), F.lit(False)).alias(c)
    return (
        islands(long, slack)
        .groupBy(KEY, "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.filter(texts, lambda t: F.length(t) > 0), " / ").alias("text"), flag("needs_review"), flag("estimated"))
        .drop("island")
    )


def complement(ranges: DataFrame, totals: DataFrame, min_keep: float = 0) -> DataFrame:
    """What the ranges leave of [0, total]: rec_id, start, end of at least ``min_keep``. totals: rec_id, total; a recording without ranges is kept whole."""
    zero = totals.select(KEY, F.col("total").alias("start"), F.col("total").alias("end"), F.lit(True).alias("_tail"))
    rows = ranges.select(KEY, "start", "end", F.lit(False).alias("_tail")).join(totals.select(KEY), KEY, "left_semi").unionByName(zero)
    cursor = F.greatest(F.coalesce(F.max("end").over(_before("_tail", "start", "end")), F.lit(0)), F.lit(0))
    return rows.select(KEY, cursor.alias("_from"), F.col("start").alias("_to")).filter("_to > _from").filter(F.col("_to") - F.col("_from") >= F.lit(min_keep)).select(KEY, F.col("_from").alias("start"), F.col("_to").alias("end"))


def total(ranges: DataFrame) -> DataFrame:
    """Summed length: rec_id, total."""
    return ranges.groupBy(KEY).agg(F.sum(F.col("end") - F.col("start")).alias("total"))


def subtract(cuts: DataFrame, keeps: DataFrame, min_length: float = 0, id: str = "ord") -> DataFrame:
    """Pieces of each cut outside all keeps, at least ``min_length`` long; all columns of the cut stay."""
    solid = merge(keeps).select(KEY, F.col("start").alias("_ks"), F.col("end").alias("_ke"))
    each = Window.partitionBy(KEY, id).orderBy("_ks").rowsBetween(Window.unboundedPreceding, -1)
    hit = joins.overlap(cuts, solid, ("start", "end"), ("_ks", "_ke"))
    rows = cuts.join(hit.select(KEY, id, "_ks", "_ke"), [KEY, id], "left").withColumn("_tail", F.lit(False))
    ends = cuts.withColumn("_ks", F.col("end")).withColumn("_ke", F.lit(None).cast(cuts.schema["end"].dataType)).withColumn("_tail", F.lit(True))
    order = Window.partitionBy(KEY, id).orderBy("_tail", "_ks").rowsBetween(Window.unboundedPreceding, -1)
    both = rows.filter(F.col("_ks").isNotNull()).unionByName(ends)
    pieces = both.withColumn("_from", F.greatest(F.col("start"), F.coalesce(F.max("_ke").over(order), F.col("start"))))
    del each
    return pieces.filter((F.col("_ks") > F.col("_from")) & (F.col("_ks") - F.col("_from") >= F.lit(min_length))).withColumn("end", F.col("_ks")).withColumn("start", F.col("_from")).drop("_ks", "_ke", "_tail", "_from")


def is_word_level(words: DataFrame, limit: float = 1.0) -> DataFrame:
    """rec_id, word_level: at least three words, and the one in the middle by length takes at most ``limit``."""
    length = F.col("end") - F.col("start")
    sorted_ = words.select(KEY, length.alias("d")).withColumn("_k", F.row_number().over(_w("d")) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(KEY)))
    return sorted_.groupBy(KEY).agg((F.coalesce(F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2), F.col("d"))), F.lit(float("inf"))) <= F.lit(limit)).alias("_ok"), F.max("_n").alias("_n")).select(
        KEY, (F.col("_ok") & (F.col("_n") >= 3)).alias("word_level")
    )


def protect_words(cuts: DataFrame, words: DataFrame, before: float = 0.2, after: float = 0.15, min_cut: float = 0.2, limit: float = 1.0, id: str = "ord") -> DataFrame:
    """Cuts less the padded words, in recordings with real word times; elsewhere the cuts as they are."""
    # what costs as much as the words is computed once; below, each is read several times
    level = is_word_level(words, limit).filter("word_level").select(KEY, F.lit(True).alias("_level"))
    marked = settle(cuts.join(level, KEY, "left"), "cuts")
    padded = words.select(KEY, (F.col("start") - F.lit(before)).alias("start"), (F.col("end") + F.lit(after)).alias("end"))
    return subtract(marked.filter("_level").drop("_level"), settle(merge(padded), "words"), min_cut, id).unionByName(marked.filter("_level is null").drop("_level"))


def _prefix(cuts: DataFrame) -> DataFrame:
    """Merged cuts with the time removed before each."""
    length = F.col("end") - F.col("start")
    return merge(cuts.filter("end > start")).select(KEY, F.col("start").alias("_cs"), F.col("end").alias("_ce"), F.coalesce(F.sum(length).over(_before("start")), F.lit(0)).alias("_gone"))


def removed_before(points: DataFrame, cuts: DataFrame, at: str = "t") -> DataFrame:
    """Adds ``removed``, the cut time before each point, and ``inside``, whether a cut strictly contains it (with its edges ``cut_start``, ``cut_end``)."""
    before = joins.as_of(points, _prefix(cuts), at, "_cs", ["_cs", "_ce", "_gone"], inclusive=False)
    removed = F.coalesce(F.col("_gone") + F.least(F.col(at), F.col("_ce")) - F.col("_cs"), F.lit(0))
    inside = F.coalesce((F.col(at) > F.col("_cs")) & (F.col(at) < F.col("_ce")), F.lit(False))
    return before.select(*points.columns, removed.alias("removed"), inside.alias("inside"), F.when(inside, F.col("_cs")).alias("cut_start"), F.when(inside, F.col("_ce")).alias("cut_end"))


def word_needs(length: Column, floor: float = 0.05) -> Column:
    """How much of a word must be left: half of it, at least ``floor``, at most all."""
    return F.least(length, F.greatest(F.lit(floor), length / 2))


def ripple(items: DataFrame, cuts: DataFrame, close_gaps: bool = True, kind: str = "words", floor: float = 0.05, slack: float = 1e-9, id: str = "ord") -> DataFrame:
    """Items after a ripple delete: both ends slide left by the time cut before them; items of which too little is left go.

    kind: ``words`` (half of it and ``floor``) or ``lines`` (``floor``); a mark of no length goes only inside a cut.
    Without ``close_gaps`` nothing slides, and an end inside a cut moves to the side that is left.
    """
    ends = F.explode(F.array(F.struct(F.lit("s").alias("e"), F.col("start").alias("t")), F.struct(F.lit("e").alias("e"), F.col("end").alias("t"))))
    points = items.select(KEY, id, ends.alias("p")).select(KEY, id, "p.e", "p.t")
    found = removed_before(points, cuts)
    pick = lambda e, c: F.max(F.when(F.col("e") == e, F.col(c)))
    per = found.groupBy(KEY, id).agg(pick("s", "removed").alias("_rs"), pick("e", "removed").alias("_re"), pick("s", "cut_end").alias("_ss"), pick("e", "cut_start").alias("_ee"))
    both = items.join(per, [KEY, id])
    length = F.col("end") - F.col("start")
    need = word_needs(length, floor) if kind == "words" else F.least(length, F.lit(floor))
    stays = F.when(length <= 0, F.col("_ss").isNull()).otherwise(length - (F.col("_re") - F.col("_rs")) >= need - F.lit(slack))
    if close_gaps:
        start, end = F.col("start") - F.col("_rs"), F.col("end") - F.col("_re")
    else:
        start, end = F.coalesce("_ss", "start"), F.coalesce("_ee", "end")
        turned = end <= start
        start, end = F.when(turned, F.col("start")).otherwise(start), F.when(turned, F.col("end")).otherwise(end)
    moved = both.filter(stays).withColumn("_s", F.greatest(F.lit(0), start)).withColumn("_e", F.greatest(F.lit(0), end))
    return moved.withColumn("start", F.col("_s")).withColumn("end", F.col("_e")).drop("_rs", "_re", "_ss", "_ee", "_s", "_e")


def ripple_lines(lines: DataFrame, words: DataFrame, cuts: DataFrame, **options) -> DataFrame:
    """Lines with words of their own (words: rec_id, line, ord, start, end, text; lines: rec_id, ord, ...): a line stays while one of its words does, and loses the text of those that go.

    The text is rebuilt from the line's tokens where there are as many as words, else from the words left.
    """
    left = ripple(words, cuts, kind="words", **options)
    sorted_ = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("v")))), lambda x: x["v"])
    had = words.withColumn("_pos", F.row_number().over(Window.partitionBy(KEY, "line").orderBy("ord")))
    kept = left.select(KEY, "line", "ord", F.col("text").alias("_text")).join(had.select(KEY, "line", "ord", "_pos"), [KEY, "line", "ord"])
    kept = kept.groupBy(KEY, "line").agg(sorted_("_pos").alias("_keep"), sorted_("_text").alias("_said"))
    count = had.groupBy(KEY, "line").agg(F.count(F.lit(1)).alias("_n"))
    moved = ripple(lines.withColumn("_l", F.col("ord")), cuts, kind="lines", floor=float("-inf"), **{k: v for k, v in options.items() if k != "floor"})
    both = moved.join(kept, (moved[KEY] == kept[KEY]) & (moved["ord"] == kept["line"])).drop(kept[KEY]).drop("line")
    both = both.join(count, (both[KEY] == count[KEY]) & (both["ord"] == count["line"])).drop(count[KEY]).drop("line")
    tokens = F.split(F.trim("text"), r"\s+")
    rebuilt = F.when(F.size(tokens) == F.col("_n"), F.array_join(F.transform("_keep", lambda k: F.get(tokens, k - 1)), " ")).otherwise(F.array_join(F.filter(F.transform("_said", lambda t: F.trim(t)), lambda t: t != ""), " "))
    return both.withColumn("text", F.when(F.size("_keep") < F.col("_n"), rebuilt).otherwise(F.col("text"))).drop("_keep", "_said", "_n", "_l")


def remap_through_keeps(items: DataFrame, keeps: DataFrame, slack: float = 0.001, least: float = 0.02, id: str = "ord") -> DataFrame:
    """Items on the clock of the keeps laid end to end: an item belongs to the first keep that holds its middle; others go."""
    length = F.col("end") - F.col("start")
    laid = keeps.filter("end > start").select(KEY, F.col("start").alias("_ks"), F.col("end").alias("_ke"), F.coalesce(F.sum(length).over(_before("start")), F.lit(0)).alias("_at"))
    middle = items.withColumn("_mid", (F.col("start") + F.col("end")) / 2)
    held = joins.within(middle, laid, "_mid", (F.col("_ks") - F.lit(slack), F.col("_ke") + F.lit(slack)), ("_ks", "_ke"), slack)
    first = held.withColumn("_k", F.row_number().over(Window.partitionBy(KEY, id).orderBy("_ks"))).filter("_k = 1")
    span = F.col("_ke") - F.col("_ks")
    inside = lambda c: F.col("_at") + F.least(span, F.greatest(F.lit(0), F.col(c) - F.col("_ks")))
    moved = first.withColumn("_s", inside("start")).withColumn("_e", inside("end"))
    end = F.when(F.col("_e") <= F.col("_s"), F.least(F.col("_at") + span, F.col("_s") + F.lit(least))).otherwise(F.col("_e"))
    return moved.withColumn("start", F.col("_s")).withColumn("end", end).drop("_ks", "_ke", "_at", "_mid", "_k", "_s", "_e")


def remap_first_overlap(items: DataFrame, keeps: DataFrame, id: str = "ord") -> DataFrame:
    """The part of each item in the first keep that it overlaps, on the clock of the keeps laid end to end."""
    length = F.col("end") - F.col("start")
    laid = keeps.select(KEY, F.col("start").alias("_ks"), F.col("end").alias("_ke"), F.coalesce(F.sum(length).over(_before("start")), F.lit(0)).alias("_at"))
    hit = joins.overlap(items, laid, ("start", "end"), ("_ks", "_ke"))
    first = hit.withColumn("_k", F.row_number().over(Window.partitionBy(KEY, id).orderBy("_ks"))).filter("_k = 1")
    s, e = F.greatest("start", "_ks"), F.least("end", "_ke")
    return first.withColumn("_s", F.col("_at") + s - F.col("_ks")).withColumn("_e", F.col("_at") + e - F.col("_ks")).withColumn("start", F.col("_s")).withColumn("end", F.col("_e")).drop("_ks", "_ke", "_at", "_k", "_s", "_e")


def snap_cuts(cuts: DataFrame, silences: DataFrame, window: float = 0.25, pad: float = 0.02, id: str = "ord") -> DataFrame:
    """Cuts with their start at the nearest edge of a silence and their end at the nearest end of one, within ``window``, less ``pad`` on both sides; a cut that this turns over stays as it was."""
    edges = silences.select(KEY, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(0).alias("side")), F.struct(F.col("end").alias("at"), F.lit(1).alias("side")))).alias("e")).select(KEY, F.col("e.at").alias("_at"), F.col("e.side").alias("_side"))

    def nearest(to: str, name: str, only_ends: bool) -> DataFrame:
        near = joins.band(cuts.select(KEY, id, F.col(to).alias("_t")), edges.filter("_side = 1") if only_ends else edges, "_t", "_at", window)
        far = F.abs(F.col("_at") - F.col("_t"))
        return near.groupBy(KEY, id).agg(F.min_by("_at", F.struct(far, "_at")).alias(name))

    both = cuts.join(nearest("start", "_s", False), [KEY, id], "left").join(nearest("end", "_e", True), [KEY, id], "left")
    start, end = F.coalesce("_s", "start") + F.lit(pad), F.coalesce("_e", "end") - F.lit(pad)
    return both.withColumn("_a", F.when(end > start, start).otherwise(F.col("start"))).withColumn("_b", F.when(end > start, end).otherwise(F.col("end"))).withColumn("start", F.col("_a")).withColumn("end", F.col("_b")).drop("_s", "_e", "_a", "_b")


def by_interval(totals: DataFrame, interval: float, slack: float = 1e-6) -> DataFrame:
    """Tumbling segments over [0, total]: rec_id, i, start, end."""
    n = F.ceil((F.col("total") - F.lit(slack)) / F.lit(interval)).cast("int")
    rows = totals.filter(F.col("total") > F.lit(slack)).select(KEY, "total", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return rows.select(KEY, "i", (F.col("i") * F.lit(interval)).alias("start"), F.least((F.col("i") + 1) * F.lit(interval), F.col("total")).alias("end"))


def from_boundaries(bounds: DataFrame, totals: DataFrame, sliver: float = 1e-3) -> DataFrame:
    """Segments between boundaries inside [0, total]; slivers go. bounds: rec_id, at."""
    inner = bounds.join(totals, KEY).filter((F.col("at") > F.lit(sliver)) & (F.col("at") < F.col("total") - F.lit(sliver))).select(KEY, "at")
    ends = totals.select(KEY, F.explode(F.array(F.col("total") * 0, F.col("total"))).alias("at"))
    rows = inner.unionByName(ends).select(KEY, F.col("at").alias("start"), F.lead("at").over(_w("at")).alias("end"))
    return rows.filter(F.col("end") - F.col("start") > F.lit(sliver))


def hold(segments: DataFrame, min_hold: float) -> DataFrame:
    """Segments in order of start, each shorter than ``min_hold`` joined to the one before; a short first joins the next."""
    order = _w("start", "end")
    long = ((F.col("end") - F.col("start")) >= F.lit(min_hold)) | (F.row_number().over(order) == 1)
    rows = segments.withColumn("_long", long.cast("int")).withColumn("_g", F.sum("_long").over(order))
    held = rows.groupBy(KEY, "_g").agg(F.min_by("start", F.struct("start", "end")).alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"))
    by = _w("_g")
    short_first = (F.first("end").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.first("start").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) < F.lit(min_hold)
    rank, n = F.row_number().over(by), F.count(F.lit(1)).over(Window.partitionBy(KEY))
    marked = held.withColumn("_r", rank).withColumn("_n", n).withColumn("_short", short_first).withColumn("_prev", F.lag("start").over(by))
    start = F.when((F.col("_r") == 2) & F.col("_short"), F.col("_prev")).otherwise(F.col("start"))
    return marked.withColumn("start", start).filter(~((F.col("_r") == 1) & F.col("_short") & (F.col("_n") > 1))).select(KEY, "start", "end")


def gaps(cues: DataFrame, threshold: float) -> DataFrame:
    """Gaps of at least ``threshold`` between a cue and the next by start: rec_id, start, end."""
    rows = cues.select(KEY, F.col("end").alias("_e"), F.lead("start").over(_w("start", "end")).alias("_n"))
    return rows.filter(F.col("_n") - F.col("_e") >= F.lit(threshold)).select(KEY, F.col("_e").alias("start"), F.col("_n").alias("end"))


def split_at(segments: DataFrame, bounds: DataFrame, guard: float = 0.07, id: str = "ord") -> DataFrame:
    """Segments split at the boundaries inside them, ``guard`` away from what precedes and from their end; ``cut`` tells the parts after a split. bounds: rec_id, at.

    Boundaries closer than ``guard`` to the one before are passed over only where that one was taken; rows of one
    segment are few, so they are walked in an array.
    """
    inside = joins.within(bounds.select(KEY, F.col("at").alias("_at")), segments.select(KEY, id, "start", "end"), "_at", (F.col("start") + F.lit(guard), F.col("end") - F.lit(guard)), ("start", "end"), 0)
    taken = F.aggregate(F.array_sort(F.collect_set("_at")), F.array().cast(f"array<{bounds.schema['at'].dataType.simpleString()}>"), lambda a, x: F.when((F.size(a) == 0) | (x > F.element_at(a, -1) + F.lit(guard)), F.concat(a, F.array(x))).otherwise(a))
    per = inside.filter((F.col("_at") > F.col("start") + F.lit(guard)) & (F.col("_at") < F.col("end") - F.lit(guard))).groupBy(KEY, id).agg(taken.alias("_cuts"))
    both = segments.join(per, [KEY, id], "left").withColumn("_edges", F.concat(F.array("start"), F.coalesce("_cuts", F.array().cast(f"array<{bounds.schema['at'].dataType.simpleString()}>")), F.array("end")))
    return both.select(*[c for c in segments.columns if c not in ("start", "end")], F.col("_edges"), F.explode(F.sequence(F.lit(1), F.size("_edges") - 1)).alias("_k")).select(
        *[c for c in segments.columns if c not in ("start", "end")], F.get("_edges", F.col("_k") - 1).alias("start"), F.get("_edges", F.col("_k")).alias("end"), (F.col("_k") > 1).alias("cut")
    )


def plan_chunks(totals: DataFrame, size: int = 1000, overlap: int = 0) -> DataFrame:
    """Overlapping chunks of ``total`` rows and the part that each owns: rec_id, chunk, from_i, to_i, own_from, own_to (ends exclusive). Each overlap is owned half and half."""
    size = max(1, size)
    overlap = max(0, min(overlap, size // 2))
    step = size - overlap
    n = F.when(F.col("total") <= size, 1).otherwise(F.ceil((F.col("total") - size) / F.lit(step)) + 1).cast("int")
    rows = totals.filter("total > 0").select(KEY, "total", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    rows = rows.withColumn("from_i", (F.col("chunk") * step).cast("long")).withColumn("to_i", F.least(F.col("from_i") + size, F.col("total")).cast("long"))
    order = _w("chunk")
    before, after = F.lag("to_i").over(order), F.lead("from_i").over(order)
    own_from = F.coalesce(F.floor((F.col("from_i") + before) / 2), F.lit(0)).cast("long")
    own_to = F.coalesce(F.floor((after + F.col("to_i")) / 2), F.col("total")).cast("long")
    return rows.select(KEY, "chunk", "from_i", "to_i", own_from.alias("own_from"), own_to.alias("own_to"))


def split_chunk(chunks: DataFrame, overlap: int) -> DataFrame:
    """Each chunk in two halves that overlap, sharing what it owned."""
    half = max(0, overlap) // 2
    mid = F.floor((F.col("from_i") + F.col("to_i")) / 2).cast("long")
    cut = F.least(F.greatest(mid, F.col("own_from")), F.col("own_to"))
    first = F.struct(F.lit(0).alias("half"), F.col("from_i").alias("from_i"), F.least(F.col("to_i"), mid + half).alias("to_i"), F.col("own_from").alias("own_from"), cut.alias("own_to"))
    second = F.struct(F.lit(1).alias("half"), F.greatest(F.col("from_i"), mid - half).alias("from_i"), F.col("to_i").alias("to_i"), cut.alias("own_from"), F.col("own_to").alias("own_to"))
    return chunks.select(KEY, "chunk", F.explode(F.array(first, second)).alias("h")).select(KEY, "chunk", "h.*")


def fixed_chunks(rows: DataFrame, size: int, ord: str = "ord") -> DataFrame:
    """Adds ``chunk``: runs of ``size`` rows of a recording."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(_w(ord)) - 1) / max(1, size)).cast("long"))


def merge_chunk_cuts(plan: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cuts of all chunks, each from the chunk that owns its first word, and joined where they overlap. cuts: rec_id, chunk, from_idx, to_idx (within the chunk), start, end, text, needs_review."""
    owned = cuts.join(plan, [KEY, "chunk"]).withColumn("_g", F.col("from_i") + F.col("from_idx")).filter("_g >= own_from and _g < own_to").withColumn("to_idx", F.col("from_i") + F.col("to_idx")).withColumn("from_idx", F.col("_g"))
    reach = F.max("end").over(_before("start", "from_idx"))
    rows = owned.withColumn("_new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)).withColumn("_i", F.sum("_new").over(_w("start", "from_idx")))
    texts = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("start", "from_idx", "text"))), lambda x: x["text"]))
    return rows.groupBy(KEY, "_i").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(texts, " / ").alias("text"), F.coalesce(F.bool_or("needs_review"), F.lit(False)).alias("needs_review"), F.min("from_idx").alias("from_idx"), F.max_by("to_idx", "end").alias("to_idx")
    ).drop("_i")
