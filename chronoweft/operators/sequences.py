"""Ordered scans: runs, hysteresis, sessions, exact ranks and spacing, as windows over a recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "rec_id"


def _w(*order: Column | str, by: list[str] | None = None) -> Window:
    return Window.partitionBy(*(by or [KEY])).orderBy(*order)


def runs(rows: DataFrame, value: str, ord: str = "i", by: list[str] | None = None) -> DataFrame:
    """Run-length encoding: key columns, run, value, first, last, n. Rows follow each other in ``ord``."""
    by = by or [KEY]
    fresh = F.when(F.lag(value).over(_w(ord, by=by)).eqNullSafe(F.col(value)) & (F.row_number().over(_w(ord, by=by)) > 1), 0).otherwise(1)
    numbered = rows.withColumn("_new", fresh).withColumn("run", F.sum("_new").over(_w(ord, by=by)).cast("long"))
    return numbered.groupBy(*by, "run", value).agg(F.min(ord).alias("first"), F.max(ord).alias("last"), F.count(F.lit(1)).alias("n"))


def hysteresis(levels: DataFrame, threshold: Column, rise: float | Column = 3.0, value: str = "db", ord: str = "i", by: list[str] | None = None) -> DataFrame:
    """Adds ``loud``: a level is loud above threshold + rise and quiet below threshold, and between these as the one before; the first is loud above threshold."""
    rise = rise if isinstance(rise, Column) else F.lit(rise)
    order = _w(ord, by=by)
    event = (
        F.when(F.row_number().over(order) == 1, F.col(value) > threshold)
        .when(F.col(value) > threshold + rise, F.lit(True))
        .when(F.col(value) < threshold, F.lit(False))
    )
    # a first row above its threshold but not above the rise is loud all the same
    return levels.withColumn("_event", event).withColumn("loud", F.coalesce(F.last("_event", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(False))).drop("_event")


def quiet_runs(flags: DataFrame, hop: float, min_length: float = 0.0, start: float = 0.0, ord: str = "i", slack: float = 1e-9) -> DataFrame:
    """Runs that are not loud, as times: rec_id, start, end of at least ``min_length``."""
    quiet = runs(flags, "loud", ord).filter(~F.col("loud"))
    length = (F.col("last") - F.col("first") + 1) * F.lit(hop)
    return quiet.filter(length >= F.lit(min_length - slack)).select(KEY, (F.lit(start) + F.col("first") * F.lit(hop)).alias("start"), (F.lit(start) + (F.col("last") + 1) * F.lit(hop)).alias("end"))


def nearest_rank(rows: DataFrame, value: str, p: float, rule: str = "inclusive", by: list[str] | None = None, name: str | None = None) -> DataFrame:
    """The element at a rank of the sorted values, never an interpolation. rule: inclusive, floor(p * (n - 1)); exclusive, floor(n * p) but at most n - 1; middle, floor(n / 2). Nulls are left out."""
    by = by or [KEY]
    found = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    ranked = found.withColumn("_k", F.row_number().over(_w("_v", by=by)) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    at = {"inclusive": F.floor(F.lit(p) * (F.col("_n") - 1)), "exclusive": F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(p))), "middle": F.floor(F.col("_n") / 2)}[rule]
    return ranked.filter(F.col("_k") == F.greatest(F.lit(0), at)).select(*by, F.col("_v").alias(name or value))


def carry_forward(rows: DataFrame, value: str, ord: str = "i", name: str | None = None) -> DataFrame:
    """The last value so far that is not null."""
    return rows.withColumn(name or value, F.last(value, ignorenulls=True).over(_w(ord).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def sessions(rows: DataFrame, breaks_before: Column, *order: str, name: str = "session") -> DataFrame:
    """Adds a session number: a row for which ``breaks_before`` holds (null: no) starts a new one, as does the first."""
    rows = rows.withColumn("_break", F.when(F.coalesce(breaks_before, F.lit(False)), 1).otherwise(0))
    return rows.withColumn(name, (F.sum("_break").over(_w(*order)) + F.when(F.first("_break").over(_w(*order)) > 0, 0).otherwise(1)).cast("long")).drop("_break")


SENTENCE_END = r"""[.!?।॥۔؟？！…]["'”’)\]]*$"""


def phrases(words: DataFrame, pause: float = 0.45, *order: str) -> DataFrame:
    """Adds ``phrase``: a new one starts after a pause, after a sentence's end and where the speaker changes."""
    order = order or ("start", "end", "ord")
    w = _w(*order)
    last, speaker = F.lag("text").over(w), F.lag("speaker").over(w)
    changed = F.coalesce((speaker != F.col("speaker")) & (speaker != "") & (F.col("speaker") != ""), F.lit(False))
    return sessions(words, (F.col("start") - F.lag("end").over(w) > F.lit(pause)) | last.rlike(SENTENCE_END) | changed, *order, name="phrase")


def word_cues(words: DataFrame, gap: float = 0.7, most: int = 16, end: str = r"""[.!?।॥۔؟…]["'”’)\]]*$""", *order: str) -> DataFrame:
    """Cues of words: a cue ends after a sentence, before a gap longer than ``gap`` and with ``most`` words. Columns: rec_id, cue, start, end, text, n."""
    order = order or ("start", "end", "ord")
    w = _w(*order)
    hard = sessions(words, F.lag("text").over(w).rlike(end) | (F.col("start") - F.lag("end").over(w) > F.lit(gap)), *order, name="_hard")
    part = F.floor((F.row_number().over(_w(*order, by=[KEY, "_hard"])) - 1) / most)
    rows = hard.withColumn("_part", part).withColumn("_ord", F.row_number().over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_ord", "text"))), lambda x: x["text"]), " ")
    cues = rows.groupBy(KEY, "_hard", "_part").agg(F.min_by("start", "_ord").alias("start"), F.max("end").alias("_e"), text.alias("text"), F.count(F.lit(1)).alias("n"))
    return cues.select(KEY, F.row_number().over(_w("_hard", "_part")).alias("cue"), "start", F.greatest("start", "_e").alias("end"), "text", "n")


def explode_words(cues: DataFrame, per: int = 1, min_duration: float | None = 0.08, cue: str = "ord", uppercase: bool = False) -> DataFrame:
    """Words (or groups of ``per``) of each cue with times shared out by length, each of weight 2 at least. Columns: rec_id, cue, word, start, end, text.

    With ``min_duration`` no word takes less, as far as the cue reaches; the last ends with its cue.
    """
    tokens = F.filter(F.split(F.trim("text"), r"\s+"), lambda t: t != "")
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("_t") - 1) / per).cast("int")), lambda g: F.array_join(F.slice("_t", g * per + 1, F.lit(per)), " "))
    rows = cues.withColumn("_t", tokens).filter(F.size("_t") > 0).select(KEY, F.col(cue).alias("cue"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.posexplode(groups).alias("word", "text"))
    weight = F.greatest(F.lit(2), F.length(F.regexp_replace("text", r"\s", "")))
    each = Window.partitionBy(KEY, "cue")
    rows = rows.withColumn("_w", weight).withColumn("_all", F.sum("_w").over(each)).withColumn("_n", F.count(F.lit(1)).over(each))
    share = (F.col("_e") - F.col("_s")) * F.col("_w") / F.col("_all")
    if min_duration is not None:
        share = F.greatest(F.lit(min_duration), share)
    upto = F.sum("_d").over(each.orderBy("word").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_d", share).withColumn("_u", upto)
    end = F.when(F.col("word") == F.col("_n") - 1, F.col("_e")).otherwise(F.least(F.col("_e"), F.col("_s") + F.col("_u")))
    start = F.when(F.col("word") == 0, F.col("_s")).otherwise(F.least(F.col("_e"), F.col("_s") + F.col("_u") - F.col("_d")))
    return rows.select(KEY, "cue", "word", start.alias("start"), end.alias("end"), (F.upper("text") if uppercase else F.col("text")).alias("text"))


def even_words(cues: DataFrame, cue: str = "ord") -> DataFrame:
    """Words spread evenly over their cue, marked as estimated, the first and last with the cue's real ends."""
    tokens = F.filter(F.split(F.trim("text"), r"\s+"), lambda t: t != "")
    rows = cues.withColumn("_t", tokens).filter(F.size("_t") > 0).withColumn("_n", F.size("_t"))
    rows = rows.select(KEY, F.col(cue).alias("cue"), F.col("start").alias("_s"), F.col("end").alias("_e"), "_n", F.posexplode("_t").alias("word", "text"))
    length = F.col("_e") - F.col("_s")
    step = F.when(length == 0, F.lit(0.4)).otherwise(length / F.col("_n"))
    return rows.select(KEY, "cue", "word", (F.col("_s") + F.col("word") * step).alias("start"), (F.col("_s") + (F.col("word") + 1) * step).alias("end"), "text", F.lit(True).alias("estimated"), (F.col("word") == 0).alias("cue_start"), (F.col("word") == F.col("_n") - 1).alias("cue_end"))


def push_apart(rows: DataFrame, value: str, step: float | int, *order: str) -> DataFrame:
    """Each value at least ``step`` after the one before: the running maximum of value - step * place, plus step * place."""
    order = order or (value,)
    place = (F.row_number().over(_w(*order)) - 1) * F.lit(step)
    return rows.withColumn("_p", place).withColumn(value, F.max(F.col(value) - F.col("_p")).over(_w(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_p")).drop("_p")


def sanitize_words(words: DataFrame, min_window: float = 0.06) -> DataFrame:
    """Words with text, in order of start, each starting at least ``min_window`` after the one before and lasting as long."""
    kept = words.filter(F.length("text") > 0).withColumn("start", F.coalesce("start", F.lit(0))).withColumn("end", F.coalesce("end", F.lit(0)))
    return push_apart(kept, "start", min_window, "start", "ord").withColumn("end", F.greatest(F.col("end"), F.col("start") + F.lit(min_window)))


def clamp_words(words: DataFrame, low: float = 0.3, high: float = 1.4, times: float = 2.5, slack: float = 1e-6, pause: float = 0.1, least: float = 0.05) -> DataFrame:
    """Words longer than ``times`` the middle length (within low and high) cut on the side where there is silence."""
    length = F.col("end") - F.col("start")
    middle = nearest_rank(words.select(KEY, length.alias("d")).filter("d > 0"), "d", 0.5, "middle", name="_m")
    both = words.join(middle, KEY, "left").withColumn("_cap", F.least(F.lit(high), F.greatest(F.lit(low), F.lit(times) * F.col("_m"))))
    w = _w("start", "end", "ord")
    both = both.withColumn("_prev", F.lag("end").over(w)).withColumn("_next", F.lead("start").over(w))
    long = length > F.col("_cap")
    crowded = F.coalesce(F.col("_next") < F.col("end") - F.lit(slack), F.lit(False))
    alone = F.col("_prev").isNull() | (F.col("start") - F.col("_prev") > F.lit(pause))
    end = F.when(long & crowded, F.least(F.col("start") + F.col("_cap"), F.greatest(F.col("_next"), F.col("start") + F.lit(least)))).when(long & ~alone, F.col("start") + F.col("_cap")).otherwise(F.col("end"))
    start = F.when(long & ~crowded & alone, F.col("end") - F.col("_cap")).otherwise(F.col("start"))
    return both.withColumn("_s", start).withColumn("_e", end).withColumn("start", F.col("_s")).withColumn("end", F.col("_e")).drop("_s", "_e", "_prev", "_next", "_cap", "_m")


def fill_gaps(frames: DataFrame, linger: float = 2.0, *order: str) -> DataFrame:
    """Frames held until the next starts, for ``linger`` at most."""
    following = F.lead("start").over(_w(*(order or ("start", "ord"))))
    return frames.withColumn("end", F.when(following > F.col("end"), F.least(following, F.col("end") + F.lit(linger))).otherwise(F.col("end")))


def spoken_windows(words: DataFrame, *order: str) -> DataFrame:
    """The word before, the word and the word after, while the word is spoken: rec_id, ord, start, end, words, active."""
    w = _w(*(order or ("start", "ord")))
    before, after = F.lag("text").over(w), F.lead("text").over(w)
    shown = F.filter(F.array(before, F.col("text"), after), lambda t: t.isNotNull())
    return words.select(KEY, "ord", "start", F.coalesce(F.lead("start").over(w), "end").alias("end"), shown.alias("words"), F.when(before.isNull(), 0).otherwise(1).alias("active"))


def karaoke(words: DataFrame, per: int = 3, accumulate: bool = False) -> DataFrame:
    """A frame for each word of each phrase of ``per`` words of a cue, with the word's place. words: rec_id, cue, word, start, end, text."""
    per = max(2, per)
    phrase = words.withColumn("phrase", F.floor(F.col("word") / per))
    each = Window.partitionBy(KEY, "cue", "phrase").orderBy("word")
    frame = each.rowsBetween(Window.unboundedPreceding, Window.currentRow if accumulate else Window.unboundedFollowing)
    return phrase.select(KEY, "cue", "word", "start", "end", F.collect_list("text").over(frame).alias("words"), (F.col("word") % per).alias("active"))


def typewriter(words: DataFrame) -> DataFrame:
    """The words of a cue so far: rec_id, cue, word, start, end, text."""
    each = Window.partitionBy(KEY, "cue").orderBy("word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return words.select(KEY, "cue", "word", "start", "end", F.array_join(F.collect_list("text").over(each), " ").alias("text"))


def tightened_order(words: DataFrame) -> DataFrame:
    """Words by start, then end."""
    return words.withColumn("ord", F.row_number().over(_w("start", "end", "ord")))


def repeated_loops(words: DataFrame, times: int = 4) -> DataFrame:
    """Runs of one word said at least ``times`` in a row, and words made of one short unit as often: rec_id, first, last, n."""
    folded = words.withColumn("_t", F.lower(F.regexp_replace("text", r"[^\p{L}\p{M}\p{N}]", "")))
    said = runs(folded.filter("_t <> ''"), "_t", "ord").filter(F.col("n") >= times).select(KEY, "first", "last", "n")
    inner = folded.filter(F.col("_t").rlike(r"^(.{2,6}?)\1{" + str(times - 1) + r",}$")).select(KEY, F.col("ord").alias("first"), F.col("ord").alias("last"), F.lit(1).cast("long").alias("n"))
    return said.unionByName(inner)


def splice(rows: DataFrame, windows: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows whose middle lies in no window, and the fresh rows instead of the others."""
    from chronoweft.operators import joins

    middle = rows.withColumn("_m", (F.col("start") + F.col("end")) / 2)
    inside = joins.in_ranges(middle, windows, "_m", 0)
    return middle.join(inside.select(KEY, "ord"), [KEY, "ord"], "left_anti").drop("_m").unionByName(fresh)
