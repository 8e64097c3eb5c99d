"""Loudness: envelopes, thresholds, grids of several microphones, and what they say about speech."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.operators import joins, sequences

KEY = "rec_id"
DIGITAL_SILENCE = -90.0
# The strengths of a clean-up, as share of the way from the room to the voice, pauses and margins in seconds.
TUNING = {
    "strong": {"share": 0.35, "min_pause": 0.30, "pre": 0.08, "post": 0.10, "min_cut": 0.20, "min_clip": 0.10, "breath": 0.30},
    "balanced": {"share": 0.30, "min_pause": 0.50, "pre": 0.13, "post": 0.17, "min_cut": 0.20, "min_clip": 0.10, "breath": 0.25},
    "gentle": {"share": 0.25, "min_pause": 0.80, "pre": 0.15, "post": 0.20, "min_cut": 0.25, "min_clip": 0.10, "breath": 0.15},
}


def _w(*order: Column | str, by: list[str] | None = None) -> Window:
    return Window.partitionBy(*(by or [KEY])).orderBy(*order)


# ---- envelopes -----------------------------------------------------------------


def envelope(samples: DataFrame, rate: int, hop: float = 0.01) -> DataFrame:
    """Level of three hops around each hop: rec_id, i, db. samples: rec_id, n (from 0), v in -1 to 1. A last hop that isn't full is left out; the first and last stand for their missing neighbours; the floor is -120 dB."""
    per = max(1, math.floor(rate * hop + 0.5))
    energy = samples.groupBy(KEY, F.floor(F.col("n") / per).cast("long").alias("i")).agg(F.sum(F.col("v") * F.col("v")).alias("e"), F.count(F.lit(1)).alias("c")).filter(F.col("c") == per)
    w = _w("i")
    mean = (F.coalesce(F.lag("e").over(w), F.col("e")) + F.col("e") + F.coalesce(F.lead("e").over(w), F.col("e"))) / (3 * per)
    return energy.select(KEY, "i", F.when(mean > 1e-12, 10 * F.log10(mean)).otherwise(F.lit(-120.0)).alias("db"))


def mono(channels: DataFrame) -> DataFrame:
    """Mean of the channels: rec_id, n, v."""
    return channels.groupBy(KEY, "n").agg(F.avg("v").alias("v"))


def _hops(per: int):
    """Energies of the full hops of each file of 16-bit samples."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rec, raw in zip(part.column("rec_id").to_pylist(), part.column("content").to_pylist(), strict=True):
                v = np.frombuffer(raw, "<i2", len(raw) // 2).astype(float) / 32768.0
                v = v[: len(v) // per * per].reshape(-1, per)
                e = (v * v).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([rec] * len(e), pa.string()), pa.array(np.arange(len(e))), pa.array(e)], names=["rec_id", "i", "e"])

    return run


def pcm_envelope(files: DataFrame, rate: int, hop: float = 0.01) -> DataFrame:
    """As ``envelope``, of files of signed 16-bit little-endian samples: rec_id string, content binary. An odd last byte is left out."""
    per = max(1, math.floor(rate * hop + 0.5))
    energy = files.select(F.col(KEY).cast("string").alias(KEY), "content").mapInArrow(_hops(per), "rec_id string, i long, e double")
    w = _w("i")
    mean = (F.coalesce(F.lag("e").over(w), F.col("e")) + F.col("e") + F.coalesce(F.lead("e").over(w), F.col("e"))) / (3 * per)
    return energy.select(KEY, "i", F.when(mean > 1e-12, 10 * F.log10(mean)).otherwise(F.lit(-120.0)).alias("db"))


def step_levels(samples: DataFrame, rate: int, step: float) -> DataFrame:
    """Level of each step of samples, a last short one included: rec_id, i, db."""
    per = max(1, math.floor(rate * step + 0.5))
    return samples.groupBy(KEY, F.floor(F.col("n") / per).cast("long").alias("i")).agg((10 * F.log10(F.greatest(F.lit(1e-9), F.avg(F.col("v") * F.col("v"))))).alias("db"))


def fixed_silences(samples: DataFrame, rate: int, threshold_db: float = -40.0, window: float = 0.05, hop: float = 0.01) -> DataFrame:
    """Ranges in which the level of a sliding window stays below a fixed threshold: rec_id, start, end. A range that is open at the end ends with the samples."""
    size, step = max(1, math.floor(window * rate + 0.5)), max(1, math.floor(hop * rate + 0.5))
    power = F.avg(F.col("v") * F.col("v")).over(_w("n").rowsBetween(Window.currentRow, size - 1))
    total = F.max("n").over(Window.partitionBy(KEY)) + 1
    rows = samples.withColumn("_p", power).withColumn("_all", total).filter((F.col("n") % step == 0) & (F.col("n") + size <= F.col("_all")))
    rows = rows.withColumn("loud", F.sqrt("_p") >= F.lit(10 ** (threshold_db / 20))).withColumn("i", F.col("n") / step)
    quiet = sequences.runs(rows, "loud", "i").filter("not loud")
    ends = rows.groupBy(KEY).agg(F.max("i").alias("_last"), F.max("_all").alias("_all"))
    end = F.when(F.col("last") == F.col("_last"), F.col("_all") / rate).otherwise((F.col("last") + 1) * step / rate)
    return quiet.join(ends, KEY).select(KEY, (F.col("first") * step / rate).alias("start"), end.alias("end"))


def refine_silences(ranges: DataFrame, min_silence: float = 0.6, padding: float = 0.12, gap: float = 0.05, total: float | None = None) -> DataFrame:
    """Silences joined over small gaps, no shorter than ``min_silence``, less padding but at the media's ends."""
    from chronoweft.operators.intervals import merge

    long = merge(ranges, gap).filter(F.col("end") - F.col("start") >= F.lit(min_silence))
    start = F.when(F.col("start") <= 0.001, F.col("start")).otherwise(F.col("start") + F.lit(padding))
    end = F.col("end") - F.lit(padding)
    if total:
        end = F.when(F.col("end") >= F.lit(total - 0.001), F.col("end")).otherwise(end)
    return long.select(KEY, start.alias("start"), end.alias("end")).filter(F.col("end") - F.col("start") >= F.lit(max(0.05, min_silence - 2 * padding)))


# ---- thresholds ----------------------------------------------------------------


def mic_levels(levels: DataFrame, share: float = 0.30, value: str = "db", by: list[str] | None = None, least: int = 30) -> DataFrame:
    """Room, voice and gate of each microphone: floor, speech, span, threshold, continuous, digital.

    Levels at digital silence are left out; with fewer than ``least`` others the microphone is digital.  The floor is
    the tenth percentile, the voice the sixtieth of what is more than 6 dB above it (floor + 6 if that is too
    little), both nearest ranks.  The gate lies ``share`` of the way up but 8 dB below the voice; with less than
    10 dB between the two only digital silence is quiet.
    """
    by = by or [KEY]
    used = levels.filter(F.col(value) > DIGITAL_SILENCE).select(*by, F.col(value).alias("v"))
    floor = sequences.nearest_rank(used, "v", 0.10, by=by, name="floor")
    above = used.join(floor, by).filter(F.col("v") > F.col("floor") + 6).select(*by, "v")
    n = used.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    na = above.groupBy(*by).agg(F.count(F.lit(1)).alias("na"))
    voice = sequences.nearest_rank(above, "v", 0.6, by=by, name="voice")
    all_ = levels.select(*by).distinct().join(n, by, "left").join(floor, by, "left").join(na, by, "left").join(voice, by, "left")
    digital = F.coalesce(F.col("n"), F.lit(0)) < least
    speech = F.when(F.coalesce(F.col("na"), F.lit(0)) >= least, F.col("voice")).otherwise(F.col("floor") + 6)
    span = speech - F.col("floor")
    gate = F.when(span < 10, F.lit(DIGITAL_SILENCE)).otherwise(F.col("floor") + F.least(F.lit(share) * span, span - 8))
    return all_.select(
        *by,
        F.when(~digital, F.col("floor")).alias("floor"), F.when(~digital, speech).alias("speech"), F.when(digital, F.lit(0.0)).otherwise(span).alias("span"),
        F.when(digital, F.lit(DIGITAL_SILENCE)).otherwise(gate).alias("threshold"), (~digital & (span < 10)).alias("continuous"), digital.alias("digital"),
    )


def pause_share(levels: DataFrame, thresholds: DataFrame, min_seconds: float = 1.0, hop: float = 0.01, ord: str = "i") -> DataFrame:
    """Share of the windows in quiet runs of at least ``min_seconds``: rec_id, share. thresholds: rec_id, threshold."""
    need = max(1, math.floor(min_seconds / hop + 0.5))
    flags = sequences.hysteresis(levels.join(thresholds.select(KEY, "threshold"), KEY), F.col("threshold"), ord=ord)
    quiet = sequences.runs(flags, "loud", ord).filter(~F.col("loud") & (F.col("n") >= need)).groupBy(KEY).agg(F.sum("n").alias("p"))
    return levels.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).join(quiet, KEY, "left").select(KEY, (F.coalesce("p", F.lit(0)) / F.col("n")).alias("share"))


def track_says(name: Column | str) -> Column:
    """What a track's name says: music, voice or nothing. Only what stands after the last › counts."""
    own = F.trim(F.element_at(F.split(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")), "›"), -1))
    # Words that name music and voices.
    music = r"(?i)(^|[^a-z0-9])(music|musics|bgm|bg music|songs?|score|beats?|background|instrumental|gaana|gana|sangeet)(?![a-z0-9])|संगीत|गाना|गीत|म्यूजिक|म्यूज़िक"
    voice = r"(?i)(^|[^a-z0-9])(voices?|vo|v\.o\.?|mics?|microphone|host|guest|dialog|dialogue|narration|narrator|interview|speaker)(?![a-z0-9])"
    m, v = own.rlike(music), own.rlike(voice)
    return F.when(m & ~v, F.lit("music")).when(v & ~m, F.lit("voice")).otherwise(F.lit(""))


# ---- several microphones on one grid -----------------------------------------------


def combine(sources: DataFrame, levels: DataFrame, totals: DataFrame, hop: float = 0.01, slack: float = 1e-9) -> DataFrame:
    """All microphones of a recording on one grid: rec_id, slot, state, strong, peak, rel.

    state is 0 without a microphone, 1 where all are quiet and 2 where one is loud; a source without levels is loud
    and strong, a slot outside its levels loud.  sources: rec_id, source, media, seq_start, seq_end, in_point, speed,
    strong_db, speech_db; levels: media, i, db, loud (of hops from 0); totals: rec_id, total.
    """
    n = F.greatest(F.lit(0), F.ceil(F.col("total") / F.lit(hop) - F.lit(slack))).cast("long")
    edge = lambda c: F.ceil(F.col(c) / F.lit(hop) - 0.5 - F.lit(slack)).cast("long")
    placed = sources.join(totals, KEY).withColumn("_g0", F.greatest(F.lit(0), edge("seq_start"))).withColumn("_g1", F.least(n, edge("seq_end"))).filter("_g1 > _g0")
    speed = F.when(F.col("speed") > 0, F.col("speed")).otherwise(F.lit(1.0))
    cells = placed.withColumn("slot", F.explode(F.sequence("_g0", F.col("_g1") - 1)))
    media = F.col("in_point") + ((F.col("slot") + 0.5) * F.lit(hop) - F.col("seq_start")) * speed
    cells = cells.withColumn("i", F.floor(media / F.lit(hop)).cast("long"))
    known = levels.select("media").distinct().withColumn("_known", F.lit(True))
    cells = cells.join(known, "media", "left").join(levels.select("media", "i", "db", "loud"), ["media", "i"], "left")
    blind = F.col("_known").isNull()
    per = cells.groupBy(KEY, "slot").agg(
        F.bool_or(F.when(F.col("db").isNull(), F.lit(True)).otherwise(F.col("loud"))).alias("_loud"),
        F.bool_or(blind | F.coalesce(F.col("db") > F.col("strong_db"), F.lit(False))).alias("strong"),
        F.coalesce(F.max("db"), F.lit(-200.0)).alias("peak"), F.coalesce(F.max(F.col("db") - F.col("speech_db")), F.lit(-200.0)).alias("rel"),
    )
    spine = totals.select(KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), n - 1))).alias("slot"))
    return spine.join(per, [KEY, "slot"], "left").select(
        KEY, "slot", F.when(F.col("_loud").isNull(), 0).when(F.col("_loud"), 2).otherwise(1).alias("state"),
        F.coalesce("strong", F.lit(False)).alias("strong"), F.coalesce("peak", F.lit(-200.0)).alias("peak"), F.coalesce("rel", F.lit(-200.0)).alias("rel"),
    )


def plan_cuts(grid: DataFrame, tune: dict[str, float], hop: float = 0.01, passes: int = 4, slack: float = 1e-9) -> DataFrame:
    """Cuts of a grid: rec_id, start, end.

    A loud stretch between two pauses joins them if it is shorter than ``min_clip``, or shorter than ``breath``
    without a strong slot; this is repeated at most four times.  Pauses of ``min_pause`` or more become cuts, less the
    margins kept beside speech, and stay if ``min_cut`` is left.
    """
    rows = grid.withColumn("_s", F.col("strong").cast("int"))
    r = sequences.runs(rows, "state", "slot")
    strong = sequences.runs(rows, "state", "slot").select(KEY, "run", "first", "last")
    del strong
    numbered = rows.withColumn("_new", F.when(F.lag("state").over(_w("slot")) == F.col("state"), 0).otherwise(1)).withColumn("run", F.sum("_new").over(_w("slot")).cast("long"))
    r = numbered.groupBy(KEY, "run", "state").agg(F.min("slot").alias("first"), F.max("slot").alias("last"), F.max("_s").alias("strong"))
    for _ in range(passes):
        w = _w("first")
        length = (F.col("last") - F.col("first") + 1) * F.lit(hop)
        weak = (length < F.lit(tune["min_clip"] - slack)) | ((length < F.lit(tune["breath"] - slack)) & (F.col("strong") == 0))
        between = (F.lag("state").over(w) == 1) & (F.lead("state").over(w) == 1)
        r = r.withColumn("_w", F.coalesce((F.col("state") == 2) & between & weak, F.lit(False))).withColumn("state", F.when(F.col("_w"), 1).otherwise(F.col("state"))).drop("_w")
        joined = r.withColumn("_new", F.when(F.lag("state").over(w) == F.col("state"), 0).otherwise(1)).withColumn("run", F.sum("_new").over(w))
        r = joined.groupBy(KEY, "run", "state").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("strong").alias("strong"))
    w = _w("first")
    r = r.withColumn("_before", F.lag("state").over(w)).withColumn("_after", F.lead("state").over(w))
    s, e = F.col("first") * F.lit(hop), (F.col("last") + 1) * F.lit(hop)
    start = s + F.when(F.coalesce(F.col("_before"), F.lit(2)) == 2, F.lit(tune["post"])).otherwise(0.0)
    end = e - F.when(F.coalesce(F.col("_after"), F.lit(2)) == 2, F.lit(tune["pre"])).otherwise(0.0)
    long = r.filter((F.col("state") == 1) & (e - s >= F.lit(tune["min_pause"] - slack)))
    return long.select(KEY, start.alias("start"), end.alias("end")).filter(F.col("end") - F.col("start") >= F.lit(tune["min_cut"] - slack))


def versus_others(grid: DataFrame, own: DataFrame, least: int = 50) -> DataFrame:
    """How a track behaves while the others talk and pause: rec_id, talk, quiet, share, turn. own: rec_id, slot, db of the track; grid: of the others.

    share is the time the others talk of the time they are heard; turn is how much louder the track is in their
    pauses, as the difference of nearest-rank ninetieth percentiles, 0 if either side is shorter than ``least`` slots.
    """
    both = grid.filter("state > 0").join(own.filter(F.col("db") > DIGITAL_SILENCE), [KEY, "slot"]).withColumn("side", F.when(F.col("state") == 2, F.lit("talk")).otherwise(F.lit("quiet")))
    counts = both.groupBy(KEY).agg(F.count(F.when(F.col("side") == "talk", 1)).alias("talk"), F.count(F.when(F.col("side") == "quiet", 1)).alias("quiet"))
    tops = sequences.nearest_rank(both, "db", 0.9, by=[KEY, "side"], name="top").groupBy(KEY).agg(F.max(F.when(F.col("side") == "talk", F.col("top"))).alias("_t"), F.max(F.when(F.col("side") == "quiet", F.col("top"))).alias("_q"))
    turn = F.when((F.col("talk") >= least) & (F.col("quiet") >= least), F.col("_q") - F.col("_t")).otherwise(0.0)
    return counts.join(tops, KEY).select(KEY, "talk", "quiet", (F.col("talk") / (F.col("talk") + F.col("quiet"))).alias("share"), turn.alias("turn"))


def wordless_noise(words: DataFrame, grid: DataFrame, totals: DataFrame, bar: float, tune: dict[str, float], hop: float = 0.01, min_gap: float = 1.0) -> DataFrame:
    """Gaps between words of at least ``min_gap`` whose ninetieth percentile of the peak stays below ``bar``: rec_id, start, end, less the margins."""
    spoken = words.filter("end > start").select(KEY, "start", "end")
    tail = totals.select(KEY, F.col("total").alias("start"), F.lit(None).cast("double").alias("end"))
    rows = spoken.unionByName(tail.join(spoken.select(KEY).distinct(), KEY, "left_semi"))
    w = _w(F.col("end").isNull(), "start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_prev", before).filter(F.col("start") - F.coalesce("_prev", F.lit(0.0)) >= F.lit(min_gap))
    a = F.when(F.col("_prev").isNull(), F.lit(0.0)).otherwise(F.col("_prev") + F.lit(tune["post"]))
    b = F.when(F.col("end").isNull(), F.col("start")).otherwise(F.col("start") - F.lit(tune["pre"]))
    gaps = rows.select(KEY, a.alias("_a"), b.alias("_b")).filter(F.col("_b") - F.col("_a") >= F.lit(tune["min_cut"]))
    slots = gaps.withColumn("_g0", F.greatest(F.lit(0), F.ceil(F.col("_a") / F.lit(hop))).cast("long")).withColumn("_g1", F.floor(F.col("_b") / F.lit(hop)).cast("long")).filter("_g1 > _g0")
    cells = slots.withColumn("slot", F.explode(F.sequence("_g0", F.col("_g1") - 1))).join(grid.filter("state <> 0").select(KEY, "slot", "peak"), [KEY, "slot"])
    top = sequences.nearest_rank(cells, "peak", 0.9, by=[KEY, "_a", "_b"], name="top")
    return top.filter(F.col("top") < F.lit(bar)).select(KEY, F.col("_a").alias("start"), F.col("_b").alias("end"))


def coverage(grid: DataFrame, step: float) -> DataFrame:
    """Share of windows in which any and all microphones are heard: rec_id, windows, any_share, all_share. grid: rec_id, mic, w, db."""
    mics = F.size(F.collect_set("mic").over(Window.partitionBy(KEY)))
    per = grid.withColumn("_m", mics).groupBy(KEY, "w").agg(F.count(F.when(F.coalesce(F.col("db") > -99, F.lit(False)), 1)).alias("h"), F.max("_m").alias("m"))
    return per.groupBy(KEY).agg((F.max("w") + 1).alias("windows"), F.count(F.when(F.col("h") > 0, 1)).alias("_any"), F.count(F.when(F.col("h") == F.col("m"), 1)).alias("_all")).select(
        KEY, "windows", (F.col("_any") / F.col("windows")).alias("any_share"), (F.col("_all") / F.col("windows")).alias("all_share")
    )


def mic_coverage(grid: DataFrame, step: float) -> DataFrame:
    """Each microphone's share of windows heard and the end of the last: rec_id, mic, heard, last_heard."""
    n = grid.groupBy(KEY).agg((F.max("w") + 1).alias("n"))
    h = F.coalesce(F.col("db") > -99, F.lit(False))
    per = grid.groupBy(KEY, "mic").agg(F.count(F.when(h, 1)).alias("c"), F.max(F.when(h, F.col("w") + 1)).alias("l"))
    return per.join(n, KEY).select(KEY, "mic", (F.col("c") / F.col("n")).alias("heard"), (F.coalesce("l", F.lit(0)) * F.lit(step)).alias("last_heard"))


def separation(grid: DataFrame, a: str, b: str) -> DataFrame:
    """Nearest-rank percentiles of the difference of two microphones where both are heard: rec_id, n, p50, p75, p90."""
    x, y = (grid.filter((F.col("mic") == m) & (F.col("db") > -99)).select(KEY, "w", F.col("db").alias(n)) for m, n in ((a, "x"), (b, "y")))
    d = x.join(y, [KEY, "w"]).select(KEY, F.abs(F.col("x") - F.col("y")).alias("d"))
    out = d.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    for p in (50, 75, 90):
        out = out.join(sequences.nearest_rank(d, "d", p / 100, "exclusive", name=f"p{p}"), KEY)
    return out


def grid_from_clips(clips: DataFrame, levels: DataFrame, step: float, floor: float = -98.5, slack: float = 1e-9) -> DataFrame:
    """Media levels on the timeline's windows: rec_id, mic, w, db; the mean power of the media windows that a timeline window plays. Windows without a clip are not there (-100 by convention); where clips overlap the later counts.

    clips: rec_id, mic, clip (order), media, seq_start, seq_end, in_point, out_point, speed, reversed; levels: media, i, db.
    """
    speed = F.when(F.coalesce(F.col("speed"), F.lit(0.0)) > 0, F.col("speed")).otherwise(F.lit(1.0))
    length = F.col("seq_end") - F.col("seq_start")
    out = F.when(F.col("out_point") > F.col("in_point"), F.col("out_point")).otherwise(F.col("in_point") + length * speed)
    edge = lambda t: F.ceil(t / F.lit(step) - 0.5).cast("long")
    rows = clips.filter(length > 0).withColumn("_v", speed).withColumn("_o", out).withColumn("_k0", F.greatest(F.lit(0), edge(F.col("seq_start")))).withColumn("_k1", edge(F.col("seq_end"))).filter("_k1 > _k0")
    rows = rows.withColumn("w", F.explode(F.sequence("_k0", F.col("_k1") - 1)))
    a0, a1 = (F.col("w") * F.lit(step) - F.col("seq_start")) * F.col("_v"), ((F.col("w") + 1) * F.lit(step) - F.col("seq_start")) * F.col("_v")
    back = F.coalesce("reversed", F.lit(False))
    m0, m1 = F.when(back, F.col("_o") - a1).otherwise(F.col("in_point") + a0), F.when(back, F.col("_o") - a0).otherwise(F.col("in_point") + a1)
    j0 = F.greatest(F.lit(0), F.floor(m0 / F.lit(step) + F.lit(slack))).cast("long")
    j1 = F.greatest(j0, F.ceil(m1 / F.lit(step) - F.lit(slack)).cast("long") - 1)
    cells = rows.withColumn("_j0", j0).withColumn("_j1", j1).withColumn("i", F.explode(F.sequence("_j0", "_j1")))
    found = cells.join(levels.filter(F.col("db").isNotNull() & ~F.isnan("db")), ["media", "i"])
    power = F.avg(F.pow(F.lit(10.0), F.greatest(F.lit(floor), F.col("db")) / 10))
    per = found.groupBy(KEY, "mic", "w", "clip").agg(F.greatest(F.lit(floor), 10 * F.log10(power)).alias("db"))
    return per.groupBy(KEY, "mic", "w").agg(F.max_by("db", "clip").alias("db"))


def estimate_offset(grid: DataFrame, a: str, b: str, step: float = 0.2, max_lag: float = 2.5) -> DataFrame:
    """The lag at which two microphones' levels agree best: rec_id, lag (steps), offset. Levels are taken from their mean where heard and 0 elsewhere; of equal scores the first lag counts, and recordings shorter than four windows have 0."""
    most = max(1, math.floor(max_lag / step + 0.5))
    h = F.col("db") > -99
    rows = grid.filter(F.col("mic").isin(a, b))
    mean = F.avg(F.when(h, F.col("db"))).over(Window.partitionBy(KEY, "mic"))
    rows = rows.withColumn("v", F.when(F.coalesce(h, F.lit(False)), F.col("db") - mean).otherwise(0.0))
    n = rows.groupBy(KEY, "mic").agg((F.max("w") + 1).alias("n")).groupBy(KEY).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("c")).filter("c = 2").select(KEY, "n")
    x = rows.filter(F.col("mic") == a).select(KEY, "w", F.col("v").alias("x")).join(n, KEY).filter("w < n")
    y = rows.filter(F.col("mic") == b).select(KEY, F.col("w").alias("j"), F.col("v").alias("y")).join(n.select(KEY, F.col("n").alias("_n")), KEY).filter("j < _n")
    pairs = x.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("j", F.col("w") + F.col("lag")).join(y, [KEY, "j"])
    scores = pairs.groupBy(KEY, "lag").agg(F.avg(F.col("x") * F.col("y")).alias("s"), F.count(F.lit(1)).alias("c"), F.max("n").alias("n")).filter((F.col("c") > most) & (F.col("n") >= 4))
    best = scores.groupBy(KEY).agg(F.max_by("lag", F.struct("s", -F.col("lag"))).alias("lag"))
    return n.select(KEY).join(best, KEY, "left").select(KEY, F.coalesce("lag", F.lit(0)).alias("lag"), (F.coalesce("lag", F.lit(0)) * F.lit(step)).alias("offset"))


# ---- kernels over one recording ---------------------------------------------------------


def nearest(values: np.ndarray, p: float, rule: str = "inclusive") -> float:
    """As ``sequences.nearest_rank``, of an array."""
    v = np.sort(values)
    at = {"inclusive": math.floor(p * (len(v) - 1)), "exclusive": min(len(v) - 1, math.floor(len(v) * p)), "middle": len(v) // 2}[rule]
    return float(v[max(0, at)])


def speech_runs_of(t: np.ndarray, db: np.ndarray, sensitivity: float = 0.18, min_silence: float = 0.08) -> list[tuple[float, float]]:
    """Runs of speech in coarse levels, over a gate between the tenth and ninety-fifth percentile; shorter gaps are bridged and a run still open ends at the last level."""
    if not len(db):
        return []
    db = np.where(np.isfinite(db), db, -100.0)
    low, top = nearest(db, 0.10, "exclusive"), nearest(db, 0.95, "exclusive")
    if not top > low:
        return []
    loud = np.flatnonzero(db >= low + (top - low) * sensitivity)
    out: list[tuple[float, float]] = []
    first = 0
    for k in range(1, len(loud) + 1):
        if k < len(loud):
            quiet = np.arange(loud[k - 1] + 1, loud[k])
            # a gap counts from its first quiet level to its last
            if not len(quiet) or t[quiet[-1]] - t[quiet[0]] < min_silence:
                continue
            out.append((float(t[loud[first]]), float(t[quiet[0]])))
            first = k
        else:
            rest = np.arange(loud[-1] + 1, len(t))
            closed = len(rest) and t[rest[-1]] - t[rest[0]] >= min_silence
            out.append((float(t[loud[first]]), float(t[rest[0]] if closed else t[-1])))
    return out


def onsets_of(t: np.ndarray, db: np.ndarray, rise: float = 6.0, spacing: float = 0.12) -> list[float]:
    """Times at which the level climbs over its thirtieth percentile + ``rise``, at least ``spacing`` apart."""
    if len(t) < 2:
        return []
    above = db >= nearest(db, 0.3, "exclusive") + rise
    edges = t[above & ~np.concatenate(([False], above[:-1]))]
    out: list[float] = []
    for x in edges:
        if not out or x - out[-1] >= spacing:
            out.append(float(x))
    return out


def bursts_of(t: np.ndarray, db: np.ndarray, share: float = 0.4, offset: float = 8.0, min_gap: float = 0.6) -> list[float]:
    """Starts of talk: the level climbs over a floor + ``offset`` after ``min_gap`` of quiet; the first counts whatever precedes it."""
    if not len(t):
        return []
    loud = db >= nearest(db, share, "exclusive") + offset
    starts: list[float] = []
    quiet_since: float | None = None
    for k in range(len(t)):
        if loud[k] and (k == 0 or not loud[k - 1]) and (not starts or quiet_since is None or t[k] - quiet_since >= min_gap):
            starts.append(float(t[k]))
        if loud[k]:
            quiet_since = None
        elif k and loud[k - 1]:
            quiet_since = float(t[k])
    return starts


def values(column: pa.Array | pa.ChunkedArray) -> list:
    """A column as Python's values: null is None."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    plain = not c.null_count or pa.types.is_string(c.type)
    return c.to_numpy(zero_copy_only=False).tolist() if plain and not pa.types.is_nested(c.type) and not pa.types.is_temporal(c.type) else c.to_pylist()


def records(column: pa.ListArray) -> list[list[dict]]:
    """Lists of structs as lists of dicts, made from the fields' columns instead of from each struct by itself. No list may be null."""
    flat = column.flatten()
    names = [f.name for f in flat.type]
    rows = [dict(zip(names, v, strict=True)) for v in zip(*(values(x) for x in flat.flatten()), strict=True)]
    ends = [0, *np.cumsum(column.value_lengths().to_numpy()).tolist()]
    return [rows[a:b] for a, b in pairwise(ends)]


def per_recording(rows: DataFrame, kernel, schema: str) -> DataFrame:
    """Apply a kernel on the frame of each recording; it returns a list of tuples without the key. The key's type stays."""
    kind = rows.schema[KEY].dataType.simpleString()
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(list(kernel(frame)), columns=names)
        out.insert(0, KEY, frame[KEY].iloc[0] if len(frame) else None)
        return out

    return rows.groupBy(KEY).applyInPandas(run, f"{KEY} {kind}, {schema}")


def speech_runs(samples: DataFrame, sensitivity: float = 0.18, min_silence: float = 0.08) -> DataFrame:
    """Runs of speech: rec_id, start, end. samples: rec_id, t, db."""
    return per_recording(samples, lambda f: speech_runs_of(*f.sort_values("t")[["t", "db"]].to_numpy(float).T, sensitivity, min_silence), "start double, end double")


def onsets(samples: DataFrame, rise: float = 6.0, spacing: float = 0.12) -> DataFrame:
    return per_recording(samples, lambda f: [(x,) for x in onsets_of(*f.sort_values("t")[["t", "db"]].to_numpy(float).T, rise, spacing)], "t double")


def burst_starts(samples: DataFrame, share: float = 0.4, offset: float = 8.0, min_gap: float = 0.6) -> DataFrame:
    return per_recording(samples, lambda f: [(x,) for x in bursts_of(*f.sort_values("t")[["t", "db"]].to_numpy(float).T, share, offset, min_gap)], "t double")


def two_modes(values: np.ndarray, separation: float = 6.0, least_count: int = 10, least_share: float = 0.01) -> dict | None:
    """Two peaks of a smoothed half-dB histogram with a valley between them: lo, hi, n_lo, n_hi, spread (robust); None without two."""
    n = len(values)
    if n < 20:
        return None
    low, high = nearest(values, 0.002, "exclusive"), nearest(values, 0.998, "exclusive")
    if not high - low >= separation:
        return None
    width, sigma = 0.5, 1.5
    bins = math.floor((high - low) / width) + 1
    inside = values[(values >= low) & (values <= high)]
    counts = np.bincount(np.minimum(bins - 1, np.floor((inside - low) / width).astype(int)), minlength=bins).astype(float)
    reach = math.ceil(3 * sigma / width)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) * width / sigma) ** 2)
    smooth = np.convolve(counts, kernel)[reach : reach + bins]
    left, right = np.concatenate(([-1.0], smooth[:-1])), np.concatenate((smooth[1:], [-1.0]))
    peaks = sorted(np.flatnonzero((smooth > 0) & (smooth >= left) & (smooth > right)), key=lambda b: -smooth[b])
    if len(peaks) < 2:
        return None
    first = peaks[0]
    second = next((q for q in peaks[1:] if abs(q - first) * width >= separation and smooth[min(first, q) : max(first, q) + 1].min() <= 0.6 * smooth[q]), None)
    if second is None:
        return None

    def around(b: int) -> tuple[float, int]:
        centre = low + (b + 0.5) * width
        own = values[np.abs(values - centre) <= separation / 2]
        return (float(own.mean()), len(own)) if len(own) else (centre, 0)

    one, two = around(first), around(second)
    if two[1] < max(least_count, least_share * n):
        return None
    lo, hi = sorted((one, two))
    away = np.abs(values - np.where(values < (lo[0] + hi[0]) / 2, lo[0], hi[0]))
    return {"lo": lo[0], "hi": hi[0], "n_lo": lo[1], "n_hi": hi[1], "spread": 1.4826 * nearest(away, 0.5, "exclusive")}


def gain_offsets(grids: list[np.ndarray], **options) -> dict:
    """Per-microphone gain against the first usable one, from where the level differences of two voices lie; without two voices from the noise floors. grids: dB per window, below -99 unheard."""
    heard = [g[g > -99] for g in grids]
    usable = [len(h) >= 20 for h in heard]
    floors = [nearest(h, 0.05, "exclusive") if len(h) else -100.0 for h in heard]
    peaks = [nearest(h, 0.95, "exclusive") if len(h) else -100.0 for h in heard]
    out = {"ref": next((k for k, u in enumerate(usable) if u), -1), "offsets": [0.0] * len(grids), "isolation": [None] * len(grids), "spread": [None] * len(grids), "method": ["floor" if u else "none" for u in usable], "floors": floors, "peaks": peaks}
    ref = out["ref"]
    if ref >= 0:
        out["method"][ref] = "ref"
        n = max(len(g) for g in grids)
        full = np.full((len(grids), n), -100.0)
        for k, g in enumerate(grids):
            full[k, : len(g)] = g
        over = np.where((full > -99) & np.array(usable)[:, None], full - np.array(peaks)[:, None], -np.inf)
        for m, g in enumerate(full):
            if m == ref or not usable[m]:
                continue
            use = (full[ref] > -99) & (g > -99)
            low_ref = full[ref] - floors[ref] < 0.5 * (peaks[ref] - floors[ref])
            use &= ~(low_ref & (g - floors[m] < 0.5 * (peaks[m] - floors[m])))
            if len(grids) > 2:
                use &= np.isin(over.argmax(axis=0), (m, ref))
            modes = two_modes((full[ref] - g)[use], **options)
            if modes:
                out["offsets"][m], out["isolation"][m], out["spread"][m], out["method"][m] = (modes["lo"] + modes["hi"]) / 2, (modes["hi"] - modes["lo"]) / 2, modes["spread"], "voices"
            else:
                out["offsets"][m] = floors[ref] - floors[m]
    middle = lambda v: (lambda s: s[len(s) // 2] if s else None)(sorted(x for x in v if x is not None))
    return out | {"cross_isolation": middle(out["isolation"]), "cross_spread": middle(out["spread"])}


def _as_grids(frame: pd.DataFrame) -> list[np.ndarray]:
    """Levels per microphone, in order of its name, -100 where there is none."""
    mics, n = sorted(frame["mic"].unique()), int(frame["w"].max()) + 1
    out = []
    for m in mics:
        own = frame[frame["mic"] == m]
        g = np.full(n, -100.0)
        g[own["w"].to_numpy(int)] = own["db"].fillna(-100.0).to_numpy(float)
        out.append(g)
    return out


def mic_gains(grid: DataFrame) -> DataFrame:
    """rec_id, mic, gain, isolation, method. grid: rec_id, mic, w, db."""

    def kernel(frame: pd.DataFrame):
        found = gain_offsets(_as_grids(frame))
        return [(str(m), found["offsets"][k], found["isolation"][k], found["method"][k]) for k, m in enumerate(sorted(frame["mic"].unique()))]

    return per_recording(grid, kernel, "mic string, gain double, isolation double, method string")


def quiet_stretches_of(state: np.ndarray, peak: np.ndarray, bar: float, hop: float = 0.01, rel: np.ndarray | None = None, mics: int = 1, min_length: float = 1.5, step: float = 0.25, pad: float = 0.35, min_rise: float = 0.6) -> list[tuple[float, float]]:
    """Stretches of whole steps in which the level stays below the voice, for ``min_length`` or longer, their edges moved into hush.

    With one microphone the levels are trusted only if most of the talk rises over the bar.  An end that finds no
    hush within 0.6 s, or an outer end with a loud slot, drops the stretch.
    """
    n, per = len(state), max(1, round(step / hop))
    steps = n // per
    level, top, strict = (peak, bar, mics > 1) if rel is None else (rel, 3.0, mics > 1)
    over = (state != 0) & (level >= top)
    span = max(1, round(min_length / step))
    talk = rises = 0
    for w in range(0, steps - span + 1, span):
        part = slice(w * per, (w + span) * per)
        if 2 * int((state[part] == 2).sum()) >= span * per:
            talk += 1
            rises += bool(over[part].any())
    if not strict and talk and rises / talk < min_rise:
        return []
    busy = over | (strict & (state == 2))
    quiet = ~busy[: steps * per].reshape(steps, per).any(axis=1) if steps else np.zeros(0, bool)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], quiet.astype(int), [0]))))
    window, most = round(0.25 / hop), round(0.6 / hop)
    out = []
    for k, e in edges.reshape(-1, 2):
        if (e - k) * per * hop < min_length:
            continue
        start, end = k * per * hop + (pad if k else 0.0), e * per * hop - (pad if e < steps else 0.0)
        own = slice(k * per, e * per)
        used = peak[own][state[own] != 0]
        soft = min(bar - 9, (nearest(used, 0.1) if len(used) else -math.inf) + 6)

        def hush(g: int) -> bool:
            lo, hi = max(0, g), min(n, g + window)
            return not (peak[lo:hi] >= soft).any()

        def walk(g: int, way: int) -> int:
            return next((s for s in range(most) if hush(g + way * s - round(window / 2))), most)

        sure = True
        for outer, way in ((k > 0, 1), (e < steps, -1)):
            if outer:
                moved = walk(round((start if way > 0 else end) / hop), way)
                sure &= moved < most
                if way > 0:
                    start += moved * hop
                else:
                    end -= moved * hop
        if (k == 0 or e >= steps) and (state[own] == 2).any():
            sure = False
        if sure and end - start >= 0.2:
            out.append((start, end))
    return out


def quiet_stretches(grid: DataFrame, bar: float, hop: float = 0.01, mics: int = 1, relative: bool = False) -> DataFrame:
    """rec_id, start, end. grid: rec_id, slot, state, peak, rel."""

    def kernel(frame: pd.DataFrame):
        f = frame.sort_values("slot")
        return quiet_stretches_of(f["state"].to_numpy(int), f["peak"].to_numpy(float), bar, hop, f["rel"].to_numpy(float) if relative else None, mics)

    return per_recording(grid, kernel, "start double, end double")


def audible_words_of(words: list[dict], state: np.ndarray, peak: np.ndarray | None, bar: float | None, hop: float = 0.01, min_run: float = 0.06, bridge: float = 0.3, max_word: float = 2.5, lone: float = 0.8, edge: float = 1.0, drift: float = 0.25) -> list[dict]:
    """The loud stretches of each word. A word alone between pauses whose level stays below ``bar`` goes; a long word without digits keeps only stretches near its ends; a word without any stays if speech is near and it is short. Later stretches of a word carry no text."""
    n, out = len(state), []
    lengths = sorted(w["end"] - w["start"] for w in words)
    if len(words) < 3 or lengths[len(lengths) // 2] > 1.0:
        return words
    need, join = max(1, round(min_run / hop)), round(bridge / hop)
    for k, w in enumerate(words):
        s, e = w["start"], w["end"]
        apart = (k == 0 or s - words[k - 1]["end"] >= lone) and (k == len(words) - 1 or words[k + 1]["start"] - e >= lone)
        if bar is not None and peak is not None and apart:
            own = peak[max(0, math.floor(s / hop)) : min(n, math.ceil(e / hop))]
            if len(own) and nearest(own, 0.9) < bar:
                continue
        long = e - s > max_word and not any(c.isdigit() for c in w["text"] or "")
        g0, g1 = math.floor(s / hop + 1e-9), math.ceil(e / hop - 1e-9)
        if g1 <= 0 or g0 >= n or g1 <= g0:
            out.append(w)
            continue
        g0, g1 = max(0, g0), min(n, g1)
        on = (state[g0:g1] == 2) | (state[g0:g1] == 0)
        if (state[g0:g1] == 0).all():
            out.append(w)
            continue
        found: list[list[int]] = []
        for a, b in np.flatnonzero(np.diff(np.concatenate(([0], on.astype(int), [0])))).reshape(-1, 2) + g0:
            if (b - a >= need or 2 * (b - a) >= g1 - g0) and (not long or a * hop - s < edge or e - b * hop < edge):
                if found and a - found[-1][1] < join:
                    found[-1][1] = b
                else:
                    found.append([a, b])
        if not found:
            reach = round(drift / hop)
            if (state[max(0, g0 - reach) : min(n, g1 + reach)] == 2).any() and not long and e - s <= 1:
                out.append(w)
            continue
        for j, (a, b) in enumerate(found):
            out.append(w | {"start": max(s, a * hop), "end": min(e, b * hop)} | ({"text": ""} if j else {}))
    return out


def audible_words(words: DataFrame, grid: DataFrame, bar: float | None = None, hop: float = 0.01) -> DataFrame:
    """Heard stretches of words: rec_id, ord, start, end, text. words: rec_id, ord, start, end, text; grid: rec_id, slot, state, peak."""
    kind = words.schema[KEY].dataType.simpleString()

    def run(w: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("slot")
        rows = w.sort_values("ord")[["rec_id", "ord", "start", "end", "text"]].to_dict("records")
        found = audible_words_of(rows, g["state"].to_numpy(int), g["peak"].to_numpy(float), bar, hop) if len(g) else rows
        return pd.DataFrame(found, columns=["rec_id", "ord", "start", "end", "text"])

    return words.groupBy(KEY).cogroup(grid.groupBy(KEY)).applyInPandas(run, f"{KEY} {kind}, ord long, start double, end double, text string")


def in_regions(points: DataFrame, regions: DataFrame, at: str = "t") -> DataFrame:
    """Points in any region, start inclusive and end exclusive."""
    return joins.in_ranges(points, regions, at)
