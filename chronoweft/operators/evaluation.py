"""How close a machine's edit comes to a hand's, and where an edit's sound lies in its source."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "rec_id"


def mask(ranges: DataFrame, totals: DataFrame, keep: bool = True, step: float = 0.1) -> DataFrame:
    """Kept or not in steps: rec_id, i, kept. Ranges are what is kept (or, without ``keep``, cut)."""
    spine = totals.filter("total > 0").select(KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("total") / step).cast("long") - 1)).alias("i"))
    hit = ranges.select(KEY, F.floor(F.col("start") / step).cast("long").alias("_a"), (F.ceil(F.col("end") / step) - 1).cast("long").alias("_b")).filter("_b >= _a")
    hit = hit.select(KEY, F.explode(F.sequence("_a", "_b")).alias("i")).distinct().withColumn("_in", F.lit(True))
    return spine.join(hit, [KEY, "i"], "left").select(KEY, "i", (F.coalesce("_in", F.lit(False)) == F.lit(keep)).alias("kept"))


def confusion(machine: DataFrame, hand: DataFrame, voiced: DataFrame | None = None, step: float = 0.1) -> DataFrame:
    """Seconds that only one of two masks keeps: rec_id, machine_kept, hand_kept, only_machine, only_hand; with ``voiced`` (rec_id, i) steps without a voice don't count in the last two."""
    both = machine.join(hand.withColumnRenamed("kept", "hand"), [KEY, "i"])
    counts = F.lit(True)
    if voiced is not None:
        both = both.join(voiced.select(KEY, "i").distinct().withColumn("_v", F.lit(True)), [KEY, "i"], "left")
        counts = F.coalesce("_v", F.lit(False))
    n = lambda c: (F.count(F.when(c, 1)) * F.lit(step))
    return both.groupBy(KEY).agg(n(F.col("kept")).alias("machine_kept"), n(F.col("hand")).alias("hand_kept"), n(F.col("kept") & ~F.col("hand") & counts).alias("only_machine"), n(~F.col("kept") & F.col("hand") & counts).alias("only_hand"))


def regions(flags: DataFrame, least: int = 4, step: float = 0.1) -> DataFrame:
    """Runs of at least ``least`` steps for which ``flag`` holds: rec_id, start, end."""
    from chronoweft.operators.sequences import runs

    return runs(flags, "flag").filter(F.col("flag") & (F.col("n") >= least)).select(KEY, (F.col("first") * step).alias("start"), ((F.col("last") + 1) * step).alias("end"))


def log_mel(samples: np.ndarray, rate: int = 16000, bands: int = 40) -> np.ndarray:
    """A hundred frames a second of log energies in mel bands, each band's and each frame's mean taken off."""
    hop, size = rate // 100, rate // 40
    n = max(0, (len(samples) - size) // hop + 1)
    if not n:
        return np.zeros((0, bands))
    at = np.arange(n)[:, None] * hop + np.arange(size)
    power = np.abs(np.fft.rfft(samples[at].astype(float) * np.hanning(size), 512)) ** 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(80.0), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(512, 1 / rate)
    bank = np.maximum(0, np.minimum((f - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - f) / np.diff(edges)[1:, None]))
    out = np.log(power @ bank.T + 1e-9)
    out -= out.mean(axis=0)
    return out - out.mean(axis=1, keepdims=True)


def match_windows(edit: np.ndarray, source: np.ndarray, window: int = 100, step: int = 50, least: float = 0.75) -> list[tuple[int, int, float]]:
    """For each window of the edit its best place in the source, at or after the last one, with a cosine of at least ``least``: edit frame, source frame, cosine."""
    out, floor = [], 0
    if len(source) < window:
        return out
    views = np.lib.stride_tricks.sliding_window_view(source, (window, source.shape[1]))[:, 0]
    norm = np.sqrt(np.concatenate(([0.0], np.cumsum((source**2).sum(axis=1))))[window:] - np.concatenate(([0.0], np.cumsum((source**2).sum(axis=1))))[:-window]) + 1e-9
    for e in range(0, len(edit) - window + 1, step):
        own = edit[e : e + window]
        cosine = np.tensordot(views[floor:], own, axes=((1, 2), (0, 1))) / (norm[floor:] * (np.linalg.norm(own) + 1e-9))
        k = int(cosine.argmax()) if len(cosine) else -1
        if k >= 0 and cosine[k] >= least:
            out.append((e, floor + k, float(cosine[k])))
            floor += k
    return out


def matched_ranges(hits: DataFrame, slack: float = 0.06, gap: float = 2.0, least: int = 3) -> DataFrame:
    """Hits of one offset as ranges: rec_id, e0, e1, offset. hits: rec_id, e, o (seconds)."""
    w = Window.partitionBy(KEY).orderBy("e")
    off = F.col("o") - F.col("e")
    fresh = F.when((F.abs(off - (F.lag("o").over(w) - F.lag("e").over(w))) <= slack) & (F.col("e") - F.lag("e").over(w) < gap), 0).otherwise(1)
    runs = hits.withColumn("_n", fresh).withColumn("_g", F.sum("_n").over(w))
    return runs.groupBy(KEY, "_g").agg(F.min("e").alias("e0"), F.max("e").alias("e1"), F.avg(off).alias("offset"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("_g", "n")


def best_split(before: np.ndarray, after: np.ndarray) -> int:
    """The point of a gap at which what precedes fits ``before`` and what follows fits ``after`` best."""
    return int((np.concatenate(([0.0], np.cumsum(before))) + np.concatenate((np.cumsum(after[::-1])[::-1], [0.0]))).argmax())


def lines_present(words: list[str], lines: list[list[str]], share: float = 0.6) -> list[bool]:
    """Which lines have at least a share of their words among those kept."""
    from chronoweft.functions.text import word_likeness

    kept = list(dict.fromkeys(words))
    return [sum(any(word_likeness(w, k) >= 0.6 for k in kept) for w in line) >= share * len(line) for line in lines]


def placed_windows(edit: list[str], source: list[str], size: int = 6, least: int = 4) -> list[tuple[int, int]]:
    """Where each window of the edit's words stands in the source: the place with the longest common subsequence of at least ``least`` words, ties to the later."""
    from chronoweft.operators.takes import common

    out = []
    for e in range(0, max(0, len(edit) - size + 1)):
        own = edit[e : e + size]
        scores = [common(own, source[s : s + size]) for s in range(max(0, len(source) - size + 1))]
        if scores and max(scores) >= least:
            out.append((e, len(scores) - 1 - int(np.argmax(scores[::-1]))))
    return out
