"""Moments worth a clip: hook scores, windows of sentences, clean ends, tight timing, posts and B-roll."""

from __future__ import annotations

import math
import re

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.functions import text as X
from chronoweft.functions import words as lists
from chronoweft.operators.signal import per_recording
from chronoweft.sources.folders import settle

KEY = "rec_id"
ENDS = "[.!?।॥۔؟…][\"'”’)\\]]*\\s*$"
# Openings that lean on what came before, and sponsor lines.
BACK = r"(?i)^\W*(that'?s why|that is why|this is why|which\b|as i (said|mentioned)|like i (said|mentioned)|as we (said|discussed)|exactly\b|and that'?s|so that'?s|yes,|no,|yeah,|right,|he said|she said|they said)"
SPONSOR = r"(?i)(sponsored by|brought to you by|today'?s sponsor|promo code|use (my |the )?code\b|discount code|link in (the )?description)"


def windows(sentences: DataFrame, least: float = 15, most: float = 60, gap: float = 3.0) -> DataFrame:
    """Every run of sentences of a fitting length that opens well, with its score: rec_id, i, j, start, end, score. sentences: rec_id, ord, start, end, text. A silence of over ``gap`` ends a run.

    Sentences are joined to later ones of the same talk by their place, at most as many as fit in ``most`` seconds
    when each takes one.
    """
    w = Window.partitionBy(KEY).orderBy("start", "ord")
    rows = sentences.filter((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("end") > F.col("start")))
    rows = rows.withColumn("i", F.row_number().over(w) - 1).withColumn("_gap", F.coalesce(F.col("start") - F.lag("end").over(w), F.lit(0.0)))
    rows = rows.withColumn("_talk", F.sum(F.when(F.col("_gap") > gap, 1).otherwise(0)).over(w)).withColumn("_words", F.size(F.filter(F.split("text", r"\s+"), lambda t: t != "")))
    rows = rows.withColumn("_upto", F.sum("_words").over(w)).withColumn("_bucket", F.floor(F.col("start") / most))
    # each sentence is looked through once, and not again for every bucket and side
    rows = settle(rows.select(KEY, "_talk", "i", "start", "end", "_words", "_upto", "_bucket", X.hook_score("text").alias("_hook"), F.col("text").rlike(ENDS).alias("_clean")), "sentences")
    opens = rows.filter("_hook >= 0").select(KEY, "_talk", "i", F.col("start").alias("_s"), (F.col("_upto") - F.col("_words")).alias("_before"), "_hook", F.explode(F.array(F.col("_bucket"), F.col("_bucket") + 1)).alias("_bucket"))
    closes = rows.select(KEY, "_talk", F.col("i").alias("j"), F.col("end").alias("_e"), "_upto", "_clean", "_bucket")
    both = opens.join(closes, [KEY, "_talk", "_bucket"]).filter("j >= i").withColumn("_d", F.col("_e") - F.col("_s")).filter(F.col("_d").between(least, most))
    pace = (F.col("_upto") - F.col("_before")) / F.greatest(F.lit(1.0), F.col("_d"))
    middle, spread = (least + most) / 2, max(1.0, (most - least) / 2)
    score = 40 + F.col("_hook") + F.when(F.col("_clean"), 12).otherwise(-15) + F.greatest(F.lit(-10.0), F.least(F.lit(12.0), (pace - 2) * 8)) - F.abs(F.col("_d") - middle) / spread * 6
    return both.select(KEY, "i", "j", F.col("_s").alias("start"), F.col("_e").alias("end"), score.alias("score"))


def best_apart(ranges: DataFrame, count: int = 6) -> DataFrame:
    """The best ranges that don't overlap, taken greedily by score, then start: rec_id, start, end, score and the other columns."""

    def run(table: pa.Table) -> pa.Table:
        picked: list[int] = []
        order = pc.sort_indices(table, [("score", "descending"), ("start", "ascending"), ("end", "ascending")])
        s, e = table.column("start").to_pylist(), table.column("end").to_pylist()
        for k in order.to_pylist():
            if len(picked) >= count:
                break
            if not any(s[k] < e[p] and s[p] < e[k] for p in picked):
                picked.append(k)
        return table.take(pa.array(picked, pa.int64()))

    return ranges.groupBy(KEY).applyInArrow(run, ranges.schema)


def highlights(sentences: DataFrame, least: float = 15, most: float = 60, count: int = 6) -> DataFrame:
    """The best moments of each recording: rec_id, rank, start, end, score, title, text."""
    sentences = settle(sentences.select(KEY, "ord", "start", "end", "text"), "sentences")
    found = best_apart(windows(sentences, least, most), count)
    w = Window.partitionBy(KEY).orderBy("start", "ord")
    rows = sentences.filter((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("end") > F.col("start"))).withColumn("_i", F.row_number().over(w) - 1).select(KEY, "_i", F.trim("text").alias("_t"))
    both = found.join(rows, KEY).filter("_i between i and j").groupBy(KEY, "i", "j", "start", "end", "score").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_t"))), lambda x: x["_t"]).alias("_lines"))
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(F.col("score").desc(), "start"))
    whole = F.floor(F.greatest(F.lit(1.0), F.least(F.lit(99.0), F.col("score"))) + 0.5).cast("long")
    return both.select(KEY, rank.alias("rank"), "start", "end", whole.alias("score"), X.title_of(F.get("_lines", F.lit(0))).alias("title"), F.array_join("_lines", " ").alias("text"))


def fit_clip(segs: list[dict], a: int, b: int, least: float, most: float) -> tuple[int, int] | None:
    """Segments a to b moved to whole sentences within a length: no sponsor lines, no opening that leans on what came before, no question left open at the end. None if nothing fits."""
    n = len(segs)
    if not n or a < 0 or b >= n or b < a:
        return None
    text = lambda k: segs[k]["text"] or ""
    length = lambda i, j: segs[j]["end"] - segs[i]["start"]
    closes = lambda k: bool(re.search(ENDS, text(k))) or k + 1 >= n or segs[k + 1]["start"] - segs[k]["end"] > 0.6
    opens = lambda k: k == 0 or (closes(k - 1) and not re.search(BACK, text(k)))
    sponsor = lambda k: bool(re.search(SPONSOR, text(k)))
    while a <= b and sponsor(a):
        a += 1
    while b >= a and sponsor(b):
        b -= 1
    if b < a or any(map(sponsor, range(a, b + 1))):
        return None
    back = next((k for k in range(a, -1, -1) if opens(k) or length(k, b) > most), 0)
    f = back if opens(back) and length(back, b) <= max(most, length(a, b)) else next((k for k in range(a, b + 1) if opens(k)), None)
    if f is None:
        return None
    t = max(f, b)
    while t + 1 < n and not closes(t) and length(f, t + 1) <= most:
        t += 1
    while t > f and (length(f, t) > most or not closes(t)) and length(f, t) > most:
        t -= 1
        while t > f and not closes(t):
            t -= 1
    while length(f, t) < least and t + 1 < n:
        u = next((k for k in range(t + 1, n) if closes(k)), n - 1)
        if length(f, u) > most:
            break
        t = u
    while t > f and re.search("\\?[\"'”’)]*\\s*$", text(t)) and length(f, t - 1) >= least - 3:
        t -= 1
        while t > f and not closes(t):
            t -= 1
    return (f, t) if closes(t) and least - 3 <= length(f, t) <= most + 3 else None


def trim_ends(words: list[dict], keep: int = 3) -> list[dict]:
    """Words without hesitations, and without lead-ins before and trail-offs after, while more than ``keep`` are left."""
    edge = lambda w: re.sub("^[\\s\"'“”‘’(\\[¿¡]+|[\\s\"'“”‘’)\\].,!?;:…।॥۔؟-]+$", "", (w["text"] or "").lower())
    ws = [w for w in words if (w["text"] or "").strip() and edge(w) not in lists.HESITATIONS]
    a, b = 0, len(ws)
    while b - a > keep and edge(ws[a]) in lists.LEAD_IN:
        a += 1
    while b - a > keep and edge(ws[b - 1]) in lists.TAIL_OFF:
        b -= 1
    return ws[a:b]


def tighten(words: list[dict], max_gap: float = 0.35, keep_gap: float = 0.14, lead: float = 0.08, tail: float = 0.3) -> dict:
    """Pauses over ``max_gap`` shortened to ``keep_gap`` and hesitations cut: segments of the source, words on the new clock, its duration and what was removed, to the millisecond."""
    edge = lambda w: re.sub("^[\\s\"'“”‘’(\\[¿¡]+|[\\s\"'“”‘’)\\].,!?;:…।॥۔؟-]+$", "", (w["text"] or "").lower())
    said = sorted((w for w in words if (w["text"] or "").strip() and edge(w) not in lists.HESITATIONS and w["end"] >= w["start"]), key=lambda w: w["start"])
    if not said:
        return {"segments": [], "words": [], "duration": 0.0, "removed": 0.0}
    ums = [w for w in words if edge(w) in lists.HESITATIONS and w["end"] > w["start"]]
    segs = [[max(0.0, said[0]["start"] - lead), said[0]["end"]]]
    for w in said[1:]:
        end = segs[-1][1]
        um = next((u for u in ums if u["start"] >= end - 0.001 and u["end"] <= w["start"] + 0.001), None)
        if w["start"] - end > max_gap:
            segs[-1][1] = end + keep_gap / 2
            segs.append([w["start"] - keep_gap / 2, w["end"]])
        elif um:
            segs[-1][1] = min(end + keep_gap / 2, um["start"])
            segs.append([max(um["end"], w["start"] - keep_gap / 2), w["end"]])
        else:
            segs[-1][1] = max(end, w["end"])
    segs[-1][1] += tail
    shift, total = [], 0.0
    for s, e in segs:
        shift.append(total - s)
        total += e - s
    out, k = [], 0
    for w in said:
        while k < len(segs) - 1 and w["start"] >= segs[k][1]:
            k += 1
        out.append({"text": w["text"], "start": round(w["start"] + shift[k], 3), "end": round(min(w["end"], segs[k][1]) + shift[k], 3)})
    return {"segments": [(round(s, 3), round(e, 3)) for s, e in segs], "words": out, "duration": round(total, 3), "removed": round(max(0.0, segs[-1][1] - segs[0][0] - total), 3)}


def tightened(words: DataFrame, **options) -> DataFrame:
    """Segments kept of each recording: rec_id, segment, start, end, at (on the new clock)."""

    def kernel(frame: pd.DataFrame):
        at = 0.0
        for k, (s, e) in enumerate(tighten(frame.sort_values(["start", "ord"]).to_dict("records"), **options)["segments"]):
            yield k, s, e, round(at, 3)
            at += e - s

    return per_recording(words, kernel, "segment long, start double, end double, at double")


def hook_check(words: DataFrame, moments: DataFrame) -> DataFrame:
    """How the first three seconds of each moment open: rec_id, ord, score, opening. words: rec_id, ord, start, end, text; moments: rec_id, ord, start, end."""
    kind = words.schema[KEY].dataType.simpleString()

    def run(w: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        ws, out = w.sort_values(["start", "ord"]).to_dict("records"), []
        for h in m.itertuples():
            inside = [x for x in ws if h.start - 0.05 <= x["start"] < h.end]
            if inside:
                first = [x["text"] for x in tighten(trim_ends(inside))["words"] if x["start"] < 3]
                out.append((h.rec_id, h.ord, " ".join(first), len(first)))
        return pd.DataFrame(out, columns=["rec_id", "ord", "opening", "n"])

    first = words.groupBy(KEY).cogroup(moments.groupBy(KEY)).applyInPandas(run, f"{KEY} {kind}, ord long, opening string, n long")
    hook = X.hook_score("opening")
    mid = F.array_contains(X.hook_reasons("opening"), "starts mid-thought") | (hook <= -20)
    raw = 40 + F.least(F.col("n"), F.lit(8)) * 4 + F.greatest(F.lit(-30), F.least(F.lit(40), hook)) * 0.8
    score = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(mid, F.least(raw, F.lit(45.0))).otherwise(raw))) + 0.5).cast("long")
    return first.select(KEY, "ord", score.alias("score"), "opening")


def broll_of(words: list[dict], files: list[tuple[str, list[str]]], gap: float = 8.0, reuse: float = 60.0, duration: float = 2.5) -> list[tuple]:
    """Where a file's keywords are said, at least ``gap`` after the last clip's end and ``reuse`` after the file's last use: path, at, word. A file's further keywords must follow within four words."""
    edge = lambda t: re.sub("^[^a-z0-9ऀ-ॣ०-ॿ]+|[^a-z0-9ऀ-ॣ०-ॿ]+$", "", (t or "").lower())
    same = lambda w, k: bool(w and k) and (w == k or (len(k) >= 5 and w.startswith(k)) or (len(w) >= 5 and k.startswith(w)))
    ws = sorted(((w["start"], edge(w["text"])) for w in words if (w["text"] or "").strip()), key=lambda x: x[0])
    out, free, used = [], -math.inf, {}
    for k, (at, word) in enumerate(ws):
        if at < free + gap:
            continue
        for path, keys in files:
            near = [w for _, w in ws[k + 1 : k + 5]]
            if keys and same(word, keys[0]) and all(any(same(w, x) for w in near) for x in keys[1:]) and at - used.get(path, -math.inf) >= reuse:
                out.append((path, round(at, 3), word))
                used[path], free = at, at + duration
                break
    return out


def broll_plan(words: DataFrame, files: list[tuple[str, list[str]]], **options) -> DataFrame:
    """rec_id, path, at, word. files: (path, keywords), a list of the driver's."""
    return per_recording(words, lambda f: broll_of(f.to_dict("records"), files, **options), "path string, at double, word string")
