"""Who speaks, and which camera shows it: regions, voices, plans of shots and layouts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.operators import sequences
from chronoweft.operators.signal import _as_grids, gain_offsets, nearest, per_recording

KEY = "rec_id"
# Paces of a director, in seconds.
PACES = {"low": {"min_shot": 3.5, "max_shot": 45, "hold": 3, "lead": 0.0}, "medium": {"min_shot": 2.0, "max_shot": 20, "hold": 3, "lead": 0.0}, "high": {"min_shot": 1.5, "max_shot": 10, "hold": 2, "lead": 0.12}}


def voice_order(turns: DataFrame) -> DataFrame:
    """Speakers by when they are first heard: rec_id, speaker, place, first, talk."""
    per = turns.groupBy(KEY, "speaker").agg(F.min("start").alias("first"), F.sum(F.col("end") - F.col("start")).alias("talk"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy(KEY).orderBy("first", "speaker")))


def voices_to_regions(turns: DataFrame, cameras: DataFrame, offset: float = 0.0) -> DataFrame:
    """Turns on the camera of their speaker's place (cameras: place, angle); those without one go: rec_id, angle, start, end."""
    placed = turns.join(voice_order(turns).select(KEY, "speaker", "place"), [KEY, "speaker"]).join(cameras, "place")
    return placed.filter("angle >= 0").select(KEY, "angle", (F.col("start") + F.lit(offset)).alias("start"), (F.col("end") + F.lit(offset)).alias("end"))


def cues_to_regions(cues: DataFrame, cameras: DataFrame) -> DataFrame:
    """Cues on their speaker's camera (cameras: speaker, angle)."""
    return cues.join(cameras, "speaker").filter("angle >= 0").select(KEY, "angle", "start", "end")


def plan_stats(plan: DataFrame) -> DataFrame:
    """rec_id, angle, segments, and the recording's switches. plan: rec_id, start, end, angle."""
    w = Window.partitionBy(KEY).orderBy("start", "end")
    marked = plan.withColumn("_s", F.when(F.lag("angle").over(w) != F.col("angle"), 1).otherwise(0))
    return marked.groupBy(KEY, "angle").agg(F.count(F.lit(1)).alias("segments"), F.sum("_s").alias("_s")).withColumn("switches", F.sum("_s").over(Window.partitionBy(KEY)).cast("long")).drop("_s")


def rotate(segments: DataFrame, angles: int, hold: int = 1, least: float = 0.0, mode: str = "rotate") -> DataFrame:
    """Angles in turn (rotate) or back and forth (pingpong), a switch every ``hold`` segments that last ``least``: rec_id, start, end, angle."""
    w = Window.partitionBy(KEY).orderBy("start", "end")
    i = F.row_number().over(w) - 1
    turn = F.when((i > 0) & (i % max(1, hold) == 0) & (F.col("end") - F.col("start") >= F.lit(least)), 1).otherwise(0)
    n = segments.withColumn("_t", turn).withColumn("_n", F.sum("_t").over(w))
    period = max(1, 2 * (angles - 1))
    angle = F.col("_n") % angles if mode == "rotate" else F.least(F.col("_n") % period, F.lit(period) - F.col("_n") % period)
    return n.select(KEY, "start", "end", (angle if angles > 1 else F.lit(0)).cast("long").alias("angle"))


class Mulberry:
    """A 32-bit generator of numbers in [0, 1) by add, xor-shift and multiply; its constants are fixed values."""

    def __init__(self, seed: int) -> None:
        self.state = seed & 0xFFFFFFFF

    def __call__(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & 0xFFFFFFFF
        t = self.state
        t = ((t ^ (t >> 15)) * (t | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ (t >> 7)) * (t | 61))) & 0xFFFFFFFF
        return ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296


def drawn(segments: DataFrame, angles: int, mode: str = "random", seed: int = 42, hold: int = 1, main: int = 0, weight: float = 0.5) -> DataFrame:
    """Angles at random, never one twice in a row; ``weighted`` comes back to the main one after every other."""

    def kernel(frame: pd.DataFrame):
        rand, angle = Mulberry(seed), main if mode == "weighted" else 0
        for k, s in enumerate(frame.sort_values(["start", "end"]).itertuples()):
            if k and k % max(1, hold) == 0 and angles > 1:
                if mode == "weighted" and angle != main:
                    angle = main
                elif mode == "random" or rand() >= weight:
                    other = math.floor(rand() * (angles - 1))
                    angle = other + (other >= (angle if mode == "random" else main))
            yield s.start, s.end, angle

    return per_recording(segments, kernel, "start double, end double, angle long")


def activity_of(grids: list[np.ndarray], gate: float = 3.0, margin: float = 1.5, stick: float = 1.0, quiet: float = 6.0, least: int = 3) -> list[set[int]]:
    """Who speaks in each window: the microphone that is louder than the others after calibration, or two at once where both stay near each other."""
    cal = gain_offsets(grids)
    n = max(map(len, grids), default=0)
    full = np.full((len(grids), n), -100.0)
    for k, g in enumerate(grids):
        full[k, : len(g)] = g
    on = full > -99
    level = np.where(on, full + np.array(cal["offsets"])[:, None], -np.inf)
    above = np.where(on, full - np.array(cal["floors"])[:, None], -np.inf)
    both = None
    if cal["cross_isolation"] is not None:
        both = min(cal["cross_isolation"] / 2, cal["cross_isolation"] - 2.5 * (cal["cross_spread"] or 0))
        both = both if both >= 2 else None
    winner, pair, current = np.full(n, -1), [None] * n, -1
    for w in range(n):
        mics = np.flatnonzero(on[:, w])
        if len(mics) < 2 or above[mics, w].max() < quiet:
            continue
        base = level[mics, w].min()
        effect = level[mics, w] - base + np.where(mics == current, stick, 0.0)
        order = np.argsort(-effect, kind="stable")
        best = mics[order[0]]
        if level[best, w] - base >= gate and effect[order[0]] - effect[order[1]] >= margin:
            winner[w] = current = best
        top = mics[np.argsort(-level[mics, w], kind="stable")[:2]]
        if both is not None and level[top[0], w] - level[top[1], w] < both and (above[top, w] >= quiet).all():
            pair[w] = (int(top[0]), int(top[1]))
    known = [w for w in range(n) if pair[w]]
    for a, b in zip(known, known[1:], strict=False):
        if 1 < b - a <= 3:
            for z in range(a + 1, b):
                pair[z] = pair[b]
    w = 0
    while w < n:
        e = w
        while e < n and pair[e]:
            e += 1
        if 0 < e - w < least:
            pair[w:e] = [None] * (e - w)
        w = max(e, w + 1)
    return [set(pair[w]) if pair[w] else ({int(winner[w])} if winner[w] >= 0 else set()) for w in range(n)]


def _regions(active: list[set[int]], count: int, step: float):
    for a in range(count):
        flags = np.array([a in s for s in active], int)
        for s, e in np.flatnonzero(np.diff(np.concatenate(([0], flags, [0])))).reshape(-1, 2):
            yield a, s * step, e * step


def speaker_activity(grid: DataFrame, step: float = 0.2) -> DataFrame:
    """Regions of speech by microphone (numbered by name): rec_id, angle, start, end. grid: rec_id, mic, w, db."""

    def kernel(frame: pd.DataFrame):
        grids = _as_grids(frame)
        return [(int(a), float(s), float(e)) for a, s, e in _regions(activity_of(grids), len(grids), step)]

    return per_recording(grid, kernel, "angle long, start double, end double")


def loudest_regions(grid: DataFrame, step: float = 0.2, gate: float = 6.0, margin: float = 3.0, stick: float = 2.5, floor: float = -60.0, share: float = 0.4) -> DataFrame:
    """Regions in which one microphone is clearly loudest over its own floor, the current one with a bonus."""

    def kernel(frame: pd.DataFrame):
        grids = _as_grids(frame)
        floors = [nearest(g[g > -99], share, "exclusive") if (g > -99).any() else -100.0 for g in grids]
        current, active = -1, []
        for w in range(len(grids[0])):
            rel = [g[w] - f for g, f in zip(grids, floors, strict=True)]
            effect = [r + (stick if k == current else 0.0) for k, r in enumerate(rel)]
            order = sorted(range(len(grids)), key=lambda k: -effect[k])
            best, second = order[0], effect[order[1]] if len(order) > 1 else -math.inf
            clear = rel[best] >= gate and grids[best][w] > floor and effect[best] - second >= margin
            current = best if clear else current
            active.append({best} if clear else set())
        return [(int(a), float(s), float(e)) for a, s, e in _regions(active, len(grids), step)]

    return per_recording(grid, kernel, "angle long, start double, end double")


def merge_short(segments: list[list], least: float) -> list[list]:
    """Segments [start, end, label] shorter than ``least`` joined to the one before, equal neighbours joined, a short first given to the next."""
    out: list[list] = []
    for s in segments:
        if out and s[1] - s[0] < least:
            out[-1][1] = s[1]
        else:
            out.append(list(s))
    joined: list[list] = []
    for s in out:
        if joined and joined[-1][2] == s[2]:
            joined[-1][1] = s[1]
        else:
            joined.append(s)
    if len(joined) > 1 and joined[0][1] - joined[0][0] < least:
        joined[1][0] = joined[0][0]
        joined.pop(0)
    return joined


def director_of(regions: list[tuple[int, float, float]], angles: int, duration: float, step: float = 0.12, min_shot: float = 1.2, wide: list[int] | None = None, wide_on_silence: bool = False, max_shot: float = 0.0, hold: float = 1.5, lead: float = 0.0, every: float = 0.0) -> list[tuple]:
    """Shots: the camera of the one who speaks, the wide one when several do, the last one in silence; long shots broken by a cutaway, and cuts ``lead`` before a line."""
    if duration <= 0 or not angles:
        return []
    n = math.ceil(duration / step)
    t = np.arange(n) * step
    active = np.zeros((angles, n), bool)
    for a, s, e in regions:
        active[a] |= (t >= s - 1e-6) & (t < e - 1e-6)
    count = active.sum(axis=0)
    label = np.where(count == 1, active.argmax(axis=0), np.where(((count > 1) & bool(wide)) | ((count == 0) & bool(wide) & wide_on_silence), -2, -1))
    last = -2 if wide else 0
    for k in range(n):
        last = label[k] = last if label[k] == -1 else label[k]
    hold = max(min_shot, hold)
    if wide and every > 0:
        for c in np.arange(every, duration, every):
            label[math.floor(c / step) : min(n, math.ceil((c + hold) / step - 1e-9))] = -2
    edges = [0, *(np.flatnonzero(np.diff(label)) + 1), n]
    shots = merge_short([[a * step, min(duration, b * step), int(label[a])] for a, b in zip(edges, edges[1:], strict=False)], min_shot)
    turn = 0
    for s in shots:
        if s[2] == -2:
            s[2], turn = wide[turn % len(wide)], turn + 1
    out: list[list] = []
    for k, (s, e, a) in enumerate(shots):
        at = s
        while max_shot > 0 and angles > 1 and e - at > 1.5 * max_shot:
            if wide and a not in wide:
                other, turn = wide[turn % len(wide)], turn + 1
            else:
                other = next((x[2] for x in reversed(shots[:k]) if x[2] != a), (a + 1) % angles)
            own = sorted((rs, re) for ra, rs, re in regions if ra == a)
            goal, low, high = at + max_shot, at + max(min_shot, 0.6 * max_shot), min(e - min_shot - hold, at + 1.4 * max_shot)
            breaths = [((p[1] + q[0]) / 2, q[0] - p[1]) for p, q in zip(own, own[1:], strict=False) if q[0] - p[1] >= 0.2 - 1e-6]
            starts = [b for b in breaths if low <= b[0] <= high]
            begin = max(starts, key=lambda b: b[1] - 0.15 * abs(b[0] - goal))[0] if starts else goal
            ends = [b for b in breaths if begin + max(min_shot, hold - 1) <= b[0] <= min(begin + hold + 6, e - min_shot)]
            stop = max(ends, key=lambda b: b[1] - 0.1 * abs(b[0] - begin - hold))[0] if ends else min(e - min_shot, begin + hold)
            stop = e if e - stop < min_shot else stop
            if stop - begin < min_shot - 1e-6 or begin - at < min_shot - 1e-6:
                break
            out += [[at, begin, a, False, at > s], [begin, stop, other, True, False]]
            at = stop
        if e - at > 1e-3:
            out.append([at, e, a, False, at > s])
    for p, q in zip(out, out[1:], strict=False):
        if lead > 0 and not q[3] and not q[4]:
            early = max(p[0] + min_shot, q[0] - lead)
            if early < q[0]:
                p[1] = q[0] = early
    return [(s, e, a, c) for s, e, a, c, _ in out]


def director(regions: DataFrame, totals: DataFrame, angles: int, **options) -> DataFrame:
    """rec_id, start, end, angle, cutaway. regions: rec_id, angle, start, end; totals: rec_id, total."""
    kind = regions.schema[KEY].dataType.simpleString()

    def run(r: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        found = director_of(list(r[["angle", "start", "end"]].itertuples(index=False, name=None)), angles, float(t["total"].iloc[0]), **options) if len(t) else []
        out = pd.DataFrame(found, columns=["start", "end", "angle", "cutaway"])
        out.insert(0, KEY, t[KEY].iloc[0] if len(t) else None)
        return out

    return regions.groupBy(KEY).cogroup(totals.groupBy(KEY)).applyInPandas(run, f"{KEY} {kind}, start double, end double, angle long, cutaway boolean")


def reactions_of(plan: list[dict], bursts: list[dict], every: float, lead: float = 1.0, after: float = 0.6, min_shot: float = 1.2, least: float = 1.5) -> list[dict]:
    """Shots of a listener's short bursts put into the talker's shots, at least ``every`` apart and away from cutaways."""
    out, last = [dict(p) for p in plan], -math.inf
    cutaways = [p["end"] for p in plan if p.get("cutaway")]
    for b in sorted(bursts, key=lambda b: b["start"]):
        s = b["start"] - lead
        e = max(b["end"] + after, s + least)
        if s - last < every or any(abs(c - s) < every for c in cutaways):
            continue
        k = next((k for k, p in enumerate(out) if p["start"] <= s + 1e-6 and p["end"] >= e - 1e-6), None)
        if k is None:
            continue
        p = out[k]
        if p["angle"] == b["angle"] or p.get("cutaway") or p.get("reaction") or b.get("over", p["angle"]) != p["angle"] or s - p["start"] < min_shot - 1e-6 or p["end"] - e < min_shot - 1e-6:
            continue
        out[k : k + 1] = [p | {"end": s}, {"start": s, "end": e, "angle": b["angle"], "reaction": True}, p | {"start": e}]
        last = e
    return out


def layouts(regions: DataFrame, totals: DataFrame, step: float = 0.2, hold: float = 3.0, least: float = 0.6) -> DataFrame:
    """One speaker for ``hold`` seconds or more fills the picture, else it is split: rec_id, start, end, mode, speaker."""
    kind = regions.schema[KEY].dataType.simpleString()

    def run(r: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        total, out = float(t["total"].iloc[0]) if len(t) else 0.0, []
        n = math.ceil(total / step - 1e-9)
        if n > 0 and len(r):
            at = np.arange(n) * step
            who = sorted(r["angle"].unique())
            on = np.zeros((len(who), n), bool)
            for a, s, e in r[["angle", "start", "end"]].itertuples(index=False, name=None):
                on[who.index(a)] |= (at >= s - 1e-6) & (at < e + 1e-6)
            label = np.where(on.sum(axis=0) == 1, np.array(who)[on.argmax(axis=0)], -1)
            edges = [0, *(np.flatnonzero(np.diff(label)) + 1), n]
            segs = [[a * step, min(total, b * step), int(label[a])] for a, b in zip(edges, edges[1:], strict=False)]
            segs = [[s, e, x if x >= 0 and e - s >= hold else -1] for s, e, x in segs]
            joined: list[list] = []
            for s in segs:
                if joined and joined[-1][2] == s[2]:
                    joined[-1][1] = s[1]
                else:
                    joined.append(s)
            k = 0
            while k < len(joined) and len(joined) > 1:
                if joined[k][1] - joined[k][0] < least:
                    if k:
                        joined[k - 1][1] = joined[k][1]
                    else:
                        joined[1][0] = joined[0][0]
                    joined.pop(k)
                else:
                    k += 1
            out = [(s, e, "single" if x >= 0 else "split", x if x >= 0 else None) for s, e, x in merge_short(joined, 0.0)]
        frame = pd.DataFrame(out, columns=["start", "end", "mode", "speaker"])
        frame.insert(0, KEY, t[KEY].iloc[0] if len(t) else None)
        return frame

    return regions.groupBy(KEY).cogroup(totals.groupBy(KEY)).applyInPandas(run, f"{KEY} {kind}, start double, end double, mode string, speaker double")


def turns_of(series: DataFrame, step: float, min_hold: float) -> DataFrame:
    """Who leads (1.4 times the next), else who had it: rec_id, start, end, speaker. series: rec_id, speaker, i, v."""

    def kernel(frame: pd.DataFrame):
        wide = frame.pivot_table(index="i", columns="speaker", values="v", fill_value=0.0).sort_index()
        v, current, label = wide.to_numpy(float), -1, []
        for row in v:
            order = np.argsort(-row, kind="stable")
            leads = len(row) < 2 or row[order[0]] > 1.4 * row[order[1]] + 1e-6
            current = int(order[0]) if current < 0 or leads else current
            label.append(current)
        edges = [0, *(np.flatnonzero(np.diff(label)) + 1), len(label)]
        segs = merge_short([[a * step, b * step, label[a]] for a, b in zip(edges, edges[1:], strict=False)], min_hold)
        return [(s, e, str(wide.columns[k])) for s, e, k in segs]

    return per_recording(series, kernel, "start double, end double, speaker string")


def carry_labels(cues: DataFrame) -> DataFrame:
    """Cues with the last speaker named so far."""
    return sequences.carry_forward(cues, "speaker", "ord")


def pearson(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Correlation of two columns in each group; 0 below three rows or without variance."""
    return rows.groupBy(*by).agg(F.corr(a, b).alias("_r"), F.count(F.lit(1)).alias("_n")).select(*by, F.when(F.col("_n") < 3, 0.0).otherwise(F.coalesce(F.nanvl("_r", F.lit(0.0)), F.lit(0.0))).alias("r"))


def assign(pairs: DataFrame, least: float = 0.05) -> DataFrame:
    """Microphones and people matched one to one, the best correlation first: rec_id, mic, person. pairs: rec_id, mic, person, r."""

    def kernel(frame: pd.DataFrame):
        mics: set = set()
        people: set = set()
        for p in frame.sort_values(["r", "mic", "person"], ascending=[False, True, True]).itertuples():
            if p.r >= least and p.mic not in mics and p.person not in people:
                mics.add(p.mic)
                people.add(p.person)
                yield str(p.mic), str(p.person)

    return per_recording(pairs, kernel, "mic string, person string")


def _talkers(regions: list[tuple[int, float, float]], t: np.ndarray) -> np.ndarray:
    """Who talks at each time, the lowest angle of several; -1: nobody."""
    out = np.full(len(t), -1)
    for a in sorted({r[0] for r in regions}, reverse=True):
        for _, s, e in (r for r in regions if r[0] == a):
            out[(t >= s - 1e-6) & (t < e - 1e-6)] = a
    return out


def _said_over(own: int, db: dict[int, np.ndarray], talks: np.ndarray, step: float, rise: float) -> list[tuple[float, float, int]]:
    """Stretches in which a listener's level rises by ``rise`` against the talker's and against its own usual one meanwhile: start, end and who talks."""
    padded = {a: np.concatenate((x, np.full(len(talks) - len(x), -np.inf))) for a, x in db.items()}
    hit, mine = np.zeros(len(talks), bool), padded[own]
    for who in sorted(set(db) - {own}):
        at = (talks == who) & (mine > -99) & (padded[who] > -99)
        if at.sum() < 20:
            continue
        against, alone = mine[at] - padded[who][at], mine[at]
        usual, level = (np.sort(x)[len(x) // 2] for x in (against, alone))
        hit[np.flatnonzero(at)[(against - usual >= rise) & (alone - level >= rise)]] = True
    over = np.where(hit, talks, -1)
    edge = np.flatnonzero(np.diff(np.concatenate(([-1], over, [-1]))))
    return [(a * step, b * step, int(over[a])) for a, b in zip(edge[:-1], edge[1:], strict=True) if over[a] >= 0]


def listener_bursts_of(regions: list[tuple[int, float, float]], least: float = 0.15, most: float = 1.5, around: float = 2.5, levels: dict[int, np.ndarray] | None = None, step: float = 0.1, rise: float = 6.0) -> list[tuple[int, float, float, int]]:
    """Small sounds of those who listen: angle, start, end and who talks.

    Short regions inside another's talk, the same one heard within ``around`` on both sides; and, where the levels of
    the microphones are known (by angle, one for each ``step``), short rises said over the talker, unless such a
    region is within 0.3 s.
    """

    def near(t: float, own: int, way: int) -> int | None:
        for d in np.arange(0.05, around + 1e-6, 0.1):
            found = sorted(a for a, s, e in regions if a != own and s - 1e-6 <= t + way * d < e - 1e-6)
            if found:
                return found[0]
        return None

    fits = lambda s, e: least - 1e-6 <= e - s <= most + 1e-6
    out = []
    for a, s, e in sorted(regions, key=lambda r: (r[1], r[0])):
        if fits(s, e):
            before, after = near(s, a, -1), near(e, a, 1)
            if before is not None and before == after:
                out.append((a, s, e, before))
    if levels:
        n = max(len(x) for x in levels.values())
        talks = _talkers(regions, np.arange(n) * step + step / 2)
        for a in sorted(levels):
            for s, e, over in _said_over(a, levels, talks, step, rise):
                if fits(s, e) and not any(x[0] == a and x[1] < e + 0.3 and x[2] > s - 0.3 for x in out):
                    out.append((a, s, e, over))
    return sorted(out, key=lambda x: (x[0], x[1]))


def listener_bursts(regions: DataFrame, levels: DataFrame | None = None, **options) -> DataFrame:
    """rec_id, angle, start, end, over. regions: rec_id, angle, start, end; levels, where known: rec_id, angle, w (from 0, without gaps), db."""
    schema = "angle long, start double, end double, over long"
    of = lambda f: list(f[["angle", "start", "end"]].itertuples(index=False, name=None))
    if levels is None:
        return per_recording(regions, lambda f: listener_bursts_of(of(f), **options), schema)
    kind = regions.schema[KEY].dataType.simpleString()

    def run(r: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        db = {a: g.sort_values("w")["db"].to_numpy(float) for a, g in v.groupby("angle")}
        out = pd.DataFrame(listener_bursts_of(of(r), levels=db, **options), columns=["angle", "start", "end", "over"])
        out.insert(0, KEY, (r if len(r) else v)[KEY].iloc[0])
        return out

    return regions.groupBy(KEY).cogroup(levels.groupBy(KEY)).applyInPandas(run, f"{KEY} {kind}, {schema}")


def reaction_shots(plan: DataFrame, bursts: DataFrame, every: float, **options) -> DataFrame:
    """rec_id, start, end, angle, reaction. plan: rec_id, start, end, angle, cutaway; bursts: rec_id, angle, start, end, over."""
    kind = plan.schema[KEY].dataType.simpleString()

    def run(p: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = reactions_of(p.sort_values("start").to_dict("records"), b.to_dict("records"), every, **options)
        out = pd.DataFrame([(s["start"], s["end"], s["angle"], bool(s.get("reaction"))) for s in found], columns=["start", "end", "angle", "reaction"])
        out.insert(0, KEY, (p if len(p) else b)[KEY].iloc[0])
        return out

    return plan.groupBy(KEY).cogroup(bursts.groupBy(KEY)).applyInPandas(run, f"{KEY} {kind}, start double, end double, angle long, reaction boolean")


def short_pieces(keeps: list[tuple[float, float]], plan: list[tuple[float, float, int]], least: float = 0.7, fallback: int = 0) -> list[tuple[float, float, int]]:
    """Kept ranges cut by a plan of shots: holes go to the shot before, and pieces that touch the one before join it if they show the same or are shorter than ``least``."""
    out: list[list] = []
    for s, e in keeps:
        shots = sorted(p for p in plan if p[1] > s + 1e-3 and p[0] < e - 1e-3)
        at, own = s, []
        for k, (a, b, angle) in enumerate(shots):
            if a > at + 1e-6:
                own.append([at, min(a, e), shots[max(0, k - 1)][2]])
            own.append([max(a, at), min(b, e), angle])
            at = max(at, min(b, e))
        if at < e - 1e-6:
            own.append([at, e, shots[-1][2] if shots else fallback])
        for p in own:
            if p[1] - p[0] <= 1e-6:
                continue
            if out and abs(out[-1][1] - p[0]) < 1e-3 and (p[2] == out[-1][2] or p[1] - p[0] < least):
                out[-1][1] = p[1]
            else:
                out.append(p)
    if len(out) > 1 and out[0][1] - out[0][0] < least and abs(out[0][1] - out[1][0]) < 1e-3:
        out[1][0] = out[0][0]
        out.pop(0)
    return [tuple(p) for p in out]


def talker(levels: DataFrame, spans: DataFrame) -> DataFrame:
    """Who is loud most of each span: rec_id, ord, talker (a microphone, ``both`` when two are over a third of it, null when nobody is). levels: rec_id, mic, i, db; spans: rec_id, ord, first, last."""
    top = levels.groupBy(KEY, "mic").agg(F.max("db").alias("_top"))
    loud = levels.join(top, [KEY, "mic"]).withColumn("_on", ((F.col("db") > F.col("_top") - 18) & (F.col("db") > -50)).cast("int"))
    cells = spans.select(KEY, "ord", F.explode(F.sequence("first", "last")).alias("i"))
    share = loud.join(cells, [KEY, "i"]).groupBy(KEY, "ord", "mic").agg(F.avg("_on").alias("s"))
    ranked = share.withColumn("_k", F.row_number().over(Window.partitionBy(KEY, "ord").orderBy(F.desc("s"), "mic"))).filter("_k <= 2")
    per = ranked.groupBy(KEY, "ord").agg(F.max(F.when(F.col("_k") == 1, F.struct("s", "mic"))).alias("a"), F.max(F.when(F.col("_k") == 2, F.col("s"))).alias("b"))
    who = F.when(F.col("a.s") < 0.15, F.lit(None)).when((F.col("a.s") > 0.33) & (F.col("b") > 0.33), F.lit("both")).otherwise(F.col("a.mic").cast("string"))
    return per.select(KEY, "ord", who.alias("talker"))


def cameras_of(labels: list[str], angles: int, names: list[str | None] = ()) -> dict[str, int]:
    """A camera for each speaker label in order of appearance: by its name, by its number, then the first that is free; -1 if none is."""
    import re

    out: dict[str, int] = {}
    order = list(dict.fromkeys(x for x in labels if x))
    free = lambda a: a not in out.values()
    for x in order:
        a = next((k for k, n in enumerate(names[:angles]) if n and n.strip().lower() == x.lower() and free(k)), None)
        if a is not None:
            out[x] = a
    for x in order:
        m = re.fullmatch(r"speaker\s*(\d+)", x, re.IGNORECASE)
        if x not in out and m and 1 <= int(m[1]) <= angles and free(int(m[1]) - 1):
            out[x] = int(m[1]) - 1
    for x in order:
        if x not in out:
            out[x] = next((a for a in range(angles) if free(a)), -1)
    return out


def movement(frames: DataFrame) -> DataFrame:
    """Mean absolute change of each frame's pixels from the one before: rec_id, i, v. frames: rec_id, i, pixels array<double>."""
    before = F.lag("pixels").over(Window.partitionBy(KEY).orderBy("i"))
    change = F.aggregate(F.zip_with("pixels", before, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / F.size("pixels")
    return frames.select(KEY, "i", F.coalesce(change, F.lit(0.0)).alias("v"))


def face_tracks(detections: DataFrame, frames: int) -> DataFrame:
    """Faces followed over frames, each to the nearest track of a like size; tracks seen in a fifth of the frames: rec_id, track, cx, cy, s, seen. detections: rec_id, i, cx, cy, s (shares of the frame)."""

    def kernel(frame: pd.DataFrame):
        tracks: list[dict] = []
        for d in frame.sort_values(["i", "s"], ascending=[True, False]).itertuples():
            far = lambda t, d=d: abs(d.cx - t["cx"]) + 0.5 * abs(d.cy - t["cy"])
            fit = [t for t in tracks if t["last"] != d.i and 0.6 < d.s / t["s"] < 1.6 and far(t) < max(1.2 * t["s"], 0.06)]
            t = min(fit, key=far, default=None)
            if t is None:
                t = {"cx": d.cx, "cy": d.cy, "s": d.s, "rows": []}
                tracks.append(t)
            t["rows"].append((d.cx, d.cy, d.s))
            t["last"] = d.i
            t["cx"], t["cy"], t["s"] = np.mean(t["rows"], axis=0)
        kept = [np.sort(np.array(t["rows"]), axis=0) for t in tracks if len(t["rows"]) >= max(1, math.floor(0.2 * frames + 0.5))]
        middle = sorted((tuple(float(x) for x in r[len(r) // 2]) + (len(r) / max(1, frames),) for r in kept), key=lambda m: m[0])
        return [(k, *m) for k, m in enumerate(middle)]

    return per_recording(detections, kernel, "track long, cx double, cy double, s double, seen double")
