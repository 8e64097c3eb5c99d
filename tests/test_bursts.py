"""Small sounds of those who listen, against a window-by-window reading on talks with planted ones."""

from __future__ import annotations

import numpy as np
import pytest

from chronoweft.operators import speakers


def window_by_window(regions, levels, step, rise, least=0.15, most=1.5):
    """The rule on levels, one window after the other; bursts found in regions come first."""
    n = max(map(len, levels.values()))
    inside = lambda a, t: any(s - 1e-6 <= t < e - 1e-6 for x, s, e in regions if x == a)
    who = [next((a for a in sorted({r[0] for r in regions}) if inside(a, w * step + step / 2)), -1) for w in range(n)]
    out = speakers.listener_bursts_of(regions)
    for a in sorted(levels):
        own, base, level = levels[a], {}, {}
        at = lambda x, w: levels[x][w] if w < len(levels[x]) else -200.0
        for s in sorted(levels):
            both = [w for w in range(n) if s != a and who[w] == s and at(a, w) > -99 and at(s, w) > -99]
            if len(both) >= 20:
                base[s] = sorted(own[w] - levels[s][w] for w in both)[len(both) // 2]
                level[s] = sorted(own[w] for w in both)[len(both) // 2]
        run = None
        for w in range(n + 1):
            s = who[w] if w < n else -1
            hit = s >= 0 and s != a and s in base and at(a, w) > -99 and at(s, w) > -99 and own[w] - levels[s][w] - base[s] >= rise and own[w] - level[s] >= rise
            if run and (not hit or s != run[1]):
                st, en = run[0] * step, w * step
                if least - 1e-6 <= en - st <= most + 1e-6 and not any(x[0] == a and x[1] < en + 0.3 and x[2] > st - 0.3 for x in out):
                    out.append((a, st, en, run[1]))
                run = None
            if hit and not run:
                run = (w, s)
    return sorted(out, key=lambda x: (x[0], x[1]))


def conversation(rng, mics, seconds, step):
    """Turns, levels that bleed, a digital silence, and planted rises of listeners: regions, levels."""
    n, regions, t = int(seconds / step), [], 0.0
    levels = {a: rng.normal(-55, 1, n) for a in range(mics)}
    while t < seconds - 2:
        a, length = int(rng.integers(mics)), float(np.round(rng.uniform(3, 12), 1))
        end = float(min(seconds, t + length))
        regions.append((a, t, end))
        i, j = int(t / step), int(end / step)
        for m in range(mics):
            levels[m][i:j] = rng.normal(-20 if m == a else -38 - 3 * m, 1.5, j - i)
        for m in range(mics):
            if m != a and rng.random() < 0.5 and j - i > 20:
                k = int(rng.integers(i + 3, j - 12))
                levels[m][k : k + int(rng.integers(1, 14))] += float(rng.choice([4.0, 12.0]))
                if rng.random() < 0.3:
                    regions.append((m, round(k * step, 1), round(k * step + 0.5, 1)))
        t = round(end + float(rng.choice([0.0, 0.3])), 1)
    levels[mics - 1][: n // 10] = -100.0
    levels[0] = levels[0][: n - 7]
    return regions, levels


@pytest.mark.parametrize(("mics", "step"), [(2, 0.1), (3, 0.2), (4, 0.05)])
def test_bursts_against_windows(mics, step):
    rng = np.random.default_rng(mics)
    found = 0
    for _ in range(4):
        regions, levels = conversation(rng, mics, 180, step)
        got = speakers.listener_bursts_of(regions, levels=levels, step=step)
        assert got == window_by_window(regions, levels, step, 6.0)
        found += len(got) - len(speakers.listener_bursts_of(regions))
    assert found > 10


def test_bursts_of_every_recording(spark):
    rng = np.random.default_rng(7)
    talks = {k: conversation(rng, 2 + k % 2, 90, 0.1) for k in range(3)}
    r = spark.createDataFrame([(k, *x) for k, (regions, _) in talks.items() for x in regions], "rec_id long, angle long, start double, end double")
    v = spark.createDataFrame([(k, a, w, float(db)) for k, (_, levels) in talks.items() for a, x in levels.items() for w, db in enumerate(x)], "rec_id long, angle long, w long, db double").repartition(3)
    want = [(k, *b) for k, (regions, levels) in talks.items() for b in speakers.listener_bursts_of(regions, levels=levels)]
    assert sorted(tuple(x) for x in speakers.listener_bursts(r, v).collect()) == sorted(want)
    assert speakers.listener_bursts(r, v.limit(0)).count() == speakers.listener_bursts(r).count()
