"""Chapters of one talk in memory, by dense running sums: what the joins have to give."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

from chronoweft.functions import words as lists


def _topic(text: str) -> list[str]:
    out = []
    for w in (text or "").split():
        t = re.sub("[^a-z0-9'ऀ-ॣ०-ॿ]", "", w.lower()).strip("'")
        if t and t not in _STOP and "'" not in t and len(t) >= (4 if re.fullmatch("[a-z0-9']+", t) else 2):
            out.append(t)
    return out


_STOP = frozenset(lists.TOPIC_STOP)


def chapters_of(cues: list[dict], least: float = 30.0, most: int | None = None) -> list[tuple[float, str]]:
    """Starts and titles of chapters: lines at which the words of the talk before and after differ most (a depth score over cosines of weighted bags), well apart and deep enough."""
    cs = sorted((c for c in cues if c["text"] is not None), key=lambda c: c["start"])
    if not cs:
        return []
    first, last = cs[0]["start"], cs[-1]["end"]
    length = last - first
    most = most or max(2, min(15, math.floor(length / (150 if length <= 1200 else 300) + 0.5)))
    reach = max(least, min(120.0, length / 40))
    bags = [Counter(_topic(c["text"])) for c in cs]
    df = Counter(w for b in bags for w in b)
    vocab = {w: k for k, w in enumerate(w for w in df if math.log(len(cs) / df[w]) > 0.05)}
    # running sums of weighted bags; any span of lines is a difference of two
    total = np.zeros((len(cs) + 1, len(vocab)), np.float64)
    for k, b in enumerate(bags):
        total[k + 1] = total[k]
        for w, c in b.items():
            if w in vocab:
                total[k + 1, vocab[w]] += c * math.log(len(cs) / df[w])
    mid = np.array([(c["start"] + c["end"]) / 2 for c in cs])
    order = np.argsort(mid, kind="stable")
    if not (np.diff(mid) >= 0).all():
        per = np.diff(total, axis=0)[order]
        total = np.concatenate((np.zeros((1, len(vocab))), np.cumsum(per, axis=0)))
    sorted_mid = mid[order]

    def bag(lo: float, hi: float) -> np.ndarray:
        return total[np.searchsorted(sorted_mid, hi)] - total[np.searchsorted(sorted_mid, lo)]

    def cosine(a: np.ndarray, b: np.ndarray) -> float:
        na, nb = float(a @ a), float(b @ b)
        return float(a @ b) / math.sqrt(na * nb) if na > 0 and nb > 0 else 1.0

    at = [k for k in range(1, len(cs)) if cs[k]["start"] - first >= least and last - cs[k]["start"] >= least]
    if not at:
        return [(0.0, title([bags])[0] or "Chapter")]
    t = np.array([cs[k]["start"] for k in at])
    sim = np.array([cosine(bag(x - reach, x), bag(x, x + reach)) for x in t])
    depth = np.array([sim[np.searchsorted(t, x - 2 * reach) : g + 1].max() + sim[g : np.searchsorted(t, x + 2 * reach, "right")].max() - 2 * sim[g] for g, x in enumerate(t)])
    deep = np.sort(depth[depth > 0])
    bar = max(deep[len(deep) // 2], deep.mean() + 0.75 * deep.std()) if len(deep) else math.inf
    ranked = np.lexsort((sim, -depth))
    picked: list[int] = []

    def pick(bar: float, apart: float, upto: int) -> None:
        for g in ranked:
            if len(picked) < upto and g not in picked and depth[g] >= 0.25 and depth[g] >= bar and all(abs(t[p] - t[g]) >= apart for p in picked):
                picked.append(int(g))

    pick(bar, max(least, reach), most - 1)
    pick(0.0, least, min(most, 3 if length >= 3 * least + 10 else 1) - 1)
    edges = [0, *sorted(at[g] for g in picked), len(cs)]
    parts = [bags[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    return [(cs[a]["start"] if a else 0.0, name or "Chapter") for a, name in zip(edges, title(parts), strict=False)]


def title(parts: list[list[Counter]]) -> list[str]:
    """A title for each part from the words it says more than the others."""
    counts = [sum(p, Counter()) for p in parts]
    df = Counter(w for c in counts for w in c)
    out = []
    for c in counts:
        scored = sorted(((n * (math.log(len(parts) / df[w]) + 0.1), n, w) for w, n in c.items()), key=lambda x: (-round(x[0], 9), -x[1], x[2]))
        name = scored[0][2] if scored else ""
        if len(scored) > 1 and scored[1][1] >= 2 and scored[1][0] >= 0.6 * scored[0][0]:
            name += f" {scored[1][2]}"
        out.append(" ".join(w[:1].upper() + w[1:] for w in name.split(" ")))
    return out
