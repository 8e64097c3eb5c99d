"""Transcripts against a script: word alignment, one take for each line, attempts, and lines that cuts would lose."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweft.functions.text import skeleton, spoken_key, word_likeness
from chronoweft.operators.likeness import likeness_by_recording
from chronoweft.operators.takes import SENTENCE, _words
from chronoweft.sources.folders import spread

KEY = "rec_id"
_DIRECTION = re.compile(r"\[[^\]]*\]|\([^)]*\)")
_LABEL = re.compile(r"^\s*([A-Z][A-Z0-9 _.'-]{1,24}):\s*")
_ROLE = re.compile(r"^(HOST|GUEST|SPEAKER|ANCHOR|INTERVIEWER|INTERVIEWEE|NARRATOR|VO|V\.O\.|Q|A|ME|YOU)\d*$")


@lru_cache(1 << 16)
def script_key(word: str) -> str:
    return re.sub(r"[^\wऀ-ॿ']+|[।॥]", "", (word or "").lower()).strip("'")


@lru_cache(1 << 16)
def sound_or_word(word: str) -> str:
    """A key that a word has in either script: its sound, or the word itself if that is too short."""
    s = skeleton(spoken_key(word))
    return f"~{s}" if len(s) >= 2 else script_key(word)


def script_words(text: str, said: set[str] | None = None) -> list[str]:
    """The words of a script that are said: no directions, subtitle indexes, times, or speaker labels."""
    lines = _DIRECTION.sub(" ", text or "").splitlines()
    labels = [m[1] for m in map(_LABEL.match, lines) if m]

    def is_label(name: str) -> bool:
        return labels.count(name) > 1 or " " in name.strip() or bool(_ROLE.match(name)) or not (said and script_key(name) in said)

    out: list[str] = []
    for line in lines:
        if re.fullmatch(r"\s*\d+\s*", line) or "-->" in line:
            continue
        m = _LABEL.match(line)
        out += (line[m.end() :] if m and is_label(m[1]) else line).split()
    return out


def match_pairs(a: list[str], b: list[str], cap: int = 1200) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence; texts of over ``cap`` words block by block, each starting after the last pair.

    Words that both end with are pairs however the rest is matched, so that only what stands before them needs a table.
    """
    if not a or not b:
        return []
    if len(a) > cap or len(b) > cap:
        out, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            x, y = a[i : i + cap], b[j : j + cap]
            found = match_pairs(x, y, cap)
            out += [(i + p, j + q) for p, q in found]
            if found:
                i, j = i + found[-1][0] + 1, j + found[-1][1] + 1
                continue
            ahead_a, ahead_b = len(match_pairs(a[i + cap : i + 2 * cap], y, cap)), len(match_pairs(x, b[j + cap : j + 2 * cap], cap))
            i, j = i + cap * (ahead_a >= ahead_b), j + cap * (ahead_b >= ahead_a)
        return out
    tail = next((k for k, (v, w) in enumerate(zip(reversed(a), reversed(b), strict=False)) if v != w), min(len(a), len(b)))
    ends = [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return ends
    codes = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([codes[w] for w in b])
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, w in enumerate(a, 1):
        # the best of a row so far carries on to its right
        table[i, 1:] = np.maximum.accumulate(np.maximum(table[i - 1, 1:], (table[i - 1, :-1] + 1) * (y == codes[w])))
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1] + ends


def align_cues(cues: list[dict], script: str, least: float = 0.35) -> tuple[list[str], float, bool]:
    """The cues' texts as the script has them, the share matched, and whether it was enough. Script words between two matches go where the transcript misheard something; what is said beyond the script stays where the script has no gap."""
    said = [(k, w) for k, c in enumerate(cues) for w in (c["text"] or "").split()]
    wanted = script_words(script, {script_key(w) for _, w in said})
    texts = [c["text"] for c in cues]
    if not said or not wanted:
        return texts, 0.0, False
    a = [sound_or_word(w) or f"\0a{k}" for k, (_, w) in enumerate(said)]
    b = [sound_or_word(w) or f"\0b{k}" for k, w in enumerate(wanted)]
    pairs = match_pairs(a, b)
    strong = lambda k: k[0] == "~" and len(k) >= 4
    na, nb = sum(map(strong, a)), sum(map(strong, b))
    rate = sum(strong(a[i]) for i, _ in pairs) / min(na, nb) if na and nb else len(pairs) / min(len(a), len(b))
    if rate < least:
        return texts, rate, False
    parts: list[list[str]] = [[] for _ in cues]
    last, gap_cue, loose = -1, None, []
    to = dict(pairs)
    for k, (cue, w) in enumerate(said):
        if k not in to:
            loose.append((cue, w))
            gap_cue = cue if gap_cue is None else gap_cue
            continue
        j = to[k]
        if j == last + 1:
            for c, x in loose:
                parts[c].append(x)
        loose = []
        parts[cue if gap_cue is None else gap_cue] += wanted[last + 1 : j]
        parts[cue].append(wanted[j])
        last, gap_cue = j, None
    if last >= len(wanted) - 1:
        for c, x in loose:
            parts[c].append(x)
    else:
        end = gap_cue if gap_cue is not None else max((k for k, p in enumerate(parts) if p), default=len(parts) - 1)
        parts[end] += wanted[last + 1 :]
    return [" ".join(p) or t for p, t in zip(parts, texts, strict=True)], rate, True


def align_to_script(cues: DataFrame, scripts: DataFrame, least: float = 0.35) -> DataFrame:
    """Cues with the script's words: rec_id, ord, start, end, text, matched, rate. cues: rec_id, ord, start, end, text; scripts: rec_id, script."""
    kind = cues.schema[KEY].dataType.simpleString()

    def run(c: pa.Table, s: pa.Table) -> pa.Table:
        c = c.sort_by("ord")
        script = s.column("script")[0].as_py() if len(s) else None
        texts, rate, ok = align_cues([{"text": t} for t in c.column("text").to_pylist()], script or "", least)
        more = {"text": pa.array(texts, pa.string()), "matched": pa.array([ok] * len(c), pa.bool_()), "rate": pa.array([rate] * len(c), pa.float64())}
        return pa.table({n: c.column(n) for n in (KEY, "ord", "start", "end")} | more)

    rows = cues.select(KEY, F.col("ord").cast("long").alias("ord"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "text")
    return spread(rows, KEY).groupBy(KEY).cogroup(spread(scripts.select(KEY, "script"), KEY).groupBy(KEY)).applyInArrow(run, f"{KEY} {kind}, ord long, start double, end double, text string, matched boolean, rate double")


# ---- takes of a script ---------------------------------------------------------------


class Scores:
    """Likeness of all words of two lists: of each pair of different words what ``known`` says, or as scored here if that is None."""

    def __init__(self, a: list[str], b: list[str], known: dict[tuple[str, str], float] | None = None) -> None:
        ua, ia = np.unique(np.array(a, object), return_inverse=True)
        ub, ib = np.unique(np.array(b, object), return_inverse=True)
        if known is None:
            table = np.array([[word_likeness(x, y) for y in ub] for x in ua], np.float32).reshape(len(ua), len(ub))
        else:
            table = np.full((len(ua), len(ub)), -1.5, np.float32)
            bare = [np.array([0 < len(w) <= 4 and not skeleton(w) for w in u], bool) for u in (ua, ub)]
            table[np.ix_(*bare)] = 0.3
            rows, columns = {w: k for k, w in enumerate(ua)}, {w: k for k, w in enumerate(ub)}
            for (x, y), score in known.items():
                if x in rows and y in columns:
                    table[rows[x], columns[y]] = score
        self.full = table[ia][:, ib]


def lcs_pairs(match: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence of a 0/1 matrix, the earliest ones."""
    n, m = match.shape
    table = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        best = np.where(match[i], table[i + 1, 1:] + 1, table[i + 1, :-1])
        table[i, :-1] = np.maximum.accumulate(np.maximum(best, 0)[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < n and j < m:
        if match[i, j] and table[i, j] == table[i + 1, j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def sentences(script: str, least: int = 2, colon: bool = True) -> list[list[str]]:
    """A script's sentences as spoken words; a line's end ends one."""
    out: list[list[str]] = []
    for line in _DIRECTION.sub(" ", script or "").splitlines():
        own: list[str] = []
        for w in [*line.split(), ""]:
            if spoken_key(w):
                own.append(spoken_key(w))
            if not w or SENTENCE.search(w) or (colon and re.search("[:：]$", w)):
                if len(own) >= least:
                    out.append(own)
                own = []
    return out


def global_alignment(score: np.ndarray, open_gap: float = 2.5, extend: float = 0.05, skip: float = 0.8, late: float = 0.002) -> np.ndarray:
    """Which script word (column) each spoken word (row) stands for: -1 left out, -2 said otherwise. Leaving out a run of spoken words costs once to open; a tie goes to the later take."""
    n, m = score.shape
    low = -1e9
    back = np.zeros((3, n + 1, m + 1), np.int8)
    last = np.full((3, m + 1), low)
    last[0, 0], last[2, 1:] = 0.0, -skip * np.arange(1, m + 1)
    for i in range(1, n + 1):
        now = np.full((3, m + 1), low)
        now[1, 0] = 0.0
        diagonal = last[:, :-1]
        back[0, i, 1:] = diagonal.argmax(axis=0)
        now[0, 1:] = diagonal.max(axis=0) + score[i - 1] + late * i / n
        out = np.stack((last[0] - open_gap, last[1] - extend, last[2] - open_gap))
        back[1, i, 1:], now[1, 1:] = out[:, 1:].argmax(axis=0), out[:, 1:].max(axis=0)
        # skipping script words runs along the row
        head = np.maximum(now[0], now[1])
        place = skip * np.arange(m + 1)
        reach = np.maximum.accumulate(np.where(np.arange(m + 1) >= 0, head + place, low))
        now[2, 1:] = reach[:-1] - place[1:]
        back[2, i, 1:] = np.where(now[2, 1:] <= head[:-1] - skip + 1e-12, np.where(now[0, :-1] >= now[1, :-1], 0, 1), 2)
        last = now
    state, i, j = int(last[:, m].argmax()), n, m
    at = np.full(n, -1)
    while i > 0 and j > 0:
        step = int(back[state, i, j])
        if state == 0:
            at[i - 1] = j - 1 if score[i - 1, j - 1] >= 0.6 else -2
            i, j = i - 1, j - 1
        elif state == 1:
            i -= 1
        else:
            j -= 1
        state = step
    return at


def is_false_start(run: list[str], before: list[str], after: list[str]) -> bool:
    """Is a left-out run said again right after it, or a stutter of what came just before."""

    def ordered(x: list[str], y: list[str]) -> tuple[int, int]:
        s = Scores(x, y).full if x and y else np.zeros((0, 0))
        pairs = lcs_pairs(s >= 0.6) if s.size else []
        return len(pairs), sum(s[p] >= 2 for p in pairs)

    likes = lambda a, b: word_likeness(a, b) >= 0.6
    head = next((k for k in range(len(run) - 1, -1, -1) if any(likes(run[k], w) for w in after[:2])), None)
    if head is not None:
        tail, lead = run[head:], run[:head]
        n, strong = ordered(tail, after[: len(tail) + 2])
        said = sum(any(likes(w, v) for v in after[: len(run) + 4]) for w in lead)
        if (said == len(lead) or (len(lead) == 1 and head == 1)) and n >= math.ceil(0.6 * len(tail)) and strong + bool(said) >= 1 and (strong or len(run) >= 2):
            return True
    if before and likes(run[-1], before[-1]):
        n, strong = ordered(run, before[-(len(run) + 2) :])
        return n >= math.ceil(0.6 * len(run)) and strong >= 1
    return False


def script_takes_of(words: list[dict], script: list[str], most_words: int = 6, most_seconds: float = 4.0, known: dict | None = None) -> list[dict]:
    """Broken-off takes of a script's words: runs that the alignment leaves out and that are said again or stutter. Nothing is cut beyond nine million word pairs."""
    t, s = [spoken_key(w["text"]) for w in words], [spoken_key(w) for w in script]
    if len(t) < 4 or len(s) < 4 or len(t) * len(s) > 9e6:
        return []
    at, n, out, i = global_alignment(Scores(t, s, known).full), len(t), [], 0
    while i < n:
        if at[i] != -1:
            i += 1
            continue
        e = i
        while e + 1 < n and at[e + 1] == -1 and words[e + 1]["start"] - words[e]["end"] < 1:
            e += 1
        run = [x for x in t[i : e + 1] if x]
        took = words[e]["end"] - words[i]["start"]
        before = [t[k] for k in range(i) if at[k] != -1 and t[k]][-8:]
        after = [t[k] for k in range(e + 1, n) if at[k] != -1 and t[k]][:8]
        if run and len(run) <= most_words and (took <= most_seconds or (len(run) <= 4 and took <= 6)) and is_false_start(run, before, after):
            end = max(words[e]["end"], min(words[e + 1]["start"], words[e]["end"] + 0.25)) if e + 1 < n else words[e]["end"]
            out.append({"start": words[i]["start"], "end": end, "text": " ".join(w["text"] for w in words[i : e + 1]), "reason": "not the take in your script"})
        i = e + 1
    return out


def script_keep_of(words: list[dict], script: str, cover: float = 0.55, near_best: float = 0.75, known: dict | None = None) -> list[dict]:
    """Everything but one take of each script sentence: the last that is nearly as complete as the best. Off-script stretches of three words or more go too, unless they may be a line that was not found. Nothing is cut if fewer than 40 % of the sentences are found."""
    sents, n = sentences(script), len(words)
    t = [spoken_key(w["text"]) for w in words]
    if n < 10 or len(sents) < 2:
        return []
    full = Scores(t, [w for q in sents for w in q], known).full.T
    rows = np.cumsum([0, *map(len, sents)])
    chosen, others, missing = [], [], []
    for k, q in enumerate(sents):
        own, found = full[rows[k] : rows[k + 1]], []
        for i in np.flatnonzero((own[: min(3, len(q))] >= 0.6).any(axis=0)):
            part = own[:, i : i + math.ceil(1.6 * len(q)) + 3]
            pairs = lcs_pairs(part >= 0.6)
            if pairs and len(pairs) / len(q) >= cover and sum(part[p] >= 1 for p in pairs) >= min(2, len(q) - 1):
                found.append({"k": k, "s": i + pairs[0][1], "e": i + pairs[-1][1], "cov": len(pairs) / len(q)})
        found.sort(key=lambda c: (-c["cov"], c["e"] - c["s"]))
        one: list[dict] = []
        for c in found:
            if not any(min(u["e"], c["e"]) - max(u["s"], c["s"]) + 1 > 0.5 * min(u["e"] - u["s"] + 1, c["e"] - c["s"] + 1) for u in one):
                one.append(c)
        if not one:
            missing.append(k)
            continue
        pick = max((c for c in one if c["cov"] >= one[0]["cov"] * near_best), key=lambda c: c["s"])
        chosen.append(pick)
        others += [c | {"better": c["cov"] > pick["cov"] + 0.1} for c in one if c is not pick]
    if len(chosen) < 0.4 * len(sents):
        return []
    keep, take, doubt = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    for c in chosen:
        keep[c["s"] : c["e"] + 1] = True
    for c in others:
        take[c["s"] : c["e"] + 1] = True
        doubt[c["s"] : c["e"] + 1] |= c["better"]

    def may_be_missing(a: int, b: int) -> bool:
        for k in missing:
            part = full[rows[k] : rows[k + 1], a:b]
            pairs = lcs_pairs(part >= 0.6)
            if len(pairs) >= max(3, 0.4 * len(sents[k])) and any(part[p] >= 1 for p in pairs):
                return True
        return False

    cut = take & ~keep
    loose = ~keep & ~take
    for a, b in np.flatnonzero(np.diff(np.concatenate(([0], loose.astype(int), [0])))).reshape(-1, 2):
        said = sum(bool(x) for x in t[a:b])
        if said >= 3 and not may_be_missing(a, b):
            cut[a:b] = True
            doubt[a:b] |= said < 6
    out, i = [], 0
    while i < n:
        if not cut[i]:
            i += 1
            continue
        e = i
        while e + 1 < n and cut[e + 1] and doubt[e + 1] == doubt[i]:
            e += 1
        end = max(words[e]["end"], min(words[e + 1]["start"], words[e]["end"] + 0.25)) if e + 1 < n else words[e]["end"]
        out.append({"start": words[i]["start"], "end": end, "text": " ".join(w["text"] for w in words[i : e + 1]), "reason": "another take of a line in your script" if take[i] else "not in your script", "needs_review": bool(doubt[i])})
        i = e + 1
    return out


def local_place(spoken: list[str], script: list[str], known: dict | None = None) -> tuple[set[int], int, int]:
    """Script places that a stretch of speech says by local alignment, and its first and last spoken word there."""
    if len(spoken) < 2 or not script:
        return set(), -1, -1
    like = Scores(spoken, script, known).full
    gain = np.where(like >= 2, 2.0, np.where(like >= 0.6, 1.0, -1.0))
    n, m = gain.shape
    h = np.zeros((n + 1, m + 1))
    for i in range(1, n + 1):
        row = np.maximum(0.0, np.maximum(h[i - 1, :-1] + gain[i - 1], h[i - 1, 1:] - 1))
        place = np.arange(1, m + 1)
        h[i, 1:] = np.maximum(row, np.maximum.accumulate(row + place) - place)
    i, j = np.unravel_index(h.argmax(), h.shape)
    end, places, first = i, set(), -1
    while i > 0 and j > 0 and h[i, j] > 0:
        if h[i, j] == h[i - 1, j - 1] + gain[i - 1, j - 1]:
            if like[i - 1, j - 1] >= 0.6:
                places.add(j - 1)
                first = i - 1
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return places, first, end - 1


def attempts_of(words: list[dict], blocks: list[tuple[float, float]], script: str, known: dict | None = None) -> list[dict]:
    """Blocks of speech that another one says again (80 % of its script words; the later wins unless it is broken off), and talk in no line: start, end, text, reason."""
    lines = sentences(script, 1)
    wanted, line_of = [w for q in lines for w in q], [k for k, q in enumerate(lines) for _ in q]
    if len(wanted) < 20:
        return []
    att = []
    for s, e in blocks:
        own = [w for w in words if w["text"] and s <= (w["start"] + w["end"]) / 2 < e]
        places, _, _ = local_place([k for k in (spoken_key(w["text"]) for w in own) if k], wanted, known)
        att.append({"start": s, "end": e, "w": own, "at": places})
    real = [a for a in att if len(a["at"]) >= 3]
    for a in real:
        a["cut"] = any(o is not a and len(a["at"] & o["at"]) >= 0.8 * len(a["at"]) and (len(o["at"]) >= 0.6 * len(a["at"]) if o["start"] > a["start"] else len(a["at"]) < 0.6 * len(o["at"])) for o in real)
    kept = {line_of[p] for a in real if not a["cut"] for p in a["at"]}
    for a in att:
        if len(a["at"]) < 3:
            a["cut"] = len(a["w"]) >= 2 and sum(line_of[p] not in kept for p in a["at"]) < 2
    return [{"start": a["start"], "end": a["end"], "text": " ".join(w["text"] for w in a["w"]), "reason": "another take of a line in your script" if len(a["at"]) >= 3 else "not in your script"} for a in att if a["cut"]]


def keep_every_line_of(words: list[dict], script: str, cuts: list[dict], pad: float = 0.08) -> list[dict]:
    """Cuts trimmed so that no script line comes out much worse than it was said: its latest best take is given back."""
    said = [w for w in words if spoken_key(w["text"])]
    sents = sentences(script, 3)
    if not said or not sents or not cuts:
        return cuts
    full, rows = Scores([w for q in sents for w in q], [spoken_key(w["text"]) for w in said]).full, np.cumsum([0, *map(len, sents)])

    def best(k: int, idx: np.ndarray) -> tuple[float, int, int]:
        q, top = len(sents[k]), (0.0, -1, -1)
        own = full[rows[k] : rows[k + 1]][:, idx] >= 0.6
        for s in range(0, len(idx), max(1, q // 2)):
            pairs = lcs_pairs(own[:, s : s + math.ceil(1.5 * q) + 3])
            if pairs and len(pairs) / q >= top[0]:
                top = (len(pairs) / q, int(idx[s + pairs[0][1]]), int(idx[s + pairs[-1][1]]))
        return top

    for k in range(len(sents)):
        mid = np.array([(w["start"] + w["end"]) / 2 for w in said])
        gone = np.zeros(len(said), bool)
        for c in cuts:
            gone |= (mid >= c["start"]) & (mid < c["end"])
        whole, now = best(k, np.arange(len(said))), best(k, np.flatnonzero(~gone))
        if whole[0] < 0.4 or now[0] >= 0.9 * whole[0]:
            continue
        _, a, b = now if now[0] >= 0.7 * whole[0] and now[1] >= 0 else whole
        for w in said[a : b + 1]:
            lo, hi, out = w["start"] - pad, w["end"] + pad, []
            for c in cuts:
                if c["end"] <= lo or c["start"] >= hi:
                    out.append(c)
                    continue
                if c["start"] < lo:
                    out.append(c | {"end": lo})
                if c["end"] > hi:
                    out.append(c | {"start": hi})
            cuts = out
    return cuts


@F.pandas_udf(T.StringType())
def _spoken(words: pd.Series) -> pd.Series:
    return words.map(spoken_key, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _wanted(scripts: pd.Series) -> pd.Series:
    """The different words of a script, with directions, labels and times or without."""
    return scripts.map(lambda s: sorted({spoken_key(w) for w in [*script_words(s), *(s or "").split(), *_DIRECTION.sub(" ", s or "").split()]} - {""}))


def scored(words: DataFrame, scripts: DataFrame) -> DataFrame:
    """The scripts with the likeness of their words and those that are said: rec_id, script, alike."""
    said = words.select(KEY, _spoken("text").alias("word")).distinct()
    wanted = scripts.select(KEY, F.explode(_wanted("script")).alias("word"))
    return scripts.select(KEY, "script").join(likeness_by_recording(said, wanted), KEY, "left")


def _with_script(words: DataFrame, scripts: DataFrame, kernel, schema: str) -> DataFrame:
    """A kernel over the words and the script of each recording, and the scores of their words, which are looked up and not computed there."""
    kind = words.schema[KEY].dataType.simpleString()
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(w: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        alike = s["alike"].iloc[0] if len(s) else None
        known = {(x["a"], x["b"]): x["score"] for x in alike} if alike is not None else {}
        found = kernel(_words(w), (s["script"].iloc[0] or "") if len(s) else "", known)
        out = pd.DataFrame(found, columns=names)
        out.insert(0, KEY, w[KEY].iloc[0] if len(w) else None)
        return out

    return words.groupBy(KEY).cogroup(scored(words, scripts).groupBy(KEY)).applyInPandas(run, f"{KEY} {kind}, {schema}")


_CUT = "start double, end double, text string, reason string"


def script_takes(words: DataFrame, scripts: DataFrame) -> DataFrame:
    """rec_id, start, end, text, reason. scripts: rec_id, script."""
    return _with_script(words, scripts, lambda w, s, known: script_takes_of(w, script_words(s), known=known), _CUT)


def script_keep(words: DataFrame, scripts: DataFrame) -> DataFrame:
    """rec_id, start, end, text, reason, needs_review."""
    return _with_script(words, scripts, lambda w, s, known: script_keep_of(w, s, known=known), _CUT + ", needs_review boolean")


def script_attempts(words: DataFrame, scripts: DataFrame, pause: float = 0.8) -> DataFrame:
    """rec_id, start, end, text, reason; blocks of speech are words less than ``pause`` apart."""

    def kernel(w: list[dict], s: str, known: dict):
        blocks: list[tuple[float, float]] = []
        for x in w:
            if blocks and x["start"] - blocks[-1][1] < pause:
                blocks[-1] = (blocks[-1][0], max(blocks[-1][1], x["end"]))
            else:
                blocks.append((x["start"], x["end"]))
        return attempts_of(w, blocks, s, known)

    return _with_script(words, scripts, kernel, _CUT)
