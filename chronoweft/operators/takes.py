"""Repeated takes, stumbles and fillers in a recording's words.

Each operator is a kernel over the words of one recording: rec_id, ord, start, end, text, and where known
speaker, conf and estimated.  They return cuts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.functions import words as lists
from chronoweft.functions.text import sound, sounds_same, spoken_key
from chronoweft.operators.signal import per_recording, values
from chronoweft.sources.folders import spread

KEY = "rec_id"
_ARROW = {"double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
SENTENCE = re.compile("[.!?।॥۔؟？！…][\"'”’)\\]]*$")
QUESTION = re.compile("[?؟？][\"'”’)\\]]*$")
STATEMENT = re.compile("[.!।॥۔！][\"'”’)\\]]*$")
PAUSE = re.compile("[,.!?;:…—–।॥۔؟،-][\"'”’)\\]]*$")
CLOSED = re.compile("[,;:…—–.!?।॥۔؟،？！-][\"'”’)\\]]*$")
_set = lambda x: frozenset(spoken_key(w) for w in x)
FILL, LEAD, GLUE, SECOND, FIRST, ASK = (_set(x) for x in (lists.TAKE_FILLERS, lists.TAKE_LEAD, lists.GLUE, lists.SECOND_PERSON, lists.FIRST_PERSON, lists.ASKING))
BACK, AGREE, INTERJ, EMPH, REMARK, VERB, OPEN = (_set(x) for x in (lists.BACK_CHANNEL, lists.AGREEING, lists.INTERJECTIONS, lists.EMPHATIC, lists.REMARKS, lists.VERB_ENDS, lists.OPEN_ENDS))
STRONG, WEAK, RETRY, AGAIN, STUMBLE = (_set(x) for x in (lists.CHAT_STRONG, lists.CHAT_WEAK, lists.RETRY_OPEN, lists.RETRY_AGAIN, lists.STUMBLES))
CHAT = [" ".join(spoken_key(w) for w in p.split()) for p in lists.CHAT_PHRASES]
NEG, NEG_IN = _set(lists.NEGATIONS), _set(lists.NEGATIVE_INTERJECTIONS)


# ---- likeness of phrases ---------------------------------------------------------------


def common(a: list[str], b: list[str]) -> int:
    """Longest common subsequence of words that are the same or sound so.

    A row of the usual table is one whole number, in which a bit of 0 is a step up, and a word updates it at once.
    """
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[sound(y)] = places.get(sound(y), 0) | 1 << j
    all_ = row = (1 << len(b)) - 1
    for x in a:
        met = row & places.get(sound(x), 0)
        row = ((row + met) | (row - met)) & all_
    return len(b) - row.bit_count()


def similarity(a: list[str], b: list[str]) -> float:
    return common(a, b) / max(len(a), len(b)) if a and b else 0.0


def containment(a: list[str], b: list[str]) -> float:
    return common(a, b) / min(len(a), len(b)) if a and b else 0.0


def is_prefix(a: list[str], b: list[str], share: float = 0.7) -> bool:
    """Is a, the shorter one, nearly how b starts."""
    return 0 < len(a) < len(b) and sum(sounds_same(x, y) for x, y in zip(a, b, strict=False)) / len(a) >= share


def content(tokens: list[str]) -> list[str]:
    """Tokens without fillers, a repeated one once."""
    out: list[str] = []
    for t in tokens:
        if t not in FILL and (not out or out[-1] != t):
            out.append(t)
    return out


def _skip(tokens: list[str], sets: tuple[frozenset, ...], most: int) -> int:
    k = 0
    while k < len(tokens) - 1 and k < most and any(tokens[k] in s for s in sets):
        k += 1
    return k


def opening(tokens: list[str], n: int) -> list[str]:
    k = _skip(tokens, (LEAD,), 3)
    return tokens[k : k + n]


def body(tokens: list[str]) -> list[str]:
    return tokens[_skip(tokens, (LEAD, AGREE, INTERJ, FILL), 3) :]


def restarts(a: list[str], b: list[str]) -> bool:
    """Do both open alike: a content word in common, or the same two words."""
    x, y = opening(a, 3), opening(b, 3)
    if any(w not in GLUE and w not in FIRST and w not in SECOND and any(sounds_same(w, v) for v in y) for w in x):
        return True
    return len(x) >= 2 and len(y) >= 2 and sounds_same(x[0], y[0]) and sounds_same(x[1], y[1])


def opens_agreeing(tokens: list[str]) -> bool:
    return bool(tokens) and tokens[_skip(tokens, (FILL, INTERJ), 2)] in AGREE


def carries_on(a: list[str], b: list[str]) -> bool:
    """Does b say a again from its start and go on past its last word."""
    x, y = body(a), body(b)
    return bool(x) and is_prefix(x, y) and sounds_same(y[len(x) - 1], x[-1])


def is_remark(unit: list[str], first: str, second: str) -> bool:
    """Is a unit said twice a remark, not a restart: a closed clause, or words of praise and agreement."""
    if unit[-1] in VERB:
        return True
    if unit[-1] in OPEN:
        return False
    praise = [w in REMARK or w in INTERJ for w in unit]
    if any(praise) and all(p or w in GLUE or w in FIRST or w in SECOND or w in EMPH for p, w in zip(praise, unit, strict=True)):
        return True
    return bool(CLOSED.search(first) and CLOSED.search(second))


# ---- repeated takes ------------------------------------------------------------------------


@dataclass
class Phrase:
    """A candidate take."""

    words: list[dict]
    tokens: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.tokens = [t for t in (spoken_key(w["text"]) for w in self.words) if t]
        self.said = content(self.tokens)
        self.start, self.end = self.words[0]["start"], self.words[-1]["end"]
        self.last = (self.words[-1]["text"] or "").strip()
        self.asks, self.states = bool(QUESTION.search(self.last)), bool(STATEMENT.search(self.last))
        counts: dict[str, int] = {}
        self.speaker, most = None, 0
        for w in self.words:
            if w.get("speaker"):
                counts[w["speaker"]] = counts.get(w["speaker"], 0) + 1
                if counts[w["speaker"]] > most:
                    self.speaker, most = w["speaker"], counts[w["speaker"]]
        t = self.tokens
        self.you, self.me, self.question = (any(x in s for x in t) for s in (SECOND, FIRST, ASK))
        self.nod = bool(t) and all(x in BACK for x in t)
        self.agrees = opens_agreeing(t)
        self.negative = any(x in NEG or x.endswith("n't") or (0 < k < len(t) - 1 and x in NEG_IN) for k, x in enumerate(t))
        known = [w["conf"] for w in self.words if w.get("conf") is not None]
        self.confidence = sum(known) / len(known) if known else None

    @property
    def text(self) -> str:
        return " ".join(w["text"] for w in self.words)


def split_phrases(words: list[dict], pause: float = 0.45) -> list[list[dict]]:
    """Words cut at pauses, sentence ends and changes of speaker."""
    out: list[list[dict]] = []
    for k, w in enumerate(words):
        before = words[k - 1] if k else None
        changed = before and before.get("speaker") and w.get("speaker") and before["speaker"] != w["speaker"]
        if not before or w["start"] - before["end"] > pause or SENTENCE.search(before["text"] or "") or changed:
            out.append([])
        out[-1].append(w)
    return out


def _split_asides(words: list[dict], most: int) -> list[list[dict]]:
    """A phrase that turns into "wait, let me do that again", in two."""
    t = [spoken_key(w["text"]) for w in words]
    for k in range(2, len(t) - 1):
        if t[k] not in RETRY or len(t) - k > most:
            continue
        tail = t[k:]
        chat = sum(x in STRONG or x in WEAK for x in tail)
        if (any(x in AGAIN for x in tail) or _has_chat(tail)) and chat / len(tail) >= 0.75:
            return [words[:k], words[k:]]
    return [words]


def _has_chat(tokens: list[str]) -> bool:
    joined = f" {' '.join(tokens)} "
    return any(f" {p} " in joined for p in CHAT)


def _words(frame: pd.DataFrame) -> list[dict]:
    cols = [c for c in ("ord", "start", "end", "text", "speaker", "conf", "estimated", "cue_start", "cue_end") if c in frame]
    rows = frame.sort_values(["start", "end", "ord"])[cols].to_dict("records")
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v
    return [{k: clean(v) for k, v in r.items()} | {"text": r["text"] or ""} for r in rows]


def _per_words(words: DataFrame, kernel: Callable[[list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """Apply a kernel on the words of each recording, in order; it returns tuples without the key. Words go there by columns of Arrow, in as many tasks as the session shuffles to."""
    key = words.schema[KEY].dataType.simpleString()
    have = [c for c in ("speaker", "conf", "estimated", "cue_start", "cue_end") if c in words.columns]
    rows = words.select(KEY, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "ord", "text", *have)
    names, kinds = zip(*((c.strip().split(" ")[0], _ARROW[c.strip().split(" ")[1]]) for c in schema.split(",")), strict=True)

    def run(of: tuple, table: pa.Table) -> pa.Table:
        t = table.drop_columns([KEY]).sort_by([(c, "ascending") for c in ("start", "end", "ord")])
        said = [dict(zip(t.column_names, v, strict=True)) for v in zip(*map(values, t.columns), strict=True)]
        for w in said:
            w["text"] = w["text"] or ""
        found = list(zip(*kernel(said), strict=True)) or [()] * len(names)
        own = pa.array([of[0].as_py()] * len(found[0]), table.schema.field(KEY).type)
        return pa.table([own, *map(pa.array, found, kinds)], names=[KEY, *names])

    return spread(rows, KEY).groupBy(KEY).applyInArrow(run, f"{KEY} {key}, {schema}")


def stumbles(words: DataFrame, gap: float = 0.7) -> DataFrame:
    """One or two words said again at once by one speaker: the earlier saying, rec_id, start, end, text, needs_review. Only small joining words and pairs are sure; words that start with a digit are left alone."""

    def kernel(ws: list[dict]):
        t = [(spoken_key(w["text"]), w) for w in ws]
        t = [x for x in t if x[0]]
        same = lambda i, j: t[i][0] == t[j][0] and (not t[i][1].get("speaker") or not t[j][1].get("speaker") or t[i][1]["speaker"] == t[j][1]["speaker"])
        i = 0
        while i < len(t):
            hit = 0
            for n in (2, 1):
                if i + n < len(t) and t[i][0] != t[i + n][0]:
                    continue
                if i + 2 * n <= len(t) and all(same(i + k, i + n + k) and not t[i + k][0][0].isdigit() for k in range(n)) and not (n == 2 and t[i][0] == t[i + 1][0]) and t[i + n][1]["start"] - t[i + n - 1][1]["end"] <= gap:
                    hit = n
                    break
            if not hit:
                i += 1
                continue
            times = 1
            while i + (times + 2) * hit <= len(t) and all(same(i + k, i + (times + 1) * hit + k) for k in range(hit)) and t[i + (times + 1) * hit][1]["start"] - t[i + (times + 1) * hit - 1][1]["end"] <= gap:
                times += 1
            first, last = t[i][1], t[i + times * hit][1]
            said = " ".join(x[1]["text"] for x in t[i : i + times * hit])
            sure = (hit == 2 or t[i][0] in STUMBLE) and not first.get("estimated")
            if last["start"] > first["start"]:
                yield first["start"], last["start"], said, not sure
            # the last saying may start another repetition
            i += times * hit

    return _per_words(words, kernel, "start double, end double, text string, needs_review boolean")


# ---- fillers --------------------------------------------------------------------------------


def _guarded(run: list[dict], i: int, n: int) -> bool:
    """Does grammar keep the discourse words at i in their sentence."""
    before = run[i - 1]["tok"] if i else ""
    after = run[i + n]["tok"] if i + n < len(run) else ""
    first, last = run[i]["tok"], run[i + n - 1]["text"]
    closed = bool(PAUSE.search(last))
    if QUESTION.search(last):
        return True
    if n == 1 and first == "like":
        return before in lists.LIKE_AFTER or bool(re.match(r"\d|(one|two|three|four|five|six|seven|eight|nine|ten|hundred|half|about|a)$", after))
    if n == 1 and first in ("matlab", "matlb", "मतलब"):
        return before in lists.MATLAB_AFTER or (not closed and after in lists.MATLAB_BEFORE)
    if n == 1 and first in ("aa", "आ"):
        return not closed and after in lists.AA_BEFORE
    return n == 2 and first == "you" and (before in lists.YOU_KNOW_AFTER or (not closed and after in lists.YOU_KNOW_BEFORE))


@lru_cache
def _filler_lists(extra: bool) -> tuple[set[str], set[str], set[str], dict[str, list[list[str]]], dict[str, list[list[str]]]]:
    """Single fillers, those of them that only count between pauses, discourse words, and phrases of both kinds by their first words."""

    def by_first(phrases: list[str]) -> dict[str, list[list[str]]]:
        out: dict[str, list[list[str]]] = {}
        for p in phrases:
            out.setdefault(p.split()[0], []).append(p.split())
        return out

    single = set(lists.FILLERS) | (set(lists.EXTRA_FILLERS) if extra else set())
    return single, set(lists.EXTRA_FILLERS) - set(lists.FILLERS), set(lists.DISCOURSE), by_first(lists.EXTRA_PHRASES if extra else []), by_first(lists.DISCOURSE_PHRASES)


def fillers_of(run: list[dict], extra: bool = False, pause: float = 0.18, padding: float = 0.0, timed: bool = True) -> list[dict]:
    """Fillers of one run of words: the longest phrase first; discourse words only between pauses or where the whole run is filler."""
    single, soft, discourse, phrases, spoken = _filler_lists(extra)
    whole = all(w["tok"] in single or w["tok"] in discourse for w in run)

    def longest(i: int, of: dict[str, list[list[str]]]) -> int:
        return max((len(p) for p in of.get(run[i]["tok"], ()) if [w["tok"] for w in run[i : i + len(p)]] == p), default=0)

    def free(i: int, n: int) -> bool:
        left = i == 0 or PAUSE.search(run[i - 1]["text"]) or (timed and run[i]["start"] - run[i - 1]["end"] >= pause)
        e = i + n - 1
        right = e == len(run) - 1 or PAUSE.search(run[e]["text"]) or (timed and run[e + 1]["start"] - run[e]["end"] >= pause)
        return not _guarded(run, i, n) and (whole or bool(left and right))

    out, i = [], 0
    while i < len(run):
        n = longest(i, phrases)
        if not n and run[i]["tok"] in single and (run[i]["tok"] not in soft or free(i, 1)):
            n = 1
        if not n:
            d = longest(i, spoken) or int(run[i]["tok"] in discourse)
            n = d if d and free(i, d) else 0
        if not n:
            i += 1
            continue
        s, e = run[i]["start"], run[i + n - 1]["end"]
        if padding:
            low = min(run[i - 1]["end"], s) if i else max(0.0, s - padding)
            high = max(run[i + n]["start"], e) if i + n < len(run) else e + padding
            s, e = max(s - padding, low), min(e + padding, high)
        out.append({"start": s, "end": e, "text": " ".join(re.sub("^[\"'“”‘’(\\[]+|[,.!?;:…—–।॥۔؟،\"'“”‘’)\\]-]+$", "", w["text"]) for w in run[i : i + n]), "from": i, "to": i + n})
        i += n
    return out


def fillers(words: DataFrame, extra: bool = False, pause: float = 0.18, padding: float = 0.0, gap: float = 0.5) -> DataFrame:
    """Filler ranges of timed words: rec_id, start, end, text. A run of words ends at a gap of ``gap``; fillers next to each other are one range."""

    def kernel(said: list[dict]):
        run: list[dict] = []
        ws = [w | {"text": w["text"].strip(), "tok": spoken_key(w["text"])} for w in said if w["text"].strip() and w["end"] >= w["start"]]
        for k, w in enumerate([*ws, None]):
            if run and (w is None or w["start"] - run[-1]["end"] >= gap):
                found = fillers_of(run, extra, pause, padding)
                joined: list[dict] = []
                for f in found:
                    if joined and joined[-1]["to"] == f["from"]:
                        joined[-1] |= {"end": max(joined[-1]["end"], f["end"]), "text": f"{joined[-1]['text']} {f['text']}", "to": f["to"]}
                    else:
                        joined.append(f)
                yield from ((f["start"], f["end"], f["text"]) for f in joined)
                run = []
            if w is not None:
                run.append(w)

    return _per_words(words, kernel, "start double, end double, text string")


def review(takes: DataFrame, stumbled: DataFrame, filled: DataFrame, slack: float = 0.03) -> DataFrame:
    """All kinds of cuts in one list, rows inside one of an earlier kind left out: rec_id, kind, start, end, text. Takes come before stumbles, stumbles before fillers."""
    from chronoweft.operators import joins

    named = lambda f, kind, rank: f.select(KEY, F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), "start", "end", "text")
    all_ = named(takes, "take", 0).unionByName(named(stumbled, "stumble", 1)).unionByName(named(filled, "filler", 2))
    outer = all_.select(KEY, F.col("rank").alias("_r"), (F.col("start") - slack).alias("_s"), (F.col("end") + slack).alias("_e"))
    inside = joins.overlap(all_, outer, ("start", "end"), ("_s", "_e"), closed=True).filter("_r < rank and start >= _s and end <= _e").select(KEY, "kind", "start", "end").distinct()
    return all_.join(inside, [KEY, "kind", "start", "end"], "left_anti").drop("rank")


def phrase_pairs(words: DataFrame, window: int = 16, pause: float = 0.45) -> DataFrame:
    """Phrases of a recording with those up to ``window`` after them and their likeness: rec_id, a, b, similarity, containment."""

    def kernel(frame: pd.DataFrame):
        p = [Phrase(x) for x in split_phrases(_words(frame), pause)]
        return [(i, j, similarity(p[i].said, p[j].said), containment(p[i].said, p[j].said)) for i in range(len(p)) for j in range(i + 1, min(len(p), i + window + 1)) if p[i].said and p[j].said]

    return per_recording(words, kernel, "a long, b long, similarity double, containment double")
