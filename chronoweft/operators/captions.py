"""Captions: grouping words, timing groups on the frame grid, frames of an animation, and the plan of an overlay."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.functions import text as words_
from chronoweft.functions import words as lists
from chronoweft.functions.timecode import NTSC, half_up
from chronoweft.operators.signal import per_recording
from chronoweft.sources.folders import spread

KEY = "rec_id"
# What a caption may hold, in seconds, characters a second and frames.
RULES = {"pause": 0.5, "most": 7.0, "least_many": 0.833, "least_one": 0.3, "linger": 0.5, "cps": 20.0, "cps_deva": 22.0, "gap_frames": 2, "flash": 0.2}
_ABBR, _CONJ, _POST, _AUX, _BAD, _GEN = (frozenset(x) for x in (lists.ABBREVIATIONS, lists.CONJUNCTIONS, lists.POSTPOSITIONS, lists.AUXILIARIES, lists.BAD_LINE_ENDS, lists.GENITIVES))


def rate(fps: float) -> float:
    fps = fps or 30.0
    return next((n / 1001 for n in NTSC if abs(fps - n / 1001) < 0.01), fps)


def _frame(x: float) -> int:
    return math.floor(x + 0.5)


@lru_cache(1 << 16)
def _bare(w: str) -> str:
    import re

    return re.sub("[^a-z0-9'ऀ-ॣ०-ॿ]", "", (w or "").lower())


@lru_cache(1 << 16)
def sentence_end(word: str) -> bool:
    import re

    w = re.sub("[\"'»)\\]”’]+$", "", word or "")
    if re.search("[!?।॥۔]$", w):
        return True
    core = w.rstrip(".")
    if core == w or core.lower() in _ABBR:
        return False
    return not (re.fullmatch(r"([A-Za-z]\.)*[A-Za-z]", core) and re.search("[A-Z]", core)) and not re.fullmatch(r"([a-z]\.)+[a-z]", core)


def hinglish(texts: list[str]) -> bool:
    import re

    keys = [_bare(t) for t in texts]
    hindi, english = sum(k in lists.HINDI_MARKS for k in keys), sum(k in lists.ENGLISH_MARKS for k in keys)
    return any(re.search("[ऀ-ॿ]", t or "") for t in texts) or (hindi >= 2 and hindi >= 0.6 * english)


def break_cost(before: str, after: str, mixed: bool | None = None) -> float:
    """Cost of a break between two words; infinite where grammar forbids it. See functions.text.line_break_cost."""
    import re

    if not before or not after:
        return 0.0
    b, a = _bare(before), _bare(after)
    verb = bool(re.search("(te|ti|ta|ye|ae|aye|rahe|gaye|hue|baithe|kar|liye|diye|kiye)$", b))
    the_verb = a == "the" and (bool(mixed) and (verb or b in _AUX) if mixed is not None else verb and b not in ("the", "to", "be", "we", "he", "she", "me", "ye"))
    if after[0] in "।॥" or a in _POST or a in _AUX or the_verb:
        return math.inf
    if sentence_end(before):
        return 0.0
    if re.search("[,;:—–][\"'»)\\]”’]?$", before):
        return 0.1
    if b in _BAD or (b == "the" and not mixed):
        return 3.0
    if b in _GEN or (re.fullmatch(r"\d[\d,.]*", b) and not re.match(r"\d", a)):
        return 2.5
    if re.fullmatch("[A-Z][a-z]+", before) and re.fullmatch("[A-Z][a-z]+", after):
        return 2.0
    return 0.25 if a in _CONJ else 1.0


def _split(words: list[dict], a: int, b: int, most_words: int, fits: Callable[[int, int], bool], mixed: bool, rules: dict, length: Callable[[int], float]) -> list[tuple[int, int]]:
    """Words a to b in captions: fewest forbidden breaks, then fewest captions, then least cost of breaks, unevenness, single words and reading speed."""
    n = b - a
    if n <= 1:
        return [(a, b)]
    cost = [0.0] + [break_cost(words[a + k - 1]["text"], words[a + k]["text"], mixed) for k in range(1, n)] + [0.0]
    wrong = [int(c == math.inf) for c in cost]
    soft = [0.0 if c == math.inf else c for c in cost]
    width, chars = [0.0], [0]
    for k in range(n):
        width.append(width[-1] + length(a + k))
        chars.append(chars[-1] + len(words[a + k]["text"]) + 1)
    deva = any("ऀ" <= c <= "ॿ" for k in range(n) for c in words[a + k]["text"])
    speed = rules["cps_deva"] if deva else rules["cps"]
    room = words[b]["start"] if b < len(words) else math.inf

    def reading(x: int, y: int) -> float:
        start = words[a + x]["start"]
        until = words[a + y]["start"] - 0.07 if y < n else min(room - 0.07, start + rules["most"])
        shown = max(0.04, until - start)
        fast = (chars[y] - chars[x] - 1) / shown
        return (6 * (fast / speed - 1) if fast > speed else 0.0) + (6.0 if y < n and shown < rules["flash"] else 0.0)

    def starts(y: int) -> list[int]:
        """Where a caption that ends at y may start, from y - 1 back to the first that doesn't fit."""
        out = []
        for x in range(y - 1, -1, -1):
            ok = y - x == 1 or ((not most_words or y - x <= most_words) and words[a + y - 1]["end"] - words[a + x]["start"] <= rules["most"] + 1e-9 and fits(a + x, a + y))
            if not ok:
                break
            out.append(x)
        return out

    allowed = [starts(y) for y in range(n + 1)]
    fewest: list[tuple[int, int] | None] = [(0, 0)] + [None] * n
    for y in range(1, n + 1):
        fewest[y] = min(((fewest[x][0] + wrong[x] * (x > 0), fewest[x][1] + 1) for x in allowed[y] if fewest[x] is not None), default=None)
    groups = fewest[n][1]
    if groups == 1:
        return [(a, b)]
    mean = width[n] / groups
    # steps from the start and to the end: a place takes part only in those counts of captions that can go on to both
    ahead, behind = [0] + [n + 1] * n, [n + 1] * n + [0]
    for y in range(1, n + 1):
        ahead[y] = min(ahead[x] for x in allowed[y]) + 1
    for y in range(n, 0, -1):
        for x in allowed[y]:
            behind[x] = min(behind[x], behind[y] + 1)

    def terms(x: int, y: int) -> tuple[float, float, float]:
        uneven = (width[y] - width[x] - mean) / max(1.0, mean)
        return 2 * uneven * uneven, 4.0 if y - x == 1 and most_words != 1 else 0.0, reading(x, y)

    parts = [[terms(x, y) for x in allowed[y]] if ahead[y] + behind[y] <= groups else [] for y in range(n + 1)]
    table: list[list[tuple | None]] = [[None] * (n + 1) for _ in range(groups + 1)]
    table[0][0] = (0, 0.0, -1)
    takes_part: list[list[int]] = [[] for _ in range(groups + 1)]
    for y in range(1, n + 1):
        for g in range(ahead[y], min(groups - behind[y], y) + 1):
            takes_part[g].append(y)
    for g in range(1, groups + 1):
        for y in takes_part[g]:
            best = None
            for x, (even, single, fast) in zip(allowed[y], parts[y], strict=True):
                last = table[g - 1][x]
                if last is None:
                    continue
                c = last[1] + (soft[x] if x else 0.0) + even + single + fast
                f = last[0] + (wrong[x] if x else 0)
                if best is None or f < best[0] or (f == best[0] and c < best[1] - 1e-12):
                    best = (f, c, x)
            table[g][y] = best
    out, at = [], n
    for g in range(groups, 0, -1):
        out.append((a + table[g][at][2], a + at))
        at = table[g][at][2]
    return out[::-1]


def _stretch(words: list[dict], start: int, end: int, most_words: int, fits: Callable[[int, int], bool] | None, mixed: bool, rules: dict) -> list[tuple[int, int]]:
    """Captions of the words between two hard breaks; those of over 300 words are cut at their best break first."""
    fits, length = fits or (lambda a, b: True), lambda k: words_.visible(words[k]["text"]) + 1
    out = []
    while end - start > 300:
        cut = min(range(start + 150, start + 251), key=lambda c: break_cost(words[c - 1]["text"], words[c]["text"], mixed))
        out += _split(words, start, cut, most_words, fits, mixed, rules, length)
        start = cut
    return out + _split(words, start, end, most_words, fits, mixed, rules, length)


def _records(frame: pd.DataFrame) -> list[dict]:
    cols = [c for c in ("ord", "start", "end", "text", "speaker") if c in frame]
    return [r | {"text": r["text"] or "", "speaker": r.get("speaker") or None} for r in frame.sort_values(["start", "end", "ord"])[cols].to_dict("records")]


#: Stretches between hard breaks that are dealt to one task together.
DEALT = 64


def width_test(words: list[dict], max_chars: int) -> Callable[[int, int], bool]:
    """Do words a to b, with spaces between them, fit into so many letters."""
    width, deva = [0.0], [0]
    for w in words:
        own = any("ऀ" <= c <= "ॿ" for c in w["text"])
        deva.append(deva[-1] + own)
        width.append(width[-1] + (0.0 if own else words_.visible(w["text"]) + 1))
    # clusters that count 1.1 are summed as they stand, all others are whole numbers
    return lambda a, b: (width[b] - width[a] - 1 if deva[a] == deva[b] else words_.visible(" ".join(w["text"] for w in words[a:b]))) <= max_chars


def grouped(words: DataFrame, most_words: int = 0, max_chars: int = 0, rules: dict | None = None) -> DataFrame:
    """Words with their captions: rec_id, k (the word's place), start, end, text, caption (from 0). words: rec_id, ord, start, end, text, speaker (optional).

    No caption runs over a sentence end, a pause or a change of speaker, so what stands between two of those is
    grouped by itself, and a recording of any length is spread over tasks.
    """
    rules = rules or RULES
    order = Window.partitionBy(KEY).orderBy("start", "end", "ord")
    speaker = F.when(F.col("speaker") != "", F.col("speaker")) if "speaker" in words.columns else F.lit(None).cast("string")
    rows = words.select(KEY, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "ord", F.coalesce("text", F.lit("")).alias("text"), speaker.alias("speaker"))
    other = F.coalesce(F.col("speaker") != F.lead("speaker").over(order), F.lit(False))
    rows = rows.withColumn("k", F.row_number().over(order).cast("long") - 1).withColumn("room", F.lead("start").over(order))
    rows = rows.withColumn("ends", words_.is_sentence_end("text") | (F.col("room") - F.col("end") >= rules["pause"] - 1e-9) | other)
    rows = rows.withColumn("h", F.coalesce(F.sum(F.col("ends").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    key = words_.bare("text")
    marks = [F.sum(key.isin(*names).cast("int")).alias(n) for n, names in (("hindi", lists.HINDI_MARKS), ("english", lists.ENGLISH_MARKS))]
    mixed = rows.groupBy(KEY).agg(F.max(F.col("text").rlike(r"[\x{0900}-\x{097F}]")).alias("deva"), *marks)
    mixed = mixed.select(KEY, (F.col("deva") | ((F.col("hindi") >= 2) & (F.col("hindi") >= 0.6 * F.col("english")))).alias("mixed"))
    dealt = rows.join(mixed, KEY).select(KEY, "k", "start", "end", "text", "room", "h", "mixed").withColumn("_d", F.expr(f"h div {DEALT}"))
    dealt = spread(dealt, KEY, "_d").sortWithinPartitions(KEY, "k").drop("_d")

    def cut(stretch: list[tuple]) -> list[tuple]:
        """A stretch's rows with whether each begins a caption."""
        ws = [{"start": r[2], "end": r[3], "text": r[4]} for r in stretch]
        room = stretch[-1][5]
        if room is not None and room == room:
            ws.append({"start": room, "end": room, "text": ""})
        fits = width_test(ws, max_chars) if max_chars else None
        starts = {a for a, _ in _stretch(ws, 0, len(stretch), most_words, fits, stretch[0][7], rules)}
        return [(*r[:5], k in starts) for k, r in enumerate(stretch)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, held = [KEY, "k", "start", "end", "text", "first"], []
        for part in parts:
            out: list[tuple] = []
            for row in part.itertuples(index=False, name=None):
                if held and (held[0][0], held[0][6]) != (row[0], row[6]):
                    out += cut(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(cut(held), columns=names)

    begun = dealt.mapInPandas(run, f"{KEY} {words.schema[KEY].dataType.simpleString()}, k long, start double, end double, text string, first boolean")
    return begun.withColumn("caption", F.sum(F.col("first").cast("long")).over(Window.partitionBy(KEY).orderBy("k")) - 1).drop("first")


def caption_groups(words: DataFrame, most_words: int = 0, max_chars: int = 0) -> DataFrame:
    """rec_id, caption, start, end, text, n. words: rec_id, ord, start, end, text, speaker (optional)."""
    of = grouped(words, most_words, max_chars).groupBy(KEY, "caption").agg(F.min_by("start", "k").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("k", "text"))).alias("ws"), F.count(F.lit(1)).alias("n"))
    return of.select(KEY, "caption", "start", F.greatest("end", "start").alias("end"), F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("text"), "n")


def timed(groups: DataFrame, fps: float, rules: dict | None = None) -> DataFrame:
    """Captions on frames: rec_id, caption, s, e, at (the frame of every word) and words. groups: as from grouped.

    Each word is a frame or more behind the one before, captions some frames more, which is a running maximum once
    those frames are taken off.  A caption starts on its first word, lasts long enough to see and to read, lingers
    into silence, and is two frames or at least half a second from the next.
    """
    rules, f = rules or RULES, rate(fps)
    gap, half, most = rules["gap_frames"], _frame(0.5 * f), _frame(rules["most"] * f)
    frame = lambda t: F.floor(t * f + 0.5).cast("long")
    order = Window.partitionBy(KEY).orderBy("k")
    off = F.col("k") + gap * F.col("caption")
    rows = groups.withColumn("_at", off + F.max(frame(F.col("start")) - off).over(order))
    one = rows.groupBy(KEY, "caption").agg(F.sort_array(F.collect_list(F.struct("k", "text", F.col("_at").alias("at")))).alias("ws"), F.min("_at").alias("s"), F.max("_at").alias("last"), F.max_by("end", "k").alias("end"))
    one = one.withColumn("words", F.transform("ws", lambda w: w["text"])).withColumn("at", F.transform("ws", lambda w: w["at"]))
    one = one.withColumn("spoken", F.greatest(F.col("last") + 1, frame(F.col("end")))).withColumn("_t", F.array_join("words", " "))
    seen = F.when(F.size("words") > 1, math.ceil(rules["least_many"] * f - 1e-6)).otherwise(math.ceil(rules["least_one"] * f - 1e-6))
    speed = F.when(F.col("_t").rlike(r"[\x{0900}-\x{097F}]"), rules["cps_deva"]).otherwise(rules["cps"])
    want = F.greatest(F.col("spoken") + _frame(rules["linger"] * f), F.col("s") + seen, F.col("s") + F.ceil(F.length("_t") / speed * f))
    each = Window.partitionBy(KEY).orderBy("caption")
    one = one.withColumn("nxt", F.lead("s").over(each)).withColumn("e", F.least(want, F.greatest("spoken", F.col("s") + most)))
    one = one.withColumn("e", F.when(F.col("nxt").isNotNull(), F.least("e", F.col("nxt") - gap)).otherwise(F.col("e")))
    chained, apart = F.col("nxt") - gap, F.col("nxt") - half
    joined = F.when((chained - F.col("s") <= F.greatest(F.lit(most), F.col("spoken") - F.col("s"))) | (apart < F.col("last") + 1), chained).otherwise(apart)
    one = one.withColumn("e", F.when(F.col("nxt").isNotNull() & (F.col("nxt") - F.col("e") < half), joined).otherwise(F.col("e")))
    return one.select(KEY, "caption", "s", F.greatest("e", F.col("last") + 1).cast("long").alias("e"), "at", "words")


def _cased(case: str) -> Column:
    """The words of a caption in a case."""
    words, upper_first = F.col("words"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
    if case == "lower":
        return F.transform(words, F.lower)
    if case == "upper":
        return F.transform(words, F.upper)
    if case == "title":
        return F.transform(words, upper_first)
    if case == "sentence":
        low = F.transform(words, F.lower)
        first = F.array_position(F.transform(low, lambda w: w.rlike("[a-z]")), True)
        return F.transform(low, lambda w, k: F.when(k + 1 == first, upper_first(w)).otherwise(w))
    return words


def caption_frames(words: DataFrame, fps: float = 30.0, most_words: int = 0, max_chars: int = 0, mode: str = "static", case: str = "", censor: bool = False) -> DataFrame:
    """Frames of captions: rec_id, caption, frame, start, end, words, active, reveal. mode: static (one frame), karaoke (the spoken word is active), reveal (words appear), build (they appear without one being active)."""
    f = rate(fps)
    caps = timed(grouped(words, most_words, max_chars), fps).withColumn("words", _cased(case))
    none = F.lit(None).cast("long")
    if mode == "static":
        out = caps.select(KEY, "caption", F.lit(0).cast("long").alias("frame"), (F.col("s") / f).alias("start"), (F.col("e") / f).alias("end"), "words", none.alias("active"), none.alias("reveal"))
    else:
        each = caps.withColumn("edges", F.concat("at", F.array("e"))).select("*", F.posexplode("at").alias("j", "_a")).withColumn("j", F.col("j").cast("long"))
        edge = lambda k: F.get("edges", k.cast("int")) / f
        out = each.select(KEY, "caption", F.col("j").alias("frame"), edge(F.col("j")).alias("start"), edge(F.col("j") + 1).alias("end"), "words", (none if mode == "build" else F.col("j")).alias("active"), (F.col("j") + 1 if mode in ("reveal", "build") else none).alias("reveal"))
    return out.withColumn("words", F.transform("words", words_.censor)) if censor else out


def readable_groups(words: DataFrame, max_chars: int = 42, max_words: int = 0, max_seconds: float = 6, min_seconds: float = 0.7, max_cps: float = 17) -> DataFrame:
    """Cues filled word by word until characters, words, time or reading speed run over, or a word ends a clause: rec_id, cue, start, end, text."""

    def kernel(frame: pd.DataFrame):
        cues: list[list[dict]] = []
        current: list[dict] = []
        for w in _records(frame):
            text = " ".join(x["text"] for x in [*current, w])
            took = w["end"] - (current or [w])[0]["start"]
            over = len(text) > max_chars or (max_words and len(current) + 1 > max_words) or took > max_seconds or (len(current) >= 2 and len(text) / max(0.3, took) > max_cps)
            if over and current:
                cues.append(current)
                current = []
            current.append(w)
            if w["text"].strip()[-1:] in tuple(".!?…,;:—"):
                cues.append(current)
                current = []
        if current:
            cues.append(current)
        return [(k, c[0]["start"], c[0]["start"] + min_seconds if c[-1]["end"] - c[0]["start"] < min_seconds else c[-1]["end"], " ".join(x["text"] for x in c)) for k, c in enumerate(cues)]

    return per_recording(words, kernel, "cue long, start double, end double, text string")


def capped_groups(words: DataFrame, per: int = 3, max_gap: float = 1.5, max_chars: int = 0) -> DataFrame:
    """Cues of at most ``per`` words and ``max_chars`` characters, broken at gaps over ``max_gap``: rec_id, cue, start, end, text."""

    def kernel(frame: pd.DataFrame):
        cues: list[list[dict]] = []
        for w in _records(frame):
            c = cues[-1] if cues else None
            if c is None or len(c) >= max(1, per) or (max_chars and len(" ".join(x["text"] for x in [*c, w])) > max_chars) or w["start"] - c[-1]["end"] > max_gap:
                cues.append([w])
            else:
                c.append(w)
        return [(k, c[0]["start"], max(max(x["end"] for x in c), c[0]["start"]), " ".join(x["text"] for x in c)) for k, c in enumerate(cues)]

    return per_recording(words, kernel, "cue long, start double, end double, text string")


def balanced(words: list[dict], n: int, per: int = 0, max_chars: int = 0) -> list[list[dict]]:
    """A sentence in about n even parts that end at a clause where one is near; a single last word joins the part before if it fits."""
    import re

    goal, parts, own = max(1, _frame(len(words) / n)), [], []
    chars = lambda ws: words_.visible(" ".join(w["text"] for w in ws))
    fits = lambda ws: (not per or len(ws) <= per) and (not max_chars or chars(ws) <= max_chars)
    closes = lambda w: bool(re.search("[,;:—–][\"'»)\\]”’]?$", w["text"]))
    opens = lambda k: k < len(words) and _bare(words[k]["text"]) in _CONJ
    for k, w in enumerate(words):
        if own and not fits([*own, w]):
            parts.append(own)
            own = []
        own.append(w)
        left = len(words) - k - 1
        if left <= 0 or len(parts) >= n - 1:
            continue
        reserve = n - len(parts) - 1
        here = closes(w) or opens(k + 1)
        one_more = fits([*own, words[k + 1]])
        soon = not here and one_more and (closes(words[k + 1]) or opens(k + 2))
        forbidden = break_cost(w["text"], words[k + 1]["text"]) == math.inf and one_more and left > reserve
        if left <= reserve or (len(own) >= goal and not soon and not forbidden):
            parts.append(own)
            own = []
    if own:
        parts.append(own)
    if len(parts) >= 2 and len(parts[-1]) == 1 and fits(parts[-2] + parts[-1]):
        parts[-2:] = [parts[-2] + parts[-1]]
    return parts


def sentence_groups(words: DataFrame, per: int = 0, max_chars: int = 0, max_gap: float = 1.5) -> DataFrame:
    """Whole sentences as cues, long ones in even parts: rec_id, cue, start, end, text."""

    def kernel(frame: pd.DataFrame):
        ws, hard, out, sentence = _records(frame), max(max_gap, 1.6), [], []
        for k, w in enumerate(ws):
            sentence.append(w)
            if k + 1 == len(ws) or sentence_end(w["text"]) or ws[k + 1]["start"] - w["end"] > hard:
                size = words_.visible(" ".join(x["text"] for x in sentence))
                if (not per or len(sentence) <= per) and (not max_chars or size <= max_chars):
                    out.append(sentence)
                else:
                    out += balanced(sentence, max(2, math.ceil(len(sentence) / per) if per else 1, math.ceil(size / max_chars) if max_chars else 1), per, max_chars)
                sentence = []
        return [(k, c[0]["start"], max(max(x["end"] for x in c), c[0]["start"]), " ".join(x["text"] for x in c)) for k, c in enumerate(out)]

    return per_recording(words, kernel, "cue long, start double, end double, text string")


def min_durations(cues: DataFrame, least: float = 0.32, merge_below: float = 0.12) -> DataFrame:
    """Cues that don't overlap, grown into silence up to ``least``; those still under ``merge_below`` join the one before, the first the next."""

    def kernel(frame: pd.DataFrame):
        cs = frame.sort_values(["start", "end", "ord"])[["start", "end", "text"]].to_dict("records")
        for c, nxt in zip(cs, [*cs[1:], None], strict=True):
            c["end"] = max(c["start"], min(c["end"], nxt["start"]) if nxt else c["end"])
        for c, nxt in zip(cs, [*cs[1:], None], strict=True):
            if c["end"] - c["start"] < least:
                c["end"] = max(c["start"], min(c["start"] + least, nxt["start"] if nxt else c["end"] + least))
        out: list[dict] = []
        for k, c in enumerate(cs):
            if c["end"] - c["start"] < merge_below and (out or k + 1 < len(cs)):
                if out:
                    out[-1]["end"] = max(out[-1]["end"], c["end"])
                    out[-1]["text"] = " ".join(f"{out[-1]['text'] or ''} {c['text'] or ''}".split())
                else:
                    cs[k + 1]["start"] = c["start"]
                    cs[k + 1]["text"] = " ".join(f"{c['text'] or ''} {cs[k + 1]['text'] or ''}".split())
                continue
            out.append(c)
        return [(c["start"], c["end"], c["text"]) for c in out]

    return per_recording(cues, kernel, "start double, end double, text string")


def drop_repeats(cues: DataFrame, words: bool = False) -> DataFrame:
    """Cues without those that repeat one of the last four kept at the same moment; the kept one's end grows. rec_id, ord, start, end, text."""
    slack, margin = (0.15, 0.05) if words else (2.0, 0.3)

    def kernel(frame: pd.DataFrame):
        out: list[dict] = []
        for c in frame.sort_values("ord")[["ord", "start", "end", "text"]].to_dict("records"):
            said = " ".join((c["text"] or "").split()).lower()
            reach = -0.05 if not words and len(said.split(" ")) <= 3 else margin
            twin = next((p for p in out[:-5:-1] if said and p["said"] == said and c["start"] < p["end"] + reach and abs(c["start"] - p["start"]) <= slack), None)
            if twin:
                twin["end"] = max(twin["end"], c["end"])
            else:
                out.append(c | {"said": said})
        return [(c["ord"], c["start"], c["end"], c["text"]) for c in out]

    return per_recording(cues, kernel, "ord long, start double, end double, text string")


def respread(words: DataFrame, short: float = 0.07, long: float = 1.0, least: int = 3) -> DataFrame:
    """Words squeezed into a blink after long ones, spread over the whole stretch by length: rec_id, ord, start, end, text."""

    def kernel(frame: pd.DataFrame):
        ws = frame.sort_values(["start", "end", "ord"])[["ord", "start", "end", "text"]].to_dict("records")
        size, k = [w["end"] - w["start"] for w in ws], 0
        while k < len(ws):
            e = k
            while e < len(ws) and size[e] < short and (ws[e]["text"] or "").strip():
                e += 1
            first = k
            if e - k >= least:
                while first > 0 and k - first < 3 and ws[first - 1]["end"] - ws[first - 1]["start"] > long:
                    first -= 1
            if first < k:
                start, end = ws[first]["start"], ws[e - 1]["end"]
                weights = [len(w["text"] or "") + 1 for w in ws[first:e]]
                at = start
                for w, g in zip(ws[first:e], weights, strict=True):
                    w["start"] = round(at, 3)
                    at += (end - start) * g / sum(weights)
                    w["end"] = round(at, 3)
            k = max(e, k + 1)
        return [(w["ord"], w["start"], w["end"], w["text"]) for w in ws]

    return per_recording(words, kernel, "ord long, start double, end double, text string")


def two_lines(text: str, per_line: int = 42) -> str:
    """A subtitle in at most two lines, broken where it reads best."""
    ws = (text or "").split()
    whole = " ".join(ws)
    if len(ws) < 2 or words_.visible(whole) <= per_line:
        return whole
    mixed, upto, ends = hinglish(ws), words_.visible_upto(whole), list(accumulate(len(w) + 1 for w in ws))

    def score(k: int, cost: float) -> float:
        at = ends[k - 1]
        # a mark that joins the space before it: measured as it stands
        apart = upto[at - 1] is not None and upto[at] is not None
        top, low = (upto[at - 1], upto[-1] - upto[at]) if apart else (words_.visible(whole[: at - 1]), words_.visible(whole[at:]))
        return (max(0, top - per_line) + max(0, low - per_line)) * 10 + cost + abs(top - 0.95 * low) / per_line * 6 + (4 if k in (1, len(ws) - 1) and len(ws) >= 3 else 0)

    best = (math.inf, 0)
    # those that are best without their break's cost come first, so that few costs are needed
    for least, k in sorted((score(k, 0), k) for k in range(1, len(ws))):
        if least > best[0]:
            break
        cost = break_cost(ws[k - 1], ws[k], mixed)
        best = min(best, (score(k, 100 if cost == math.inf else 2 * cost), k))
    return " ".join(ws[: best[1]]) + "\n" + " ".join(ws[best[1] :])


wrap_two = lambda per_line=42: F.pandas_udf(lambda s: s.map(lambda t: two_lines(t, per_line)), "string")


def wrap_lines(widths: list[float], space: float, limit: float) -> list[tuple[int, int]]:
    """Greedy lines of words by their widths."""
    out, start, used = [], 0, 0.0
    for k, w in enumerate(widths):
        if k > start and used + space + w > limit:
            out.append((start, k))
            start, used = k, w
        else:
            used += w + (space if k > start else 0.0)
    return [*out, (start, len(widths))] if widths else []


def break_lines(widths: list[float], ws: list[str], space: float, limit: float, most: int = 0, mixed: bool | None = None, strict: bool = False) -> list[tuple[int, int]] | None:
    """The fewest lines within a width that break where it costs least and are even: None if they don't fit. ``strict`` never breaks where grammar forbids it."""
    n = len(widths)
    cost = [0.0] + [break_cost(ws[k - 1], ws[k], mixed) for k in range(1, n)]
    cost = [(math.inf if strict else 50.0) if c == math.inf else c for c in cost]
    upto = [0.0]
    for w in widths:
        upto.append(upto[-1] + w)
    size = lambda a, b: upto[b] - upto[a] + space * (b - a - 1)
    alone = lambda a, b: 3.0 if b - a == 1 and n >= 3 else 1.0 if b - a == 2 and n >= 6 else 0.0
    for lines in range(1, (min(most, n) if most else n) + 1):
        goal = size(0, n) / lines
        table: list[list[tuple[float, int] | None]] = [[None] * (n + 1) for _ in range(lines + 1)]
        table[0][0] = (0.0, -1)
        for g in range(1, lines + 1):
            for b in range(1, n + 1):
                for a in range(b - 1, -1, -1):
                    if size(a, b) > limit + 0.01:
                        break
                    if table[g - 1][a] is None or (a and cost[a] == math.inf):
                        continue
                    uneven = abs(size(a, b) - (0.95 * size(b, n) if lines == 2 and g == 1 and b < n else goal)) / limit * 4
                    c = table[g - 1][a][0] + cost[a] + (0.0 if lines == 1 or (lines == 2 and g == 2) else uneven) + (alone(a, b) if lines > 1 else 0.0)
                    if table[g][b] is None or c < table[g][b][0]:
                        table[g][b] = (c, a)
        if table[lines][n]:
            out, at = [], n
            for g in range(lines, 0, -1):
                out.append((table[g][at][1], at))
                at = table[g][at][1]
            return out[::-1]
    return None


def native_subtitles(cues: DataFrame, fps: float = 25.0, per_line: int = 42) -> DataFrame:
    """Two-line subtitles on frames, at least a second long, lingering half a second, and two frames or half a second apart: rec_id, i, s, e (frames), start, end, text."""
    f = rate(fps)
    half, gap = _frame(0.5 * f), RULES["gap_frames"]
    w = Window.partitionBy(KEY).orderBy("s", "ord")
    rows = cues.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select(KEY, "ord", half_up(F.col("start") * f).alias("s"), half_up(F.col("end") * f).alias("e"), "text")
    place = (F.row_number().over(w) - 1) * (1 + gap)
    rows = rows.withColumn("_p", place).withColumn("s", (F.max(F.col("s") - F.col("_p")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_p")).cast("long"))
    nxt = F.lead("s").over(Window.partitionBy(KEY).orderBy("_p"))
    want = F.greatest(F.col("e") + _frame(RULES["linger"] * f), F.col("s") + _frame(f))
    upto = F.least(want, nxt - gap)
    end = F.when(nxt.isNull(), want).when(nxt - upto < half, nxt - gap).otherwise(upto)
    out = rows.withColumn("e", F.greatest(end, F.col("s") + 1).cast("long")).withColumn("i", F.row_number().over(Window.partitionBy(KEY).orderBy("_p")).cast("long"))
    out = spread(out.select(KEY, "i", "s", "e", "text"), KEY, "i")
    return out.select(KEY, "i", "s", "e", (F.col("s") / F.lit(f)).alias("start"), (F.col("e") / F.lit(f)).alias("end"), wrap_two(per_line)("text").alias("text"))


def look_key(look: list[str]) -> Column:
    """32 bytes that tell looks apart."""
    return F.unhex(F.sha2(F.to_json(F.struct(*look)), 256))


def overlay_plan(frames: DataFrame, fps: float = 30.0, look: list[str] | None = None, tail: float = 0.2) -> DataFrame:
    """Frames as a run-length timeline of distinct looks: rec_id, segment, state (-1: nothing), frames. A look is the columns ``look``; states are numbered as they first appear. An empty tail ends it."""
    look = look or ["words", "active", "reveal"]
    w = Window.partitionBy(KEY).orderBy("_s", "_o")
    # sorted and compared by the place and a digest of the look, not by the look itself
    rows = frames.select(KEY, F.greatest(F.col("start"), F.lit(0)).alias("_s"), F.col("end"), F.col("ord").alias("_o"), look_key(look).alias("_key"))
    nxt = F.lead("_s").over(w)
    end = F.least(F.col("end"), F.coalesce(nxt, F.col("end")))
    end = F.when(end <= F.col("_s"), F.least(F.col("_s") + 0.04, F.coalesce(nxt, F.col("_s") + 0.04))).otherwise(end)
    rows = rows.withColumn("_a", half_up(F.col("_s") * fps)).withColumn("_b", half_up(end * fps))
    before = F.coalesce(F.max("_b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shown = rows.withColumn("_cursor", before).withColumn("_a", F.greatest("_a", "_cursor")).filter("_b > _a")
    # what is shown lies apart and in order, so that the one before ends where the gap begins, and the last one ends it all
    shown = shown.withColumn("_c", F.coalesce(F.lag("_b").over(w), F.lit(0))).withColumn("_last", F.lead("_b").over(w).isNull()).select(KEY, "_key", "_a", "_b", "_c", "_last")
    first = F.min("_a").over(Window.partitionBy(KEY, "_key"))
    shown = shown.withColumn("_first", first).withColumn("state", (F.dense_rank().over(Window.partitionBy(KEY).orderBy("_first")) - 1).cast("long"))
    part = lambda at, state, n: F.struct(at.alias("at"), state.alias("state"), n.cast("long").alias("n"))
    none = F.lit(-1).cast("long")
    each = F.array(part(F.col("_c"), none, F.col("_a") - F.col("_c")), part(F.col("_a"), F.col("state"), F.col("_b") - F.col("_a")), part(F.col("_b"), none, F.when(F.col("_last"), F.lit(max(1, _frame(tail * fps))))))
    all_ = shown.select(KEY, F.explode(each).alias("p")).select(KEY, "p.*").filter("n > 0")
    fresh = F.when(F.lag("state").over(Window.partitionBy(KEY).orderBy("at")) == F.col("state"), 0).otherwise(1)
    runs = all_.withColumn("_new", fresh).withColumn("segment", F.sum("_new").over(Window.partitionBy(KEY).orderBy("at")))
    return runs.groupBy(KEY, "segment", "state").agg(F.sum("n").cast("long").alias("frames")).select(KEY, F.col("segment").cast("long").alias("segment"), "state", "frames")


def carry_word_times(cues: DataFrame, words: DataFrame) -> DataFrame:
    """New texts of lines on the times of the lines' words, one for one where there are as many, else evenly: rec_id, cue, k, start, end, text, estimated. cues: rec_id, ord, start, end, text; words: rec_id, ord, start, end, text."""
    from chronoweft.operators import joins

    spans = cues.select(KEY, F.col("ord").alias("cue"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.filter(F.split(F.trim("text"), r"\s+"), lambda t: t != "").alias("_t"))
    said = words.filter(F.trim("text") != "").select(KEY, F.col("start").alias("_ws"), F.col("end").alias("_we"), F.col("ord").alias("_wo"))
    inside = joins.within(said, spans.select(KEY, "cue", "_s", "_e"), "_ws", (F.col("_s") - 0.01, F.col("_e") - 0.001), ("_s", "_e"), 0.01)
    per = inside.groupBy(KEY, "cue").agg(F.array_sort(F.collect_list(F.struct("_ws", "_wo", "_we"))).alias("_w"))
    both = spans.join(per, [KEY, "cue"], "left").filter(F.size("_t") > 0)
    even = (F.col("_e") - F.col("_s")) / F.size("_t")
    match = F.coalesce(F.size("_w") == F.size("_t"), F.lit(False))
    rows = both.withColumn("_match", match).withColumn("_step", even).select(KEY, "cue", "_s", "_step", "_w", "_match", F.posexplode("_t").alias("k", "text"))
    at = F.get("_w", F.col("k"))
    return rows.select(KEY, "cue", "k", F.when(F.col("_match"), at["_ws"]).otherwise(F.col("_s") + F.col("k") * F.col("_step")).alias("start"), F.when(F.col("_match"), at["_we"]).otherwise(F.col("_s") + (F.col("k") + 1) * F.col("_step")).alias("end"), "text", (~F.col("_match")).alias("estimated"))


def align_to_onsets(cues: DataFrame, samples: DataFrame, in_point: float = 0.0, window: float = 0.18) -> DataFrame:
    """Words of cues shared out by length, inner boundaries moved to the nearest onset within ``window`` and kept in order: rec_id, cue, k, start, end, text. samples: rec_id, t, db (media time)."""
    import numpy as np

    from chronoweft.operators.signal import onsets_of

    kind = cues.schema[KEY].dataType.simpleString()

    def run(c: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("t")
        t, db, out = s["t"].to_numpy(float), s["db"].to_numpy(float), []
        for cue in c.sort_values("ord").itertuples():
            ws = (cue.text or "").split()
            if not ws:
                continue
            own = (t >= cue.start + in_point - 1e-6) & (t <= cue.end + in_point + 1e-6)
            on = np.array(onsets_of(t[own], db[own])) - in_point
            weight = np.array([max(2, len(w)) for w in ws], float)
            edge = np.concatenate(([cue.start], cue.start + (cue.end - cue.start) * np.cumsum(weight)[:-1] / weight.sum(), [cue.end]))
            for k in range(1, len(ws)):
                if len(on) and np.abs(on - edge[k]).min() < window:
                    edge[k] = on[np.abs(on - edge[k]).argmin()]
            edge = np.maximum.accumulate(edge)
            out += [(cue.rec_id, cue.ord, k, edge[k], edge[k + 1], w) for k, w in enumerate(ws)]
        return pd.DataFrame(out, columns=["rec_id", "cue", "k", "start", "end", "text"])

    return cues.groupBy(KEY).cogroup(samples.groupBy(KEY)).applyInPandas(run, f"{KEY} {kind}, cue long, k long, start double, end double, text string")


def refine_words(words: DataFrame, samples: DataFrame, blend: float = 0.5, window: float = 0.25) -> DataFrame:
    """Word ends moved out of silence to the nearest edge of speech within ``window``, boundaries inside a run of words blended with a split by syllables, all in order: rec_id, ord, start, end, text."""
    import numpy as np

    from chronoweft.operators.signal import speech_runs_of

    kind = words.schema[KEY].dataType.simpleString()

    def syllable_count(w: str) -> int:
        import re

        low = re.sub("[^a-z]", "", (w or "").lower())
        if len(low) <= 3:
            return 1
        low = re.sub("^y", "", re.sub("(?:[^laeiouy]es|[^laeiouy]e|ed)$", "", low))
        return max(1, len(re.findall("[aeiouy]{1,2}", low)))

    def run(w: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        ws = w.sort_values(["start", "end", "ord"])[["rec_id", "ord", "start", "end", "text"]].to_dict("records")
        runs = speech_runs_of(*s.sort_values("t")[["t", "db"]].to_numpy(float).T) if len(s) else []
        first = np.array([r[0] for r in runs])

        def snapped(t: float, prefer: int) -> float:
            k = int(np.searchsorted(first, t + 0.01, "right")) - 1
            if k >= 0 and runs[k][0] - 0.01 <= t <= runs[k][1] + 0.01:
                return t
            k = int(np.searchsorted(first, t, "right")) - 1
            near = [r[side] for r in runs[max(0, k - 1) : k + 2] for side in (prefer, 1 - prefer)]
            best = min(near, key=lambda e: abs(e - t), default=t)
            return best if abs(best - t) <= window else t

        if runs:
            for x in ws:
                x["start"], x["end"] = snapped(x["start"], 0), snapped(x["end"], 1)
        g = 0
        while g < len(ws):
            h = g
            while h + 1 < len(ws) and ws[h + 1]["start"] - ws[h]["end"] < 0.12:
                h += 1
            span = ws[h]["end"] - ws[g]["start"]
            if h > g and span > 1e-3:
                weight = np.cumsum([syllable_count(x["text"]) for x in ws[g : h + 1]])
                start, prev = ws[g]["start"], ws[g]["start"]
                for m in range(g, h):
                    ws[m]["end"] = ws[m + 1]["start"] = max(ws[m]["end"] * (1 - blend) + (start + span * weight[m - g] / weight[-1]) * blend, prev + 0.02)
                    prev = ws[m]["end"]
            g = h + 1
        for k, x in enumerate(ws):
            if k and x["start"] < ws[k - 1]["end"]:
                x["start"] = ws[k - 1]["end"]
            if x["end"] <= x["start"]:
                x["end"] = x["start"] + 0.04
        return pd.DataFrame(ws, columns=["rec_id", "ord", "start", "end", "text"])

    return words.groupBy(KEY).cogroup(samples.groupBy(KEY)).applyInPandas(run, f"{KEY} {kind}, ord long, start double, end double, text string")


def merge_style(preset: str, own: str):
    """Column: a style map with the non-empty entries of another laid over it."""
    return F.map_concat(F.coalesce(F.map_filter(preset, lambda k, v: ~F.map_contains_key(F.coalesce(F.map_filter(own, lambda a, b: F.coalesce(b, F.lit("")) != ""), F.create_map().cast("map<string,string>")), k)), F.create_map().cast("map<string,string>")), F.coalesce(F.map_filter(own, lambda k, v: F.coalesce(v, F.lit("")) != ""), F.create_map().cast("map<string,string>")))
