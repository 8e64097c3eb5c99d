"""Replies of language models: JSON in prose, cut lists, highlights and rankings, checked against the words they name."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweft.functions import words as lists
from chronoweft.functions.text import category as cut_kind
from chronoweft.operators.highlights import fit_clip
from chronoweft.operators.takes import _words
from chronoweft.sources.folders import settle

KEY = "rec_id"
_FROM = ("from", "start", "start_index", "startIndex", "start_idx", "from_index", "fromIndex", "begin", "first")
_TO = ("to", "end", "end_index", "endIndex", "end_idx", "to_index", "toIndex", "stop", "last")
_LIST = re.compile("^(cuts|edits|segments|removals|remove|deletions|deletes|ranges|spans|items|results|cut_list|cutlist)$", re.IGNORECASE)


def closing(text: str, at: int) -> int:
    """Where the bracket at a place closes; -1 if it doesn't, or another closes first. Strings are passed over."""
    stack: list[str] = []
    for m in re.compile(r'"(?:[^"\\]|\\.)*"|["{}\[\]]', re.DOTALL).finditer(text, at):
        t = m.group()
        if t == '"':
            return -1
        if t in "{[":
            stack.append("}" if t == "{" else "]")
        elif t in "}]":
            if not stack or stack.pop() != t:
                return -1
            if not stack:
                return m.start()
    return -1


def without_trailing_commas(text: str) -> str:
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", text, flags=re.DOTALL)


def parse(text: str):
    """JSON, with trailing commas and curly quotes mended; None if it is none."""
    for t in (text, without_trailing_commas(text), without_trailing_commas(re.sub("[“”]", '"', text))):
        try:
            return json.loads(t)
        except ValueError:
            continue
    return None


def first_object(text: str | None) -> dict | None:
    """The first JSON object in prose; at most 200 brackets are tried."""
    for m in list(re.finditer(r"\{", text or ""))[:200]:
        end = closing(text, m.start())
        found = parse(text[m.start() : end + 1]) if end >= 0 else None
        if isinstance(found, dict):
            return found
    return None


def index_of(value) -> int | None:
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return int(value) if math.isfinite(value) and value == int(value) else None
    if isinstance(value, list):
        return index_of(value[0]) if len(value) == 1 else None
    m = re.match(r"[^\d-]*(-?\d+)(?![.\d])", str(value))
    return int(m[1]) if m else None


def span(item) -> tuple[int | None, int | None] | None:
    """First and last index that an item of a reply names; None if it names none."""
    if not isinstance(item, dict):
        return None
    a, b = (next((item[k] for k in keys if item.get(k) is not None), None) for keys in (_FROM, _TO))
    both = item.get("range") or item.get("span") or item.get("indices")
    if (a is None or b is None) and isinstance(both, list) and both:
        a, b = both[0], both[-1]
    if a is None and b is None:
        a = b = item.get("index", item.get("idx"))
    return None if a is None or b is None else (index_of(a), index_of(b))


def cut_list(value, depth: int = 0) -> list | None:
    """The list of cuts in a document, up to two levels down."""
    if isinstance(value, list):
        return value if not value or any(span(x) for x in value) else None
    if not isinstance(value, dict):
        return None
    named = next((v for k, v in value.items() if _LIST.match(k) and isinstance(v, list)), None)
    if named is not None or depth >= 2:
        return named
    return next((x for x in (cut_list(v, depth + 1) for v in value.values() if isinstance(v, (dict, list))) if x is not None), None)


def document(text: str) -> list | None:
    at, tries = 0, 0
    while tries < 200 and (m := re.compile(r"[{\[]").search(text, at)):
        tries += 1
        end = closing(text, m.start())
        found = parse(text[m.start() : end + 1]) if end >= 0 else None
        if found is not None and (got := cut_list(found)) is not None:
            return got
        at = end + 1 if found is not None else m.end()
    return None


def cuts(text: str | None) -> list:
    """Cuts of a reply; of one that breaks off, those that are whole."""
    if not text:
        return []
    found = document(text)
    if found is not None:
        return found
    return [v for v in (parse(m) for m in re.findall(r"\{[^{}]*\}", text)) if span(v)]


def truncated(text: str | None) -> bool:
    m = re.search(r"[\[{]", text or "")
    return bool(m) and document(text) is None and closing(text, m.start()) < 0


def category(name) -> str:
    key = re.sub(r"[\s\-]+", "_", str(name or "").lower().strip())
    return next((k for k, names in lists.CATEGORIES.items() if key in names.split()), "cut")


#: Characters that an edge of a word may have, and grammar that keeps a filler in its sentence.
EDGE = "0-9A-Za-z_\u0900-\u0963\u0966-\u097f"
KEEPS_LIKE = r"^([0-9]|one|two|three|four|five|ten|a|about|half)"
_edge = lambda t: re.sub(f"^[^{EDGE}]+|[^{EDGE}]+$", "", (t or "").lower())


def _anchor(words: list[dict], said: list[str], at: int) -> tuple[int, int] | None:
    """Where the words said stand, within six of where the reply says; words without letters are passed over."""
    for off in range(7):
        for f in dict.fromkeys((at + off, at - off)):
            if not 0 <= f < len(words) or not _edge(words[f]["text"]):
                continue
            k, ok = f, True
            for q, w in enumerate(said):
                while q and k < len(words) and not _edge(words[k]["text"]):
                    k += 1
                if k >= len(words) or _edge(words[k]["text"]) != w:
                    ok = False
                    break
                k += q < len(said) - 1
            if ok:
                return f, k
    return None


_first = lambda item, keys: next((item[k] for k in keys if item.get(k) is not None), None)
_KIND = ("category", "type", "label")


def confidence(item: dict) -> float:
    """How sure a cut is, 1 where nothing is said; percentages count as such."""
    value = item.get("confidence")
    if isinstance(value, str):
        m = re.match(r"\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", value)
        value = float(m[1]) if m else None
    sure = float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and not math.isnan(value) else 1.0
    return sure / 100 if 1 < sure <= 100 else sure


def _reason(item: dict, label: str) -> str:
    return (str(item["reason"]) if item.get("reason") else label)[:80]


def cleanup(text: str | None, words: list[dict], least: float = 0.0, kinds: tuple[str, ...] | None = None) -> list[dict]:
    """Cuts that a reply names, where its words really are: start, end, text, reason, label, confidence, from_idx, to_idx, needs_review. Very long cuts are to be reviewed."""
    out, n = [], len(words)
    for c in cuts(text):
        found = span(c)
        if not found or None in found:
            continue
        a, b = found
        if a < 0 or a >= n or b < a or b > n + 1:
            continue
        b = min(b, n - 1)
        if isinstance(c.get("words"), str) and c["words"].strip():
            spoken = [w for w in map(_edge, c["words"].split()) if w]
            place = _anchor(words, spoken, a) if spoken else None
            if place is None:
                continue
            a, b = place
        said, after = " ".join(_edge(w["text"]) for w in words[a : b + 1]), _edge(words[b + 1]["text"]) if b + 1 < n else ""
        if (said == "you know" and after == "what") or (said == "like" and re.match(KEEPS_LIKE, after)):
            continue
        sure, label = confidence(c), category(_first(c, _KIND))
        start, end = words[a]["start"], words[b]["end"]
        if sure >= least and end > start and (kinds is None or label in kinds):
            out.append({"start": start, "end": end, "text": " ".join(w["text"].strip() for w in words[a : b + 1]), "reason": _reason(c, label), "label": label, "confidence": sure, "from_idx": a, "to_idx": b, "needs_review": end - start > 45 or (n >= 40 and b - a + 1 > 0.25 * n)})
    return sorted(out, key=lambda c: c["start"])


def line_index(value, segs: list[dict], last: bool) -> int | None:
    """A line's number, or the line that plays at a clock time."""
    m = re.fullmatch(r"\s*(?:(\d+):)?(\d{1,3}):(\d{2})(?:\.\d+)?\s*", value) if isinstance(value, str) else None
    if not m:
        return index_of(value)
    t = int(m[1] or 0) * 3600 + int(m[2]) * 60 + int(m[3])
    k = max((k for k, s in enumerate(segs) if s["start"] <= t + 1e-6), default=0)
    return k - 1 if last and k > 0 and abs(segs[k]["start"] - t) < 0.5 else k


def highlights(text: str | None, segs: list[dict], least: float = 6, most: float = 120) -> list[dict]:
    """Clips of a reply, fitted to whole sentences, best first: start, end, title, hook, score, text."""
    out = []
    for c in (first_object(text) or {}).get("clips") or []:
        if not isinstance(c, dict):
            continue
        a, b = line_index(c.get("from"), segs, False), line_index(c.get("to"), segs, True)
        if a is None or b is None or not segs:
            continue
        fit = fit_clip(segs, max(0, a), min(len(segs) - 1, b), least, most)
        if fit:
            f, t = fit
            score = c.get("score")
            score = max(0.0, min(100.0, float(score))) if isinstance(score, (int, float)) else 50.0
            out.append({"start": segs[f]["start"], "end": segs[t]["end"], "title": str(c.get("title") or "Clip")[:60], "hook": str(c.get("hook") or "")[:120], "score": score, "text": " ".join(s["text"].strip() for s in segs[f : t + 1])})
    return sorted(out, key=lambda c: -c["score"])


def ranking(text: str | None, n: int) -> list[tuple[int, float]]:
    """(index, score) of a reply that ranks n candidates; the first of equal indexes counts."""
    found = first_object(text) or {}
    ranked = found.get("ranked") or found.get("ranking") or found.get("order") or []
    out: dict[int, float] = {}
    for k, x in enumerate(ranked if isinstance(ranked, list) else []):
        i = index_of(x.get("i", x.get("index")) if isinstance(x, dict) else x)
        if i is None or not 0 <= i < n or i in out:
            continue
        score = x.get("score") if isinstance(x, dict) else math.floor(100 * (1 - k / len(ranked)) + 0.5)
        out[i] = max(0.0, min(100.0, float(score) if isinstance(score, (int, float)) else 0.0))
    return list(out.items())


# ---- on tables: one reply for each recording (rec_id, reply) ------------------------------

reply_json = F.pandas_udf(lambda s: s.map(lambda t: json.dumps(first_object(t)) if first_object(t) is not None else None), T.StringType())
reply_truncated = F.pandas_udf(lambda s: s.map(truncated), T.BooleanType())


def _per_reply(rows: DataFrame, replies: DataFrame, kernel, schema: str) -> DataFrame:
    kind = rows.schema[KEY].dataType.simpleString()
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(w: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame([[c[n] for n in names] for c in kernel(r["reply"].iloc[0] if len(r) else None, _words(w) if len(w) else [])], columns=names)
        out.insert(0, KEY, (w if len(w) else r)[KEY].iloc[0])
        return out

    return rows.groupBy(KEY).cogroup(replies.groupBy(KEY)).applyInPandas(run, f"{KEY} {kind}, {schema}")


#: The schema of a reply that needs no repair: only these fields, of these kinds, in a list named cuts.
_FIELD = r"(category: STRING|confidence: (BIGINT|DECIMAL\(\d+,\d+\)|DOUBLE|FLOAT)|from: BIGINT|label: STRING|reason: STRING|to: BIGINT|type: STRING|words: STRING)"
PLAIN = rf"^OBJECT<cuts: ARRAY<(VOID|OBJECT<{_FIELD}(, {_FIELD})*>)>>$"
_CUT = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("from", T.LongType()), ("to", T.LongType()), ("words", T.StringType()), ("category", T.StringType()), ("reason", T.StringType()), ("confidence", T.DoubleType()))]))


def _mended(text: str | None) -> list[dict] | None:
    """The cuts of a reply that is not plain JSON, in plain form."""
    if text is None:
        return None
    out = []
    for c in cuts(text):
        found = span(c)
        if found and None not in found and all(abs(k) < 1 << 62 for k in found):
            kind, said = _first(c, _KIND), c.get("words")
            out.append({"from": found[0], "to": found[1], "words": said if isinstance(said, str) else None, "category": None if kind is None else str(kind), "reason": str(c["reason"]) if c.get("reason") else None, "confidence": confidence(c)})
    return out


_mend = F.pandas_udf(lambda s: s.map(_mended), _CUT)


def cut_rows(replies: DataFrame) -> DataFrame:
    """Cuts that replies name: rec_id, reply_no, cut_no, from, to, words, category, reason, confidence. replies: rec_id, reply; the same reply of a recording counts once.

    A reply that is JSON as asked for is read by Spark's own parser; the others, with prose around, trailing
    commas, other names or a broken end, go through the repair, and only they do.
    """
    doc = F.try_parse_json("reply")
    plain = F.coalesce(F.schema_of_variant(doc).rlike(PLAIN), F.lit(False))
    rows = replies.select(KEY, "reply").distinct().withColumn("_plain", plain)
    rows = rows.withColumn("_fast", F.when(F.col("_plain"), F.try_variant_get(doc, "$.cuts", "array<struct<from:bigint,to:bigint,words:string,category:string,type:string,label:string,reason:string,confidence:double>>")))
    rows = rows.withColumn("_slow", _mend(F.when(~F.col("_plain"), F.col("reply"))))
    kind = lambda c: F.coalesce(c["category"], c["type"], c["label"])
    sure = lambda c: F.when((c["confidence"] > 1) & (c["confidence"] <= 100), c["confidence"] / 100).otherwise(F.coalesce(c["confidence"], F.lit(1.0)))
    fast = F.transform("_fast", lambda c: F.struct(c["from"].alias("from"), c["to"].alias("to"), c["words"].alias("words"), kind(c).alias("category"), F.when(c["reason"] != "", c["reason"]).alias("reason"), sure(c).alias("confidence")))
    found = rows.select(KEY, F.xxhash64("reply").alias("reply_no"), F.posexplode(F.coalesce(fast, F.col("_slow"))).alias("cut_no", "c"))
    return found.select(KEY, "reply_no", "cut_no", "c.*").filter(F.col("from").isNotNull() & F.col("to").isNotNull())


def _edged(text) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"^[^{EDGE}]+|[^{EDGE}]+$", "")


_trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")


def cleanup_cuts(words: DataFrame, replies: DataFrame, least: float = 0.0, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Cuts that replies name, where their words really are: rec_id, start, end, text, reason, label, confidence, from_idx, to_idx, needs_review.

    words: rec_id, ord, start, end, text; replies: rec_id, reply.  Indexes count a recording's words by start, end
    and ord.  A cut that quotes its words moves to the nearest place within six words where they stand (the later one
    first), words without letters passed over, or is dropped; so are cuts out of range and fillers that grammar
    keeps.  Words and cuts meet by their numbers: no recording is gathered.
    """
    cut = [KEY, "reply_no", "cut_no"]
    order = Window.partitionBy(KEY).orderBy("start", "end", "ord")
    w = words.select(KEY, "ord", "start", "end", F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.row_number().over(order).cast("long") - 1).withColumn("e", _edged(F.col("text")))
    # read four times below, and the cuts twice
    w = settle(w.withColumn("nth", F.sum((F.col("e") != "").cast("long")).over(order)), "words")
    sizes = w.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    c = cut_rows(replies).join(sizes, KEY).filter("from >= 0 and from < n and to >= from and to <= n + 1").withColumn("to", F.expr("least(to, n - 1)"))
    quoted = F.coalesce(_trimmed(F.col("words")) != "", F.lit(False))
    c = settle(c.withColumn("_quoted", quoted).withColumn("said", F.filter(F.transform(F.split(F.coalesce("words", F.lit("")), r"\s+"), _edged), lambda x: x != "")), "cuts")

    # the first quoted word near its index, then the others after it
    near = c.filter("_quoted and size(said) > 0").select(*cut, "said", F.explode(F.sequence(F.lit(-6), F.lit(6))).alias("off"), "from").withColumn("k", F.col("from") + F.col("off"))
    met = near.join(w.select(KEY, "k", "e", "nth"), [KEY, "k"]).filter(F.col("e") == F.get("said", F.lit(0))).select(*cut, "off", "said", F.col("k").alias("at"), F.col("nth").alias("first"))
    after = met.select(*cut, "off", "at", F.size("said").alias("size"), F.posexplode("said").alias("q", "x"), "first").withColumn("nth", F.col("first") + F.col("q"))
    spoken = w.filter("e <> ''").select(KEY, "nth", F.col("e").alias("y"), F.col("k").alias("last"))
    whole = after.join(spoken, [KEY, "nth"]).filter("x = y").groupBy(*cut, "off", "at", "size").agg(F.count(F.lit(1)).alias("n_met"), F.max("last").alias("last")).filter("n_met = size")
    place = whole.groupBy(*cut).agg(F.min(F.struct(F.abs("off").alias("far"), (-F.col("off")).alias("side"), "at", "last")).alias("p"))
    c = c.join(place, cut, "left").filter("not _quoted or p is not null").withColumn("a", F.coalesce("p.at", "from")).withColumn("b", F.coalesce("p.last", "to"))
    c = settle(c.drop("p", "said", "words", "from", "to", "_quoted"), "placed")

    # the words of each cut and the one behind it
    held = c.select(*cut, "a", "b", F.explode(F.expr("sequence(a, b + 1)")).alias("k")).join(w.drop("ord", "nth"), [KEY, "k"])
    inside = F.when(F.col("k") <= F.col("b"), F.struct("k", "text", "e", "start", "end"))
    held = held.groupBy(*cut).agg(F.array_sort(F.collect_list(inside)).alias("ws"), F.max(F.when(F.col("k") > F.col("b"), F.col("e"))).alias("next"))
    row = c.join(held, cut).withColumn("start", F.get("ws", F.lit(0))["start"]).withColumn("end", F.element_at("ws", -1)["end"]).withColumn("label", cut_kind(F.coalesce("category", F.lit(""))))
    said, following = F.array_join(F.transform("ws", lambda x: x["e"]), " "), F.coalesce("next", F.lit(""))
    idiom = ((said == "you know") & (following == "what")) | ((said == "like") & following.rlike(KEEPS_LIKE))
    text = F.array_join(F.transform("ws", lambda x: _trimmed(x["text"])), " ")
    long = (F.col("end") - F.col("start") > 45) | ((F.col("n") >= 40) & (F.col("b") - F.col("a") + 1 > 0.25 * F.col("n")))
    row = row.filter(~idiom & (F.col("confidence") >= least) & (F.col("end") > F.col("start")))
    if kinds is not None:
        row = row.filter(F.col("label").isin(*kinds))
    reason = F.substring(F.coalesce("reason", "label"), 1, 80)
    return row.select(KEY, "start", "end", text.alias("text"), reason.alias("reason"), "label", "confidence", F.col("a").alias("from_idx"), F.col("b").alias("to_idx"), long.alias("needs_review"))


def highlight_clips(segments: DataFrame, replies: DataFrame, least: float = 6, most: float = 120) -> DataFrame:
    return _per_reply(segments, replies, lambda t, s: highlights(t, s, least, most), "start double, end double, title string, hook string, score double, text string")
