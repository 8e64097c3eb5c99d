"""Repeated takes as joins of phrases.

Words become phrases, numbered within their recording, each with what the rules ask of it.  Pairs of phrases that
lie near each other meet by their numbers and are sifted by columns; only what is left is compared word by word.
Likeness links phrases to groups, connected components over all recordings at once.  Every other rule looks at a
phrase and its neighbours, or at what is said in the next minute and a half: for that, phrases are dealt in chunks
with those that follow, so that a recording of any length is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweft.functions.text import sound, spoken_key
from chronoweft.operators import joins, takes
from chronoweft.operators.components import components
from chronoweft.operators.signal import records
from chronoweft.operators.takes import AGREE, BACK, EMPH, FIRST, FILL, GLUE, OPEN, SECOND, SENTENCE, STRONG, WEAK, Phrase
from chronoweft.sources.folders import settle, spread

KEY = "rec_id"
#: Phrases of a recording whose later retelling is looked for in one task, and phrases looked back at in one step.
CHUNK, BACK_STEP = 256, 16
#: What the rules ask of a phrase.
FEATURES = {
    "start": "double", "end": "double", "n_tokens": "int", "said": "array<string>", "sounds": "array<string>", "body": "array<string>", "open_key": "array<string>", "open_all": "array<string>", "speaker": "string",
    "asks": "boolean", "states": "boolean", "you": "boolean", "me": "boolean", "question": "boolean", "nod": "boolean", "agrees": "boolean", "negative": "boolean", "conf": "double", "ended": "boolean", "open_end": "boolean",
    "aside": "boolean", "inner": "array<struct<start: double, end: double, text: string>>", "text": "string", "head_sure": "boolean", "tail_sure": "boolean",
}


_INNER = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64()), ("text", pa.string())]))
_KINDS = {"double": pa.float64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_ARROW = [(n, _KINDS.get(t, _INNER)) for n, t in FEATURES.items()]


@dataclass(frozen=True)
class Rules:
    """``keep``: which take stays, the last, the last complete one (best) or the surest (confident). ``people``: one, many or None."""

    sim: float = 0.6
    min_run: int = 3
    keep: str = "last"
    people: str | None = None
    window: int = 16
    max_gap: float = 60.0
    contain: float = 0.85
    pause: float = 0.45
    aside_words: int = 8
    start_words: int = 6
    far: float = 90.0

    @property
    def least(self) -> int:
        return max(2, self.min_run)


# ---- phrases -------------------------------------------------------------------------------


def _inner(words: list[dict], rules: Rules) -> list[dict]:
    """Words of a phrase said twice in a row: the first saying of each."""
    t = [(x, k) for x, k in ((spoken_key(w["text"]), k) for k, w in enumerate(words)) if x and x not in FILL]
    keys = [x for x, _ in t]
    out, at = [], 0
    while at < len(t):
        hit = 0
        for n in range(min(6, (len(t) - at - 1) // 2), max(2, rules.least - 1) - 1, -1):
            if keys[at] != keys[at + n]:
                continue
            unit = keys[at : at + n]
            if unit != keys[at + n : at + 2 * n] or len(set(unit)) < 2 or all(x in EMPH or x in AGREE or x in BACK for x in unit):
                continue
            if not takes.is_remark(unit, words[t[at + n - 1][1]]["text"], words[t[at + 2 * n - 1][1]]["text"]):
                hit = n
                break
        if not hit:
            at += 1
            continue
        first, again = t[at][1], t[at + hit][1]
        if words[again]["start"] > words[first]["start"]:
            out.append({"start": words[first]["start"], "end": words[again]["start"], "text": " ".join(w["text"] for w in words[first:again])})
        at += hit
    return out


def _features(words: list[dict], rules: Rules) -> dict:
    p = Phrase(words)
    opened = takes.opening(p.said, 3)
    speaker = None if rules.people == "one" else p.speaker
    strong, weak = sum(x in STRONG for x in p.tokens), sum(x in WEAK and x not in STRONG for x in p.tokens)
    real = lambda w, side: not w.get("estimated") or bool(w.get(side))
    guessed = any(w.get("estimated") for w in words)
    return {
        "start": p.start, "end": p.end, "n_tokens": len(p.tokens), "said": p.said, "sounds": [sound(x) for x in p.said], "body": [sound(x) for x in takes.body(p.said)],
        "open_key": [sound(x) for x in opened if x not in GLUE and x not in FIRST and x not in SECOND], "open_all": [sound(x) for x in opened],
        "speaker": speaker, "asks": p.asks, "states": p.states, "you": p.you, "me": p.me, "question": p.question, "nod": p.nod, "agrees": p.agrees, "negative": p.negative, "conf": p.confidence,
        "ended": bool(SENTENCE.search(p.last)), "open_end": bool(p.said) and p.said[-1] in OPEN,
        "aside": 0 < len(p.tokens) <= rules.aside_words and bool(strong or takes._has_chat(p.tokens)) and (strong + weak) / len(p.tokens) >= 0.75,
        "inner": [] if guessed or (rules.people == "many" and speaker is None) else _inner(words, rules),
        "text": p.text, "head_sure": real(words[0], "cue_start"), "tail_sure": real(words[-1], "cue_end"),
    }


def phrases(words: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """Words cut at pauses, sentence ends, changes of speaker and turns to talk about the take: rec_id, p (from 0), start, end, text and what the rules ask of a phrase.

    Recordings with fewer than two short phrases' words have none.  Null texts are empty words; times must not be null.
    """
    have = [c for c in ("speaker", "conf", "estimated", "cue_start", "cue_end") if c in words.columns]
    rows = words.select(KEY, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "ord", F.coalesce("text", F.lit("")).alias("text"), *have)
    order = Window.partitionBy(KEY).orderBy("start", "end", "ord")
    before = lambda c: F.lag(c).over(order)
    fresh = before("start").isNull() | (F.col("start") - before("end") > rules.pause) | before("text").rlike(SENTENCE.pattern)
    if "speaker" in have:
        fresh = fresh | F.coalesce((before("speaker") != "") & (F.col("speaker") != "") & (before("speaker") != F.col("speaker")), F.lit(False))
    rows = rows.withColumn("r", F.sum(fresh.cast("int")).over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(KEY))).filter(F.col("_n") >= 2 * rules.least)
    held = spread(rows, KEY, "r").groupBy(KEY, "r").agg(F.array_sort(F.collect_list(F.struct("start", "end", "ord", "text", *have))).alias("ws"))

    schema = f"{KEY} {words.schema[KEY].dataType.simpleString()}, r long, part int, {', '.join(f'{n} {t}' for n, t in FEATURES.items())}"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[dict] = []
            for rec, r, ws in zip(part.column(KEY).to_pylist(), part.column("r").to_pylist(), records(part.column("ws")), strict=True):
                for k, piece in enumerate(takes._split_asides(ws, rules.aside_words)):
                    out.append({KEY: rec, "r": r, "part": k} | _features(piece, rules))
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(KEY, part.schema.field(KEY).type), ("r", pa.int64()), ("part", pa.int32()), *_ARROW]))

    found = held.mapInArrow(run, schema)
    each = Window.partitionBy(KEY).orderBy("r", "part")
    found = found.withColumn("p", F.row_number().over(each).cast("long") - 1).withColumn("n_said", F.size("said").cast("long"))
    found = found.withColumn("next_start", F.lead("start").over(each)).withColumn("next_sure", F.lead("head_sure").over(each)).withColumn("cum", F.coalesce(F.sum("n_said").over(each.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    return found.drop("r", "part")


# ---- the rules on pairs, as columns ----------------------------------------------------------


def _prefix(a: Column, b: Column, share: float = 0.7) -> Column:
    """Is a nearly how b, the longer one, starts."""
    n = F.size(a)
    alike = F.size(F.filter(F.zip_with(a, F.slice(b, 1, F.greatest(n, F.lit(1))), lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    return (n > 0) & (n < F.size(b)) & (alike / F.greatest(n, F.lit(1)) >= share)


def _carries(a: Column, b: Column) -> Column:
    return _prefix(a, b) & (F.get(b, F.size(a) - 1) == F.element_at(a, -1))


def _a(name: str) -> Column:
    return F.col(f"a_{name}")


def _b(name: str) -> Column:
    return F.col(f"b_{name}")


_one_speaker = lambda: _a("speaker").isNull() | _b("speaker").isNull() | (_a("speaker") == _b("speaker"))
_unknown = lambda: _a("speaker").isNull() | _b("speaker").isNull()


def _strict(rules: Rules) -> Column:
    return _unknown() if rules.people == "many" else F.lit(False)


def _same_line(rules: Rules) -> Column:
    """Can b be a said again by one person."""
    never = (_a("asks") & _b("states")) | (_a("states") & _b("asks")) | (_a("you") & ~_b("you") & _b("me")) | (_b("you") & ~_a("you") & _a("me")) | (_a("negative") != _b("negative"))
    never = never | (_a("question") & ~_b("question")) | (_b("question") & ~_a("question") & (_a("n_said") >= _b("n_said")))
    if rules.people != "one":
        reply = _unknown() & _b("agrees") & ~_a("agrees")
        never = never | (reply & (F.lit(True) if rules.people == "many" else _a("states") | ~_carries(_a("body"), _b("body"))))
    return _one_speaker() & ~never


def _sides(p: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    return tuple(p.select(KEY, F.col("p").alias(side), *[F.col(n).alias(f"{side}_{n}") for n in names]) for side in ("a", "b"))


_LINE = ("speaker", "asks", "states", "you", "me", "question", "negative", "agrees", "n_said", "sounds", "body", "start", "end", "nod", "n_tokens", "ended")


@F.pandas_udf(T.LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([takes.common(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int64")


def links(p: DataFrame, rules: Rules) -> DataFrame:
    """Pairs of phrases that are takes of one line: rec_id, a, b."""
    # both open with one sound, which is no mere joining word in a, or with the same two: they meet by that, in blocks of places
    two = lambda: F.when(F.size("open_all") >= 2, F.array(F.concat_ws(" ", F.lit("="), F.get("open_all", F.lit(0)), F.get("open_all", F.lit(1))))).otherwise(F.array().cast("array<string>"))
    block = F.expr(f"p div {rules.window}")
    fit = p.filter(~F.col("nod") & (F.col("n_said") > 0))
    first = fit.filter(F.col("n_tokens") >= rules.least).select(KEY, F.col("p").alias("a"), F.array(block, block + 1).alias("blocks"), F.explode(F.array_distinct(F.concat("open_key", two()))).alias("key")).select(KEY, "a", "key", F.explode("blocks").alias("block"))
    second = fit.filter(F.col("n_tokens") >= min(rules.least, 2)).select(KEY, F.col("p").alias("b"), block.alias("block"), F.explode(F.array_distinct(F.concat("open_all", two()))).alias("key"))
    met = first.join(second, [KEY, "block", "key"]).filter((F.col("a") < F.col("b")) & (F.col("b") <= F.col("a") + rules.window)).select(KEY, "a", "b").distinct()
    left, right = _sides(p, _LINE)
    near = met.join(left, [KEY, "a"]).join(right, [KEY, "b"]).filter((_b("start") - _a("end") <= rules.max_gap) & _same_line(rules))
    near = near.withColumn("strict", _strict(rules)).withColumn("apart", F.col("b") - F.col("a"))
    # words are compared for what is left
    words = p.select(KEY, "p", "said")
    near = near.join(words.withColumnsRenamed({"p": "a", "said": "a_said"}), [KEY, "a"]).join(words.withColumnsRenamed({"p": "b", "said": "b_said"}), [KEY, "b"])
    n = _common(F.col("a_said"), F.col("b_said"))
    near = near.withColumn("n", n).withColumn("s", F.col("n") / F.greatest("a_n_said", "b_n_said"))
    least = F.when(F.col("strict"), F.lit(max(rules.sim, 0.8))).otherwise(F.lit(rules.sim))
    close = (F.col("s") >= least) & ((F.col("s") >= 0.75) | (_b("start") - _a("end") <= 20))
    inside = ~F.col("strict") & (F.col("n") / F.least("a_n_said", "b_n_said") >= rules.contain)
    grown = (F.col("apart") <= 4) & (_a("n_said") <= _b("n_said")) & (~_a("states") | _prefix(_a("sounds"), _b("sounds")))
    broken = (F.col("apart") == 1) & (_b("n_said") < _a("n_said")) & ~_b("ended") & _prefix(_b("sounds"), _a("sounds"))
    return near.filter(close | (inside & (grown | broken))).select(KEY, "a", "b")


def _grouped(p: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Members of the groups (rec_id, p) and those that go (rec_id, p, why, rank)."""
    member = components(links(p, rules)).join(p.select(KEY, "p", "conf", "n_said", "states", "asks", "open_end", "body", "said"), [KEY, "p"])
    last = member.groupBy(KEY, "g").agg(F.max("p").alias("last"), F.max("n_said").alias("most"), F.max_by("p", F.when(F.col("conf").isNotNull(), F.struct("conf", -F.col("p")))).alias("surest"))
    if rules.keep == "confident":
        stays = last.select(KEY, "g", F.coalesce("surest", "last").alias("stays"))
    elif rules.keep == "best":
        m = member.join(last, [KEY, "g"])
        full = m.filter("n_said = most").groupBy(KEY, "g").agg(F.min("p").alias("full"))
        f = p.select(KEY, F.col("p").alias("full"), F.col("body").alias("f_body"), F.col("said").alias("f_said"))
        m = m.join(full, [KEY, "g"]).join(f, [KEY, "full"])
        final = F.element_at("said", -1)
        ends = (F.col("p") != F.col("full")) & (F.col("states") | F.col("asks")) & (F.col("n_said") > 0) & ~F.col("open_end") & ~_carries(F.col("body"), F.col("f_body")) & F.coalesce(F.array_contains("f_said", final), F.lit(False))
        whole = (F.col("most") == 0) | (F.col("n_said") >= 0.75 * F.col("most")) | ((F.col("n_said") >= 0.5 * F.col("most")) & ends)
        good = whole & ~((F.col("p") != F.col("full")) & F.col("open_end"))
        stays = m.groupBy(KEY, "g").agg(F.coalesce(F.max(F.when(good, F.col("p"))), F.max("p")).alias("stays"))
    else:
        stays = last.select(KEY, "g", F.col("last").alias("stays"))
    member = settle(member.join(stays, [KEY, "g"]).select(KEY, "p", (F.col("p") == F.col("stays")).alias("stays")), "groups")
    return member.select(KEY, "p"), member.filter("not stays").select(KEY, "p", F.lit("repeated take").alias("why"), F.lit(0).alias("rank"))


def _false_starts(p: DataFrame, gone: DataFrame, rules: Rules) -> DataFrame:
    left, right = _sides(p, _LINE)
    small = left.filter((_a("n_said") > 0) & (_a("n_said") <= rules.start_words) & ~_a("nod")).join(gone.select(KEY, F.col("p").alias("a")), [KEY, "a"], "left_anti")
    pair = small.withColumn("b", F.col("a") + 1).join(right, [KEY, "b"]).filter(_same_line(rules) & ~(_a("states") & (_strict(rules) | (_a("n_said") == 1))) & _prefix(_a("sounds"), _b("sounds")))
    return pair.select(KEY, F.col("a").alias("p"), F.lit("false start").alias("why"), F.lit(1).alias("rank"))


def _retold(rows: list[dict], rules: dict) -> Iterator[tuple[int, list[str], int | None]]:
    """Own phrases of a chunk (in order, with those that follow) that a later stretch says again: number, the stretch, and the small phrase behind that goes too.

    Which of a phrase's words a later one says is one whole number, with a bit for each, found once for the two.
    """
    n = len(rows)
    for i, a in enumerate(rows):
        if not a["own"] or a["gone"] or a["nod"] or len(a["said"]) < 5:
            continue
        size, need = len(a["said"]), 0.82 if a["ended"] else 0.75
        bits: dict[str, int] = {}
        for q, x in enumerate(a["sounds"]):
            bits[x] = bits.get(x, 0) | 1 << q
        met: dict[int, int] = {}
        for j in range(i + 1, n):
            b = rows[j]
            if b["start"] - a["end"] > max(rules["max_gap"], rules["far"]):
                break
            if b["gone"] or (a["speaker"] and b["speaker"] and a["speaker"] != b["speaker"]) or (b["agrees"] and not a["agrees"]):
                continue
            k, total, again = j, 0, 0
            while k < n and total < size * 1.6 + 4 and (k == j or rows[k]["start"] - rows[k - 1]["end"] <= 3):
                total += len(rows[k]["said"])
                if k not in met:
                    met[k] = 0
                    for x in bits.keys() & rows[k]["heard"]:
                        met[k] |= bits[x]
                again |= met[k]
                k += 1
            # no more of its words can be said again in order than are said at all
            if total < size or again.bit_count() / size < need:
                continue
            later = rows[j:k]
            stream = [x for r in later for x in r["said"]]
            if any(x["negative"] for x in later) != a["negative"] or (a["question"] and not any(x["question"] for x in later)) or (a["asks"] and not any(x["asks"] for x in later)):
                continue
            if takes.common(a["said"], stream) / size < need:
                continue
            t = rows[i + 1]
            behind = i + 1 < j and not t["gone"] and 0 < len(t["said"]) <= 3 and t["start"] - a["end"] <= 1 and 2 * takes.common(t["said"], stream) <= len(t["said"])
            yield a["p"], stream, t["p"] if behind else None
            break


def _abandoned(p: DataFrame, gone: DataFrame, rules: Rules) -> DataFrame:
    """Takes whose words are said again later, split otherwise, and small phrases around them."""
    marked = settle(p.select(KEY, "p", "start", "end", "said", "sounds", "speaker", "agrees", "negative", "question", "asks", "ended", "nod", "n_said", "cum", "next_start").join(gone.select(KEY, "p", F.lit(True).alias("_g")), [KEY, "p"], "left").withColumn("gone", F.coalesce("_g", F.lit(False))).drop("_g"), "phrases")
    # of each chunk: how far it has to see in time, and then in words
    seen = marked.withColumn("chunk", F.expr(f"p div {CHUNK}")).filter("not gone and not nod and n_said >= 5")
    chunks = seen.groupBy(KEY, "chunk").agg((F.max("end") + max(rules.max_gap, rules.far)).alias("t"), (F.max("n_said") * 2 + 8).alias("need"))
    chunks = joins.as_of(chunks, marked.select(KEY, "start", "p", "cum"), "t", "start", ["p", "cum"]).withColumn("upto", F.col("cum") + F.col("need")).drop("p", "cum", "t")
    chunks = joins.as_of(chunks, marked.select(KEY, F.col("cum").alias("at"), "p"), "upto", "at", ["p"])
    dealt = chunks.select(KEY, "chunk", F.explode(F.expr(f"sequence(chunk * {CHUNK}, greatest(p, chunk * {CHUNK}))")).alias("p")).join(marked.drop("n_said", "cum", "next_start"), [KEY, "p"]).withColumn("own", F.expr(f"p div {CHUNK} = chunk"))
    kind, options = p.schema[KEY].dataType.simpleString(), asdict(rules)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        # by columns of Arrow: as pandas, a small chunk took longer to convert than to go through
        rows = table.sort_by("p").to_pylist()
        for r in rows:
            r["heard"] = frozenset(r["sounds"])
        found = list(zip(*_retold(rows, options), strict=True)) or [(), (), ()]
        return pa.table({KEY: pa.array([key[0].as_py()] * len(found[0]), table.schema.field(KEY).type), "i": pa.array(found[0], pa.int64()), "stream": pa.array(found[1], pa.list_(pa.string())), "t": pa.array(found[2], pa.int64())})

    told = settle(spread(dealt, KEY, "chunk").groupBy(KEY, "chunk").applyInArrow(run, f"{KEY} {kind}, i long, stream array<string>, t long"), "retold")
    why = lambda rows, reason, rank: rows.select(KEY, "p", F.lit(reason).alias("why"), F.lit(rank).alias("rank"))
    cut = why(told.select(KEY, F.col("i").alias("p")), "abandoned take", 2).unionByName(why(told.filter("t is not null").select(KEY, F.col("t").alias("p")), "abandoned take", 2))
    behind = told.filter("t is not null").select(KEY, F.col("t").alias("p"), F.lit(True).alias("_t"))
    small = marked.join(behind, [KEY, "p"], "left").withColumn("fits", ~F.col("gone") & F.col("_t").isNull() & (F.col("n_said") >= 1) & (F.col("n_said") <= 4) & (F.col("next_start") - F.col("end") <= 6))
    front = told.select(KEY, "i", "stream", (F.col("i") - 1).alias("q")).filter("q >= 0")
    while not front.isEmpty():
        # a step back over the small phrases before each take
        back = front.withColumn("off", F.explode(F.sequence(F.lit(0), F.lit(BACK_STEP - 1)))).withColumn("p", F.col("q") - F.col("off"))
        met = back.filter("p >= 0").join(small.select(KEY, "p", "said", "n_said", "fits"), [KEY, "p"])
        met = met.withColumn("n", _common(F.when(F.col("fits"), F.col("said")).otherwise(F.array().cast("array<string>")), F.col("stream")))
        met = settle(met.withColumn("good", F.col("fits") & (2 * F.col("n") >= F.col("n_said"))).select(KEY, "i", "q", "stream", "off", "p", "good"), "before")
        ends = met.groupBy(KEY, "i").agg(F.coalesce(F.min(F.when(~F.col("good"), F.col("off"))), F.lit(BACK_STEP)).alias("until"))
        cut = cut.unionByName(why(met.select(KEY, "i", "p", "off").join(ends, [KEY, "i"]).filter("off < until"), "false start", 3))
        front = met.filter("off = 0").join(ends, [KEY, "i"]).filter(F.col("until") == BACK_STEP).select(KEY, "i", "stream", (F.col("q") - BACK_STEP).alias("q")).filter("q >= 0")
    return cut


def repeated_takes(words: DataFrame, **options) -> DataFrame:
    """Earlier takes, false starts, abandoned takes, asides and words said twice: rec_id, start, end, text, reason, estimated; cuts that touch are one.

    words: rec_id, ord, start, end, text, and where known speaker, conf, estimated, cue_start and cue_end.  Options
    are those of Rules.
    """
    rules = Rules(**options)
    p = settle(phrases(words, rules), "phrases")
    member, gone = _grouped(p, rules)
    gone = settle(gone.unionByName(_false_starts(p, gone, rules)), "gone")
    if rules.people != "many":
        gone = gone.unionByName(_abandoned(p, gone, rules))
    # the reason that came first
    gone = settle(gone.groupBy(KEY, "p").agg(F.min_by("why", "rank").alias("why")), "gone")
    touched = member.unionByName(gone.select(KEY, "p")).distinct().withColumn("touched", F.lit(True))
    order = Window.partitionBy(KEY).orderBy("p")
    rows = p.drop("said", "sounds", "body", "open_key", "open_all").join(gone, [KEY, "p"], "left").join(touched, [KEY, "p"], "left").na.fill(False, ["touched"])
    beside = lambda f: f("touched").over(order) & (F.col("speaker").isNull() | f("speaker").over(order).isNull() | (F.col("speaker") == f("speaker").over(order)))
    talk = F.col("aside") & ~F.col("touched") & (F.coalesce(beside(F.lag), F.lit(False)) | F.coalesce(beside(F.lead), F.lit(False)))
    rows = rows.withColumn("why", F.coalesce("why", F.when(talk, F.lit("off-script aside"))))
    twice = rows.filter("why is null").select(KEY, "p", F.explode("inner").alias("x")).select(KEY, "x.start", "x.end", "x.text", F.lit("false start").alias("reason"), F.lit(False).alias("estimated"), F.lit(0).alias("kind"), "p")
    whole = rows.filter("why is not null")
    end = F.least(F.coalesce("next_start", "end"), F.greatest("end", "start") + 1.0)
    sure = F.col("head_sure") & F.when(F.col("next_start").isNotNull(), F.col("next_sure")).otherwise(F.col("tail_sure"))
    cuts = whole.select(KEY, "start", end.alias("end"), "text", F.col("why").alias("reason"), (~sure).alias("estimated"), F.lit(1).alias("kind"), "p")
    return tidy(twice.unionByName(cuts))


def tidy(cuts: DataFrame, least: float = 0.1, slack: float = 0.05) -> DataFrame:
    """Cuts joined where they touch: rec_id, start, end, text (different ones, in order), reason (the first one's), estimated (of any). cuts: also kind and p, which order those that start together."""
    order = Window.partitionBy(KEY).orderBy("start", "kind", "p")
    rows = cuts.filter(F.col("end") - F.col("start") >= least)
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_g", F.sum(F.coalesce(F.col("start") > reach + slack, F.lit(True)).cast("int")).over(order))
    one = rows.groupBy(KEY, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("start", "kind", "p", "text", "reason"))).alias("_l"), F.max("estimated").alias("estimated"))
    more = F.aggregate(F.slice("_l", 2, 1 << 30), F.get("_l", F.lit(0))["text"], lambda t, x: F.when((x["text"] == "") | F.array_contains(F.split(t, " / "), x["text"]), t).otherwise(F.concat(t, F.lit(" / "), x["text"])))
    return one.select(KEY, "start", "end", more.alias("text"), F.get("_l", F.lit(0))["reason"].alias("reason"), "estimated")
