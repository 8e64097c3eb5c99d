"""Keywords and chapters of a transcript."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.functions import text as X
from chronoweft.functions import words as lists
from chronoweft.operators.signal import per_recording
from chronoweft.sources.folders import settle

KEY = "rec_id"


#: Different words counted together before they are passed on.
COUNTED = 300_000


def _counted(stop: list[str], min_length: int, numbers: bool, apart: bool) -> Callable:
    """Keywords of cues (key, cue, lower-case text) as rows key, cue, word, tf, df: those of many cues added up, or with ``apart`` each cue by itself."""
    left_out, cut = frozenset(stop), re.compile(f"[^{X.PLAIN_KEY}]+")

    def word(raw: str) -> str | None:
        w = raw.strip("'")
        return w if w and w not in left_out and (numbers if "0" <= w[0] <= "9" else len(w.replace("'", "")) >= min_length) else None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tf, df, known, kinds = Counter(), Counter(), {}, None

        def rows() -> pa.RecordBatch:
            keys, cues, words = zip(*tf, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(keys, kinds[0]), pa.array(cues, kinds[1]), pa.array(words, pa.string()), pa.array(tf.values(), pa.int64()), pa.array(map(df.__getitem__, tf), pa.int64())], names=[KEY, "cue", "word", "tf", "df"])
            tf.clear(), df.clear(), known.clear()
            return out

        for part in parts:
            kinds = part.schema.field(0).type, part.schema.field(1).type
            for key, cue, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                at, own = cue if apart else None, {}
                for raw, n in Counter(cut.split(text)).items():
                    if raw not in known:
                        known[raw] = word(raw)
                    w = known[raw]
                    if w is not None:
                        own[w] = own.get(w, 0) + n
                for w, n in own.items():
                    tf[key, at, w] += n
                    df[key, at, w] += 1
                if len(tf) >= COUNTED or len(known) >= COUNTED:
                    if tf:
                        yield rows()
                    known.clear()
        if tf:
            yield rows()

    return run


def keyword_scores(cues: DataFrame, stop: list[str] | None = None, min_length: int = 3, numbers: bool = True, cue: str = "cue") -> DataFrame:
    """TF-IDF of a recording's keywords: rec_id, word, tf, df, score = tf * ln(1 + cues / df). cues: rec_id, cue, text; a repeated cue id counts once for df.

    Words are counted where their cues are read, so that a word goes to the shuffle once for many cues; only cues
    whose ids are repeated go there by themselves.
    """
    ids = cues.groupBy(KEY, cue).agg(F.count(F.lit(1)).alias("c"))
    n = ids.groupBy(KEY).agg(F.sum("c").alias("n"))
    apart = not ids.filter("c > 1").isEmpty()
    kinds = [cues.schema[c].dataType.simpleString() for c in (KEY, cue)]
    texts = cues.select(KEY, F.col(cue).alias("cue"), X.straight("text").alias("text"))
    per = texts.mapInArrow(_counted(stop or lists.STOP, min_length, numbers, apart), f"{KEY} {kinds[0]}, cue {kinds[1]}, word string, tf long, df long")
    if apart:
        per = per.groupBy(KEY, "word", "cue").agg(F.sum("tf").alias("tf")).withColumn("df", F.lit(1))
    per = per.groupBy(KEY, "word").agg(F.sum("tf").cast("long").alias("tf"), F.sum("df").cast("long").alias("df"))
    return per.join(n, KEY).select(KEY, "word", "tf", "df", (F.col("tf") * F.log(1 + F.col("n") / F.col("df"))).alias("score"))


def top_keywords(scores: DataFrame, k: int = 12, least: float | None = None) -> DataFrame:
    """The k best keywords of each recording, ties by the word: adds rank."""
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy(KEY).orderBy(F.col("score").desc(), "word"))).filter(F.col("rank") <= k)
    return ranked if least is None else ranked.filter(F.col("score") >= least)


def broll_terms(cues: DataFrame, skip: list[str] | None = None, k: int = 12, cue: str = "cue") -> DataFrame:
    """Concrete words worth a picture, one for each five-letter stem, with the time they are first said: rec_id, term, at. cues: rec_id, cue, start, text."""
    scores = keyword_scores(cues, [*lists.STOP, *(skip or [])], numbers=False, cue=cue)
    fit = scores.filter((F.length(F.translate("word", "'", "")) >= 4) & ~F.col("word").rlike("[^e]ed$"))
    order = [F.col("score").desc(), "word"]
    one = fit.withColumn("_s", F.row_number().over(Window.partitionBy(KEY, F.substring("word", 1, 5)).orderBy(*order))).filter("_s = 1")
    best = one.withColumn("_r", F.row_number().over(Window.partitionBy(KEY).orderBy(*order))).filter(F.col("_r") <= k).select(KEY, "word")
    said = cues.select(KEY, "start", F.explode(X.tokens("text")).alias("word"))
    return said.join(best, [KEY, "word"]).groupBy(KEY, F.col("word").alias("term")).agg(F.min("start").alias("at"))


def hook_markers(cues: DataFrame) -> DataFrame:
    """Cues that match a hook pattern: rec_id, at, label, text."""
    return cues.select(KEY, F.col("start").alias("at"), X.hook_label("text").alias("label"), F.substring(F.coalesce("text", F.lit("")), 1, 80).alias("text")).filter(F.col("label").isNotNull())


def most_said(cues: DataFrame, group: str = "part") -> DataFrame:
    """The most frequent topic word of each group of cues, the first to reach its count: rec_id, group, label. cues: rec_id, group, ord, text."""
    said = cues.select(KEY, group, "ord", F.posexplode(X.topic_words("text")).alias("k", "word"))
    nth = F.row_number().over(Window.partitionBy(KEY, group, "word").orderBy("ord", "k"))
    counted = said.withColumn("_n", nth)
    return counted.groupBy(KEY, group).agg(F.max_by("word", F.struct("_n", -F.col("ord"), -F.col("k"))).alias("label")).withColumn("label", X.title_case("label"))


def chapter_titles(cues: DataFrame, group: str = "part") -> DataFrame:
    """One or two words that a chapter says more than the others: rec_id, group, title. cues: rec_id, group, text."""
    n = cues.select(KEY, group).distinct().groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    tf = cues.select(KEY, group, F.explode(X.topic_words("text")).alias("word")).groupBy(KEY, group, "word").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(KEY, "word").agg(F.count(F.lit(1)).alias("df"))
    scored = tf.join(df, [KEY, "word"]).join(n, KEY).withColumn("s", F.col("tf") * (F.log(F.col("_n") / F.col("df")) + 0.1))
    w = Window.partitionBy(KEY, group).orderBy(F.round("s", 9).desc(), F.col("tf").desc(), "word")
    ranked = scored.withColumn("r", F.row_number().over(w)).filter("r <= 2").groupBy(KEY, group).agg(*[F.max(F.when(F.col("r") == k, F.col(c))).alias(f"{c}{k}") for k in (1, 2) for c in ("word", "tf", "s")])
    two = (F.col("tf2") >= 2) & (F.col("s2") >= 0.6 * F.col("s1"))
    return ranked.select(KEY, group, X.title_case(F.when(two, F.concat_ws(" ", "word1", "word2")).otherwise(F.col("word1"))).alias("title"))


#: Weights of words and times are whole numbers of these parts, so that sums don't depend on their order.
_PARTS, _MICRO = 1_000_000, 1_000_000


def _breaks(cues: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The lines, and each line at which a chapter can begin with the likeness of what is said before and after: rec_id, k, t, sim, and of the recording length, reach and first.

    A word's weight on either side of a moment changes only where one of its lines enters or leaves the stretch there.
    So each saying of a word gives three moments; between them the products of its weights stand still, and their
    changes, summed up over all words and then over time, are the products of the whole bags at any moment.  No
    recording's words or lines are gathered, and the rows are three for each saying.
    """
    order = Window.partitionBy(KEY).orderBy("start", "ord")
    lines = cues.filter(F.col("text").isNotNull()).withColumn("k", F.row_number().over(order).cast("long") - 1)
    of = lines.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max_by("end", "k").alias("last"))
    of = of.withColumn("length", F.col("last") - F.col("first")).withColumn("reach", F.greatest(F.lit(float(least)), F.least(F.lit(120.0), F.col("length") / 40)))
    micro = lambda c: F.round(c * _MICRO).cast("long")
    said = lines.select(KEY, "k", micro((F.col("start") + F.col("end")) / 2).alias("m"), F.explode(X.topic_words("text")).alias("word")).groupBy(KEY, "k", "m", "word").agg(F.count(F.lit(1)).alias("c"))
    df = said.groupBy(KEY, "word").agg(F.count(F.lit(1)).alias("df"))
    rare = df.join(of.select(KEY, "n", micro(F.col("reach")).alias("w")), KEY).withColumn("idf", F.log(F.col("n") / F.col("df"))).filter("idf > 0.05")
    said = said.join(rare.select(KEY, "word", "w", F.round(F.col("idf") * _PARTS).cast("long").alias("idf")), [KEY, "word"]).withColumn("x", F.col("c") * F.col("idf"))
    # behind each moment: the saying is ahead of what follows, behind it, out of reach
    moves = F.array(*[F.struct(t.alias("at"), l.alias("l"), r.alias("r")) for t, l, r in ((F.col("m") - F.col("w"), F.lit(0), F.col("x")), (F.col("m"), F.col("x"), -F.col("x")), (F.col("m") + F.col("w"), -F.col("x"), F.lit(0)))])
    moved = said.select(KEY, "word", F.explode(moves).alias("e")).groupBy(KEY, "word", "e.at").agg(F.sum("e.l").alias("l"), F.sum("e.r").alias("r"))
    each = Window.partitionBy(KEY, "word").orderBy("at")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    sums = moved.withColumns({"l": F.sum("l").over(each), "r": F.sum("r").over(each)})
    sums = sums.withColumns({"dot": wide("l") * wide("r"), "ll": wide("l") * wide("l"), "rr": wide("r") * wide("r")})
    step = lambda c: (F.col(c) - F.coalesce(F.lag(c).over(each), F.lit(0))).alias(c)
    changed = sums.select(KEY, "at", *[step(c) for c in ("dot", "ll", "rr")]).groupBy(KEY, "at").agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("dot", "ll", "rr")])
    asked = lines.join(of.drop("n"), KEY).filter((F.col("k") >= 1) & (F.col("start") - F.col("first") >= least) & (F.col("last") - F.col("start") >= least))
    asked = asked.select(KEY, "k", F.col("start").alias("t"), micro(F.col("start")).alias("at"), "length", "reach", "first")
    none = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in ("k", "t", "length", "reach", "first")]
    both = asked.select("*", *[F.lit(0).cast("decimal(38,0)").alias(c) for c in ("dot", "ll", "rr")], F.lit(0).alias("kind")).unionByName(changed.select(KEY, *none, "at", "dot", "ll", "rr", F.lit(1).alias("kind")))
    # a moment counts for what comes after it
    upto = Window.partitionBy(KEY).orderBy("at", "kind", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = both.withColumns({c: F.sum(c).over(upto).cast("double") for c in ("dot", "ll", "rr")}).filter("kind = 0")
    sim = F.when((F.col("ll") > 0) & (F.col("rr") > 0), F.col("dot") / F.sqrt(F.col("ll") * F.col("rr"))).otherwise(1.0)
    return lines, summed.select(KEY, "k", "t", sim.alias("sim"), "length", "reach", "first")


def _picked(rows: list[tuple], bar: float, length: float, reach: float, least: float, most: int | None) -> list[int]:
    """The lines at which chapters begin: the deepest dips first, well apart, and at least two if the talk is long enough for them. rows: k, t, depth, sim."""
    most = most or max(2, min(15, math.floor(length / (150 if length <= 1200 else 300) + 0.5)))
    ranked = sorted(rows, key=lambda r: (-r[2], r[3], r[0]))
    taken: list[tuple] = []
    for floor, apart, upto in ((bar, max(least, reach), most - 1), (0.0, least, min(most, 3 if length >= 3 * least + 10 else 1) - 1)):
        for r in ranked:
            if len(taken) < upto and r not in taken and r[2] >= floor and all(abs(r[1] - x[1]) >= apart for x in taken):
                taken.append(r)
    return [r[0] for r in taken]


def chapters(cues: DataFrame, least: float = 30.0, most: int | None = None) -> DataFrame:
    """Chapters of a talk: rec_id, chapter, start, title. cues: rec_id, ord, start, end, text; lines without a text (null) are none.

    Chapters begin where the words before and after differ most: cosines of weighted bags, and how deep each dips
    below those around it.  A recording without lines has none, one without a dip has one.
    """
    lines, at = _breaks(cues, least)
    at = settle(at, "breaks")
    # lines as far apart as twice the reach are compared; that is a milliard here, with two for rounding
    scaled = F.round(F.col("t") / (2 * F.col("reach")) * 1_000_000_000).cast("long")
    near = Window.partitionBy(KEY).orderBy("_u")
    back, ahead = (F.max("sim").over(near.rangeBetween(*r)) for r in ((-1_000_000_002, 0), (0, 1_000_000_002)))
    deep = at.withColumn("_u", scaled).withColumn("depth", back + ahead - 2 * F.col("sim"))
    real = deep.filter("depth > 0")
    nth = Window.partitionBy(KEY).orderBy("depth", "k")
    mid = real.withColumn("_r", F.row_number().over(nth) - 1).join(real.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n")), KEY).filter(F.col("_r") == F.expr("_n div 2")).select(KEY, F.col("depth").alias("median"))
    bar = real.groupBy(KEY).agg((F.avg("depth") + 0.75 * F.stddev_pop("depth")).alias("usual")).join(mid, KEY).select(KEY, F.greatest("usual", "median").alias("bar"))
    good = deep.filter("depth >= 0.25").join(bar, KEY).select(KEY, "k", "t", "depth", "sim", "bar", "length", "reach")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        one = frame.iloc[0]
        taken = _picked(list(frame[["k", "t", "depth", "sim"]].itertuples(index=False, name=None)), one["bar"], one["length"], one["reach"], least, most)
        return pd.DataFrame({KEY: [one[KEY]] * len(taken), "k": taken})

    # four numbers of each dip
    begins = good.groupBy(KEY).applyInPandas(run, f"{KEY} {cues.schema[KEY].dataType.simpleString()}, k long").withColumn("_b", F.lit(1))
    parted = lines.join(begins, [KEY, "k"], "left").withColumn("part", F.coalesce(F.sum("_b").over(Window.partitionBy(KEY).orderBy("k")), F.lit(0)).cast("long"))
    parted = settle(parted.select(KEY, "part", "k", "start", "text"), "chapters")
    starts = parted.groupBy(KEY, F.col("part").alias("chapter")).agg(F.min_by("start", "k").alias("start")).withColumn("start", F.when(F.col("chapter") == 0, F.lit(0.0)).otherwise(F.col("start")))
    titles = chapter_titles(parted).withColumnRenamed("part", "chapter")
    return starts.join(titles, [KEY, "chapter"], "left").withColumn("title", F.when(F.coalesce("title", F.lit("")) == "", F.lit("Chapter")).otherwise(F.col("title")))


def evenly(rows: DataFrame, keep: int, ord: str = "ord") -> DataFrame:
    """``keep`` rows of each recording, evenly spread; all if there are no more."""
    w = Window.partitionBy(KEY).orderBy(ord)
    k, n = F.row_number().over(w) - 1, F.count(F.lit(1)).over(Window.partitionBy(KEY))
    rows = rows.withColumn("_k", k).withColumn("_n", n)
    # row k is taken if it is the floor of some i * n / keep
    hit = F.floor(F.ceil(F.col("_k") * keep / F.col("_n")) * F.col("_n") / keep) == F.col("_k")
    return rows.filter((F.col("_n") <= keep) | (hit & (F.ceil(F.col("_k") * keep / F.col("_n")) < keep))).drop("_k", "_n")


def digest(cues: DataFrame, max_chars: int = 12000) -> DataFrame:
    """Lines of the whole talk under a number of characters: rec_id, digest."""

    def kernel(frame: pd.DataFrame):
        lines = [x for x in (" ".join((t or "").split()) for t in frame.sort_values("ord")["text"]) if x]
        whole = "\n".join(lines)
        if len(whole) <= max_chars:
            return [(whole,)]
        keep = max(1, math.floor(max_chars / (len(whole) / len(lines))))
        per = max(80, max_chars // keep - 1)
        return [("\n".join(lines[math.floor(k * len(lines) / keep)][:per] for k in range(keep))[:max_chars],)]

    return per_recording(cues, kernel, "digest string")
