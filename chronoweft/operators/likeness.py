"""How alike words sound, as a table in which every pair of different words stands once, whatever the recordings.

Words are compared by the sounds they consist of, so that nearly all pairs are different and need no row.  Words that
can be alike share a key: the word, its skeleton of sounds, a number's last digits, or a skeleton with one sound left
out (two, of a long one), since skeletons an edit apart share one of those.  Keys bring pairs together by a join,
and only what meets is scored.
"""

from __future__ import annotations

import re
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweft.functions.text import skeleton, word_likeness

KEY = "rec_id"


def meeting_keys(word: str | None) -> list[str]:
    """Keys of which words that are alike share at least one; none of an empty word."""
    if not word:
        return []
    keys = {f"w{word}"}
    if re.fullmatch(r"\d{2,}", word):
        keys |= {f"n{word[k:]}" for k in range(len(word) - 1)}
    bones = skeleton(word)
    if bones:
        keys.add(f"s{bones}")
    if len(bones) >= 4:
        for n in range(1, 3 if len(bones) >= 8 else 2):
            keys |= {"d" + "".join(c for k, c in enumerate(bones) if k not in out) for out in combinations(range(len(bones)), n)}
        keys.add(f"d{bones}")
    return sorted(keys)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _keys(words: pd.Series) -> pd.Series:
    return words.map(meeting_keys)


@F.pandas_udf(T.DoubleType())
def _score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([word_likeness(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def likeness(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, score of all pairs of different words of two tables (column word) that are alike; those without sounds of which nothing is known but that (0.3) are left out. Null and empty words are like nothing."""
    keyed = lambda rows, name: rows.select(F.col("word").alias(name)).filter(F.col(name) != "").distinct().withColumn("key", F.explode(_keys(F.col(name))))
    met = keyed(left, "a").join(keyed(right, "b"), "key").select("a", "b").distinct()
    return met.withColumn("score", _score("a", "b")).filter("score > 0.3")


def likeness_by_recording(left: DataFrame, right: DataFrame) -> DataFrame:
    """rec_id and alike (a, b, score of the pairs that occur there), for words of two tables (rec_id, word). A pair that occurs in many recordings is scored once."""
    a, b = left.select(KEY, F.col("word").alias("a")).distinct(), right.select(KEY, F.col("word").alias("b")).distinct()
    pairs = likeness(left, right)
    return a.join(pairs, "a").join(b, [KEY, "b"]).groupBy(KEY).agg(F.collect_list(F.struct("a", "b", "score")).alias("alike"))
