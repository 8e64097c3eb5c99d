"""Topic words, cleaned in a whole text, of odd texts."""

from __future__ import annotations

from chronoweft.functions import text as X


def test_topic_words_of_odd_texts(spark):
    rows = [("'tis ''bcde'' don't Über1 a.b.c.d",), ("''''",), (None,), ("हि न्दी।\tK2 four\nfive5",)]
    got = [r[0] for r in spark.createDataFrame(rows, "text string").coalesce(1).select(X.topic_words("text", ["five5"])).collect()]
    assert got == [["bcde", "ber1", "abcd"], [], [], ["हि", "न्दी", "four"]]
