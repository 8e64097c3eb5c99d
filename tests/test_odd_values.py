"""Queries over values that the smallest data doesn't have, against their SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import pytest

from chronoweft.plans import catalog, forms  # noqa: F401


@pytest.fixture
def against_sql(spark, tmp_path):
    def run(name, **tables):
        con = duckdb.connect()
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        got = catalog.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
        return sorted(tuple(r) for r in got.collect()), sorted(want)

    return run


TALKS = "conv_id long, turn long, role string, text string"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_capitals_of_one_letter(against_sql):
    texts = ["12 ßein Haus", "ﬁne Text", "1 ᾳb c", "éa b", "7 8", "a"]
    got, want = against_sql("sentence_case", conversations=([(1, k, "user", t) for k, t in enumerate(texts)], TALKS))
    assert got == want and got[0][2] == "12 ẞein haus"


def test_stretch_of_no_length_between_two_cuts(against_sql):
    day = datetime(2024, 1, 1)
    rows = [(k, day + timedelta(hours=h), 1, "view", v, "{}") for k, (h, v) in enumerate([(0, 1.0), (5, 0.0), (9, 2.0), (20, 0.0)])]
    got, want = against_sql("shortened_timeline", events=(rows, EVENTS))
    assert got == want and len(got) == 4
