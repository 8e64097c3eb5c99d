"""Every query that has a SQL form gives what DuckDB gives, on the smallest data."""

from __future__ import annotations

import os

import duckdb
import pytest

from chronoweft.plans import catalog, exchange, forms, labels, media, nests, observed  # noqa: F401

SF = "/root/testdata/sf0.001"
MODULES = ("chronoweft.plans.exchange", "chronoweft.plans.forms", "chronoweft.plans.nests", "chronoweft.plans.observed", "chronoweft.plans.labels", "chronoweft.plans.media")
NAMES = [n for n, q in catalog.QUERIES.items() if n in catalog.ORACLES and (q.__module__ in MODULES or n in ("chapter_titles", "parse_srt", "tfidf_keywords", "interval_overlap_join"))]


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for file in os.listdir(SF):
        path = f"{SF}/{file}/*.parquet" if os.path.isdir(f"{SF}/{file}") else f"{SF}/{file}"
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, database, name):
    got = catalog.QUERIES[name](spark, SF)
    order = sorted(got.columns)
    want = database.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == order
    rows = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr) == sorted((tuple(r[c] for c in order) for r in rows), key=repr)
