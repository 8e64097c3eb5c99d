"""The live path: late and out-of-order levels, and state that goes."""

from __future__ import annotations

import datetime as dt

import pytest

from chronoweft.streaming import envelope

BASE = dt.datetime(2024, 1, 1)


@pytest.fixture
def stored(spark):
    keep = {k: spark.conf.get(k, None) for k in envelope.STATE_STORE}
    for k, v in envelope.STATE_STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in keep.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def in_order(levels, threshold, rise):
    out, loud = [], None
    for t, db in sorted(levels):
        loud = db > threshold if loud is None else (db >= threshold if loud else db > threshold + rise)
        out.append((t, loud))
    return out


def test_levels_out_of_order_and_state_that_goes(stored, tmp_path):
    at = lambda s: BASE + dt.timedelta(seconds=s)
    db = [-60, -40, -42, -41, -39, -36, -41, -50, -39, -30, -41, -60]
    # seconds 0 to 11 of one recording in four batches, out of order; second 3 comes again too late, other rows are void
    batches = [[(k, db[k]) for k in (0, 2, 5, 4)], [(k, db[k]) for k in (1, 3, 6)], [(k, db[k]) for k in (11, 8, 7)], [(k, db[k]) for k in (9, 10)] + [(3, 0)]]
    source = tmp_path / "in"
    schema = "rec_id string, ts timestamp, db double, loud string"

    def feed(n, rows):
        stored.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"batch={n}"))

    feed(0, [("none", at(0), None, "x"), ("none", None, 1.0, "x")])
    stream = stored.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source) + "/*")
    query = envelope.live_state(stream, -40.0, late="6 seconds", idle=30.0).writeStream.format("memory").queryName("live_state").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).start()
    try:
        query.processAllAvailable()
        for n, rows in enumerate(batches, 1):
            feed(n, [("a", at(s), float(v), "x") for s, v in rows])
            query.processAllAvailable()
        # another recording moves the clock: what waits is told, and then the first one is over
        for n, s in ((10, 25), (11, 45), (12, 90), (13, 130)):
            feed(n, [("b", at(s), -10.0, "x")])
            query.processAllAvailable()
        got = [(r["ts"], r["loud"]) for r in stored.sql("select ts, loud from live_state where rec_id = 'a' order by ts").collect()]
        state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        query.stop()
    want = in_order([(at(k), v) for k, v in enumerate(db)], -40.0, 3.0)
    assert got[: len(want)] == want
    assert len(got) == len(want) + 1 and got[-1][1] is None and got[-1][0] >= at(11 + 30)
    assert state <= 8
