"""Live loudness, an extension: hops of energy and loud/quiet state of streams of samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What keeps the state of ``live_state``; set it before the stream starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def live_levels(samples: DataFrame, hop: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Level of each hop: rec_id, start, db. samples: a stream of rec_id, ts, v. Samples later than ``late`` are left out."""
    power = F.avg(F.col("v") * F.col("v"))
    return samples.withWatermark("ts", late).groupBy("rec_id", F.window("ts", hop)).agg(F.when(power > 1e-12, 10 * F.log10(power)).otherwise(F.lit(-120.0)).alias("db")).select("rec_id", F.col("window.start").alias("start"), "db")


class _Hysteresis(StatefulProcessor):
    """Loud or quiet of one recording, told in order of time.

    Levels wait in a list until the watermark has passed them, so that batches may come out of order; then a timer
    tells them.  A level behind the last one told is late and left out.  A recording that is silent for ``idle``
    milliseconds of event time is over: its state goes, and a marker row (loud null) tells so.
    """

    def __init__(self, threshold: float, rise: float, idle: int) -> None:
        self.threshold, self.rise, self.idle = threshold, rise, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts timestamp, db double")
        self.told = handle.getValueState("told", "loud boolean, upto timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = self.told.get()[1] if self.told.exists() else None
        for part in rows:
            some = part[["ts", "db"]].dropna()
            some = some if upto is None else some[some["ts"] > pd.Timestamp(upto)]
            if len(some):
                self.waiting.appendList([(ts.to_pydatetime(), float(db)) for ts, db in some.itertuples(index=False)])
                for at in {int(ts.value // 1_000_000) for ts in some["ts"]}:
                    # a millisecond behind the level: the watermark has passed it then
                    self.handle.registerTimer(at + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        held = sorted((pd.Timestamp(ts), db) for ts, db in self.waiting.get()) if self.waiting.exists() else []
        due, rest = [x for x in held if x[0] < now], [x for x in held if x[0] >= now]
        loud, upto = self.told.get() if self.told.exists() else (None, None)
        out = []
        for ts, db in due:
            loud = db > self.threshold if loud is None else (db >= self.threshold if loud else db > self.threshold + self.rise)
            upto = ts
            out.append((key[0], ts, bool(loud)))
        if due:
            if rest:
                self.waiting.put([(ts.to_pydatetime(), db) for ts, db in rest])
            else:
                self.waiting.clear()
            self.told.update((bool(loud), pd.Timestamp(upto).to_pydatetime()))
            self.handle.registerTimer(int(pd.Timestamp(upto).value // 1_000_000) + self.idle)
        elif not rest and upto is not None and now >= pd.Timestamp(upto) + pd.Timedelta(milliseconds=self.idle - 1):
            self.told.clear()
            out.append((key[0], now, None))
        if out:
            yield pd.DataFrame(out, columns=["rec_id", "ts", "loud"]).astype({"ts": "datetime64[ns]", "loud": object})

    def close(self) -> None:
        pass


def live_state(levels: DataFrame, threshold: float, rise: float = 3.0, late: str = "10 seconds", idle: float = 60.0) -> DataFrame:
    """Loud or quiet with hysteresis: rec_id, ts, loud; loud is null where a recording ended. levels: a stream of rec_id string, ts, db.

    Levels are told in order of time once the watermark, ``late`` behind the newest, has passed them, whatever batch
    they came in; later ones are left out, as are those without time or level.  After ``idle`` seconds without a
    level a recording's state goes.  The session needs STATE_STORE.
    """
    held = levels.select("rec_id", "ts", "db").withWatermark("ts", late)
    return held.groupBy("rec_id").transformWithStateInPandas(_Hysteresis(threshold, rise, int(idle * 1000)), "rec_id string, ts timestamp, loud boolean", "append", "EventTime")
