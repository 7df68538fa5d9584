"""When findings open and are resolved, kept for each finding in a state store.

A finding is seen in some periods.  It opens in a period that it is seen in and wasn't in the one before, and is resolved in
the first period that it isn't seen in again.  State is one row for each bucket of findings, with those that are open or may
still change, their periods that the watermark hasn't passed, and one timer: calls to the store grow with buckets and parts of
the stream, not with findings.  A finding goes from it when it is resolved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE, PROVIDER = "spark.sql.streaming.stateStore.providerClass", "RocksDBStateStoreProvider"
#: Findings are dealt to so many buckets by hash, for as long as a checkpoint lives.
BUCKETS = 1 << 11
CHANGES = "key string, period long, change string"


def settle(seen: set[int], done: int, until: int) -> tuple[list[tuple[int, str]], set[int]]:
    """Changes in the periods from ``done`` to before ``until``, and the periods that later ones still need."""
    found = []
    for p in sorted(seen | {p + 1 for p in seen}):
        if done <= p < until and (p in seen) != (p - 1 in seen):
            found.append((p, "opened" if p in seen else "resolved"))
    return found, {p for p in seen if p >= until - 1}


def settle_all(keys: np.ndarray, periods: np.ndarray, done: int, until: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """:func:`settle` for many findings: changes (key, period, change), and what later periods still need (key, period)."""
    seen = pd.DataFrame({"key": keys, "period": periods}).drop_duplicates().sort_values(["key", "period"], ignore_index=True)
    key, period = seen["key"].to_numpy(), seen["period"].to_numpy(np.int64)
    follows = np.zeros(len(seen) + 1, bool)
    if len(seen) > 1:
        follows[1:-1] = (key[1:] == key[:-1]) & (period[1:] == period[:-1] + 1)
    opened = seen[~follows[:-1] & (period >= done) & (period < until)].assign(change="opened")
    ended = seen[~follows[1:] & (period + 1 >= done) & (period + 1 < until)]
    resolved = ended.assign(period=ended["period"] + 1, change="resolved")
    return pd.concat([opened, resolved]), seen[period >= until - 1]


class Lifetime(StatefulProcessor):
    """Rows of the findings of one bucket; ``length`` is a period in milliseconds."""

    def __init__(self, length: int) -> None:
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "done long, timer long, keys array<string>, periods array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([r[["key", "period"]] for r in rows])
        yield from self._go_on(new[new["key"].notna()], timerValues.getCurrentWatermarkInMs())  # others only move the watermark

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go_on(None, timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def _go_on(self, new: pd.DataFrame | None, watermark: int, expired: int | None = None) -> Iterator[pd.DataFrame]:
        until = watermark // self.length  # the periods before it are complete
        done, timer, keys, periods = self.state.get() if self.state.exists() else (until, None, [], [])
        keys, periods = np.array(keys, object), np.array(periods, np.int64)
        if new is not None:  # what comes later than the watermark allows has been answered already
            new = new[new["period"] >= until]
            keys, periods = np.concatenate([keys, new["key"].to_numpy(object)]), np.concatenate([periods, new["period"].to_numpy(np.int64)])
        found, kept = settle_all(keys, periods, done, until)
        if timer is not None and timer != expired:
            self.handle.deleteTimer(timer)
        if len(kept):
            p = kept["period"].to_numpy(np.int64)
            timer = int((min(q for q in (*np.unique(p).tolist(), *(np.unique(p) + 1).tolist()) if q >= until) + 1) * self.length)
            self.state.update((max(done, until), timer, kept["key"].tolist(), p.tolist()))
            self.handle.registerTimer(timer)
        elif self.state.exists():
            self.state.clear()
        if len(found):
            yield found

    def close(self) -> None:
        pass


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key and period of a batch, with the last time: a hot finding isn't shuffled as often as it is seen."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).group_by(["key", "period"]).aggregate([("at", "max")])
        yield from rows.select(["key", "period", "at_max"]).rename_columns(["key", "period", "at"]).to_batches()


def lifetimes(seen: DataFrame, length: int, delay: str = "0 seconds") -> DataFrame:
    """(key, period, change) of a stream (key string, at timestamp): a row for each opening and each resolution.

    ``length`` is a period in seconds, counted from 1970; ``delay`` is how much later than others a row may come.  Rows with a
    null key give no change, but move the time; rows with a null time are left out; repeated rows count once.  What the last
    periods change is known when the time has gone past them.  Run by :func:`advance`.
    """
    rows = seen.where(F.col("at").isNotNull()).select("key", F.floor(F.unix_millis("at") / (length * 1000)).alias("period"), "at")
    rows = rows.mapInArrow(_once, rows.schema).withWatermark("at", delay).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Lifetime(length * 1000), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


def advance(changes: DataFrame, out: str, checkpoint: str) -> None:
    """Answers what has come since the last call with this ``checkpoint`` and adds it to the Parquet folder ``out``.

    Keyed state with timers needs the RocksDB store; the session's own is set again afterwards.
    """
    spark = changes.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, f"org.apache.spark.sql.execution.streaming.state.{PROVIDER}")
    try:
        changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before) if before is not None else spark.conf.unset(STORE)
