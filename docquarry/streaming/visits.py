"""Sessions of a stream by state of our own: open sessions in list state, event-time timers that close them, late rows apart.

Spark's ``session_window`` drops rows behind the watermark without a trace. Here they
come out as rows of their own, so that a sink can put them into a side table
(``split``), and a key's state is gone once its last session is closed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "kind string, key string, started timestamp, ended timestamp, n bigint, total double, open bigint"


class Visits(StatefulProcessor):
    """Open sessions of a key as (first, last, n, total), times in milliseconds; a timer a millisecond after each one's last event plus the gap."""

    def __init__(self, gap_ms: int):
        # As in ``session_window``, a row exactly the gap later still belongs.
        self.gap = gap_ms + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("open", "first bigint, last bigint, n bigint, total double")

    def _store(self, sessions: list[tuple]) -> None:
        if sessions:
            self.held.put(sessions)
        else:
            self.held.clear()

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["kind", "key", "started", "ended", "n", "total", "open"])
        for c in ("started", "ended"):
            out[c] = pd.to_datetime(out[c], unit="ms")
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        before = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        late, found = [], list(before)
        for part in rows:
            for at, value in zip(part["ms"].tolist(), part["value"].fillna(0.0).tolist(), strict=True):
                # Late is what could only belong to a session that is closed already.
                if at + self.gap <= mark and not any(a - self.gap < at < b + self.gap for a, b, _, _ in before):
                    late.append(("late", key[0], at, at, 1, float(value), len(before)))
                else:
                    found.append((at, at, 1, float(value)))
        merged: list[tuple] = []
        for x in sorted(found):
            if merged and x[0] - merged[-1][1] < self.gap:
                a, b, n, total = merged[-1]
                merged[-1] = (a, max(b, x[1]), n + x[2], total + x[3])
            else:
                merged.append(x)
        for gone in {b for _, b, _, _ in before} - {b for _, b, _, _ in merged}:
            self.handle.deleteTimer(gone + self.gap)
        for fresh in {b for _, b, _, _ in merged} - {b for _, b, _, _ in before}:
            # One behind the watermark, bridged by an open session's other rows, expires with the next batch.
            self.handle.registerTimer(fresh + self.gap)
        self._store(merged)
        if late:
            yield self._frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        held = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        left = [x for x in held if x[1] + self.gap > due]
        self._store(left)
        closed = [("session", key[0], a, b, n, total, len(left)) for a, b, n, total in held if b + self.gap <= due]
        if closed:
            yield self._frame(closed)

    def close(self) -> None:
        pass


def visits(events: DataFrame, gap_seconds: int, *, late: str, key: str = "user_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """(kind, key, started, ended, n, total, open) of a stream: ``session`` when the watermark has passed its last event plus the gap, ``late`` for a row that came after that.

    ``open`` is how many sessions of the key the state still holds. Rows no further
    apart than the gap are one session. Rows without a key or a time are left out. Needs the RocksDB state store; run it in append mode.
    """
    timed = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    rows = timed.select(F.col(key).cast("string").alias("key"), F.unix_millis("at").alias("ms"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(Visits(1000 * gap_seconds), OUT, "Append", "EventTime")


def split(sessions_path: str, late_path: str):
    """A function for ``foreachBatch`` that writes sessions and late rows to two tables, each batch under its number, so that one that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            held.where("kind = 'session'").drop("kind").write.mode("overwrite").parquet(f"{sessions_path}/batch={number}")
            held.where("kind = 'late'").select("key", F.col("started").alias("at"), F.col("total").alias("value")).write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        finally:
            held.unpersist()

    return write
