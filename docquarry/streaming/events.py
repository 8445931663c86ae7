"""Streams of events: windows, sessions, deduplication, joins and custom state.

Every function takes a streaming DataFrame and returns one; start it with
``writeStream``. Event time must be ``timestamp``: ``timed`` casts it, and the
session's time zone should be UTC.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def timed(events: DataFrame, *, ts: str = "ts", late: str | None = None) -> DataFrame:
    """Event time as ``timestamp``, with a watermark if ``late`` says how late an event may come."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, late) if late else out


def windowed(events: DataFrame, size: str, *, slide: str | None = None, by: tuple[str, ...] = (), ts: str = "ts", value: str = "value") -> DataFrame:
    """(start, end, by, n, total) over tumbling or sliding windows."""
    grouped = events.groupBy(F.window(ts, size, slide) if slide else F.window(ts, size), *by)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, *, key: str = "user_id", ts: str = "ts") -> DataFrame:
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unique(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Events without later ones of an equal key within the watermark; state is dropped after it."""
    return events.dropDuplicatesWithinWatermark([key])


def enriched(events: DataFrame, static: DataFrame, on: str) -> DataFrame:
    """A stream joined with a table; events without a row of the table are kept."""
    return events.join(static, on, "left")


def paired(left: DataFrame, right: DataFrame, *, key: str, within: str, ts: str = "ts") -> DataFrame:
    """Events of two watermarked streams with an equal key, the right one at most ``within`` later."""
    a = left.select(*(F.col(c).alias(f"left_{c}") for c in left.columns))
    b = right.select(*(F.col(c).alias(f"right_{c}") for c in right.columns))
    bound = (F.col(f"right_{ts}") >= F.col(f"left_{ts}")) & (F.col(f"right_{ts}") <= F.col(f"left_{ts}") + F.expr(f"interval {within}"))
    return a.join(b, (F.col(f"left_{key}") == F.col(f"right_{key}")) & bound)


class _Running(StatefulProcessor):
    """Count and sum of a key so far, one small state row for each key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("totals", "n bigint, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n, total = self.state.get() if self.state.exists() else (0, 0.0)
        for part in rows:
            n, total = n + len(part), total + float(part["value"].fillna(0.0).sum())
        self.state.update((n, total))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "total": [total]})

    def close(self) -> None:
        pass


def running_totals(events: DataFrame, *, key: str = "user_id", value: str = "value") -> DataFrame:
    """(key, n, total) of each key after every batch that has events of it; needs the RocksDB state store."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(_Running(), "key string, n bigint, total double", "Update", "None")
