"""Joins and windows that Spark has no single call for: as-of, interval, sessions, top-k per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, *, value_cols: list[str]) -> DataFrame:
    """``left`` with the ``value_cols`` of the latest row of ``right`` with equal ``by`` and ``on`` not after its own.

    Both sides are stacked and ordered once by key and time, and the last value
    is carried on: one shuffle and no pairs. Of right rows with equal key and
    time the greatest values count; left rows without one get nulls, and nulls
    in a key or time match nothing. The values are taken from one right row
    together.
    """
    a = left.select(*left.columns, F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*value_cols)).schema[0].dataType).alias("_v"))
    b = right.dropna(subset=[*by, on]).select(*by, F.col(on), F.lit(0).alias("_side"), F.struct(*value_cols).alias("_v"))
    order = Window.partitionBy(*by).orderBy(F.asc(on), F.asc("_side"), F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_last", F.last("_v", ignorenulls=True).over(order))
    return both.where("_side = 1").select(*left.columns, *(F.col(f"_last.{c}").alias(c) for c in value_cols))


def interval_join(points: DataFrame, spans: DataFrame, *, point: str, start: str, end: str, width: float) -> DataFrame:
    """Points with every span that holds them (start included, end not), met on bins of ``width``.

    A span is repeated once for each bin it touches, so the join is an equi-join
    that Spark can shuffle and whose hot bins it can split. Choose a width near
    the usual length of a span.
    """
    bins = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    dealt = spans.where(F.col(start) < F.col(end)).withColumn("_bin", F.explode(bins))
    return points.withColumn("_bin", F.floor(F.col(point) / width)).join(dealt, "_bin").where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_bin")


def top_per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sessions(events: DataFrame, gap: str, *, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, start, end, n): runs of events of a key that are less than ``gap`` apart; ``end`` is the last event plus the gap."""
    grouped = events.groupBy(key, F.session_window(F.col(ts), gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
