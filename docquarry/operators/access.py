"""Access for models and applications: exports, transcripts, splits and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_json(df: DataFrame, columns: list[str], *, out_col: str = "line") -> DataFrame:
    """One JSON object per row with the given columns in order; nulls are left out."""
    return df.select(F.to_json(F.struct(*columns)).alias(out_col))


def transcripts(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, n_turns, transcript): the turns of each conversation in order, one ``role: text`` line each."""
    entry = F.struct(turn_col, F.concat_ws(": ", F.col(role_col), F.col(text_col)).alias("line"))
    ordered = turns.groupBy(id_col).agg(F.array_sort(F.collect_list(entry)).alias("t"))
    return ordered.select(id_col, F.size("t").cast("bigint").alias("n_turns"), F.array_join(F.col("t.line"), "\n").alias("transcript"))


def bucket(key: Column, buckets: int) -> Column:
    """A number from 0 to ``buckets`` - 1 from the first 15 hexadecimal digits of the key's MD5, the same on every run."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint") % buckets


def split(df: DataFrame, shares: dict[str, int], *, key: str = "doc_id", out_col: str = "split") -> DataFrame:
    """``df`` with the name of each row's part; shares are parts of their sum."""
    number, label, low = bucket(F.col(key), sum(shares.values())), None, 0
    for name, share in shares.items():
        hit = (number >= low) & (number < low + share)
        label = F.when(hit, name) if label is None else label.when(hit, name)
        low += share
    return df.withColumn(out_col, label)


def mixture(df: DataFrame, rates: dict[str, float], *, facet: str = "lang", key: str = "doc_id") -> DataFrame:
    """The rows kept when each facet value is sampled at its rate, by the key's digest; other values are not kept."""
    rate = None
    for value, share in rates.items():
        rate = F.when(F.col(facet) == value, F.lit(share)) if rate is None else rate.when(F.col(facet) == value, F.lit(share))
    return df.where(bucket(F.col(key), 1_000_000) < F.coalesce(rate, F.lit(0.0)) * 1_000_000)
