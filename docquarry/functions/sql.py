"""The library's text functions under SQL names, for sessions that are queried in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import SENTENCE_END, TOKEN_BREAK

#: SQL bodies: Catalyst inlines them, so a call costs what the written-out expression costs.
SCALAR = {
    "dq_tokens": ("text STRING", "ARRAY<STRING>", f"filter(split(lower(text), r'{TOKEN_BREAK}'), x -> x <> '')"),
    "dq_sentences": ("text STRING", "ARRAY<STRING>", f"filter(split(text, r'{SENTENCE_END}'), x -> trim(BOTH ' \\t\\n\\f\\r' FROM x) <> '')"),
    "dq_content_hash": ("text STRING", "STRING", "md5(cast(text AS BINARY))"),
}
#: A generator takes no SQL function, so its body is written out.
TABLE = {"dq_terms": ("text STRING", "pos INT, term STRING", f"SELECT pos, term FROM posexplode({SCALAR['dq_tokens'][2]}) AS t(pos, term)")}


def geometric_mean(values: pd.Series) -> float:
    """Of the positive values; NaN without any. A group's values are one series, so use it on groups of bounded size."""
    import numpy as np

    kept = values[values > 0]
    return float(np.exp(np.log(kept).mean())) if len(kept) else float("nan")


def register(spark: SparkSession) -> None:
    """Temporary functions ``dq_tokens``, ``dq_sentences``, ``dq_content_hash``, the table function ``dq_terms`` and the aggregate ``dq_geometric_mean``."""
    for name, (given, returned, body) in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {returned} RETURN {body}")
    for name, (given, returned, body) in TABLE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS TABLE({returned}) RETURN {body}")
    spark.udf.register("dq_geometric_mean", F.pandas_udf(geometric_mean, "double"))
