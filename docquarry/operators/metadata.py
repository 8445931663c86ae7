"""Metadata: sizes, facets, licences, open attributes and languages of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as T

#: Frequent words by which a language is told; fixed values.
STOP_WORDS = {
    "de": ("der", "die", "und", "das", "ist", "nicht", "ein", "eine", "mit", "von", "zu", "auf"),
    "en": ("the", "and", "of", "to", "is", "that", "it", "for", "was", "with", "on", "are"),
    "es": ("el", "los", "las", "y", "que", "por", "una", "con", "para", "del", "se", "su"),
    "fr": ("le", "les", "et", "des", "est", "une", "dans", "pour", "pas", "du", "au", "sur"),
}
LICENCES = {"Apache": r"Apache License", "MIT": r"MIT License", "GPL": r"GNU General Public License|\bGPL\b", "CC BY-NC": r"CC BY-NC"}


def sizes(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Characters, UTF-8 bytes and tokens of each text."""
    count = lambda c: c.cast("bigint")
    return df.select(id_col, count(F.length(text_col)).alias("n_chars"), count(F.octet_length(text_col)).alias("n_bytes"), count(F.size(T.tokens(F.col(text_col)))).alias("n_tokens"))


def facet_profile(df: DataFrame, facets: list[str], value: str) -> DataFrame:
    """Count, mean, exact median and 90th percentile and standard deviation of ``value`` for each combination of facets."""
    return df.groupBy(*facets).agg(
        F.count("*").alias("n"),
        F.avg(value).alias("mean"),
        F.percentile(value, 0.5).alias("median"),
        F.percentile(value, 0.9).alias("p90"),
        F.stddev(value).alias("sd"),
    )


def licence(text: Column) -> Column:
    """Name of the first licence that the text mentions, in the order of ``LICENCES``; null if none."""
    return F.coalesce(*(F.when(text.rlike(pattern), F.lit(name)) for name, pattern in LICENCES.items()))


def attributes(df: DataFrame, columns: list[str], *, id_col: str = "doc_id") -> DataFrame:
    """(id, attrs): the given columns as a map of strings, nulls left out."""
    pairs = F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in columns))
    return df.select(id_col, F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull())).alias("attrs"))


def language(text: Column) -> Column:
    """Language with the most different stop words in the text; ties go to the first code; null if there are none."""
    words = F.array_distinct(T.tokens(text))
    scores = [F.struct(F.size(F.array_intersect(words, F.array(*map(F.lit, stops)))).alias("n"), F.lit(-k).alias("order"), F.lit(code).alias("code")) for k, (code, stops) in enumerate(sorted(STOP_WORDS.items()))]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["code"])
