"""Fuzzy lookup of terms by deletions: terms within a distance share a shortened form, so they meet by an equi-join.

Two terms at a Levenshtein distance of up to ``d`` become equal when up to
``d`` characters are deleted from either, and the same holds for their first ``PREFIX``
characters: what an edit shifts out of the prefix counts as deleted. All
forms of a term's prefix with up to ``d`` deletions are its keys, a number that does not
depend on the term's length; a pair that shares a key is compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T

#: Characters of a term that keys are made of: at distance 2 a term has 56 keys at most.
PREFIX = 10


def keys(term: Column, distance: int, *, prefix: int = PREFIX) -> Column:
    """Different forms of the term's prefix with up to ``distance`` deletions."""
    shorter = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(prefix))))
    forms = last = F.array(F.substring(term, 1, prefix))
    for _ in range(distance):
        last = T.bound(last, lambda held: F.array_distinct(F.flatten(F.transform(held, shorter))))
        forms = F.array_union(forms, last)
    return forms


def index(terms: DataFrame, distance: int, *, term_col: str = "term", prefix: int = PREFIX) -> DataFrame:
    """(key, term): the keys of every different term; write it to look terms up again. Nulls are left out."""
    own = terms.select(F.col(term_col).alias("term")).where("term is not null").distinct()
    return own.select(F.explode(keys(F.col("term"), distance, prefix=prefix)).alias("key"), "term")


def lookup(wanted: DataFrame, indexed: DataFrame, distance: int, *, term_col: str = "term", prefix: int = PREFIX) -> DataFrame:
    """(wanted, term, distance) of all pairs within ``distance``, which and ``prefix`` are those of the index.

    Each different term is looked up once. A key of many terms is a join key
    of many rows, which adaptive execution splits; pairs that share several
    keys are one row. Lengths rule out most candidates before they are compared.
    """
    asked = index(wanted, distance, term_col=term_col, prefix=prefix).withColumnRenamed("term", "wanted")
    near = F.abs(F.length("wanted") - F.length("term")) <= distance
    # A pair is compared where it meets under the first of its common keys in order, so it needs no second shuffle to be one row.
    met = asked.join(indexed, "key").where(near)
    both = F.array_intersect(keys(F.col("wanted"), distance, prefix=prefix), keys(F.col("term"), distance, prefix=prefix))
    apart = F.levenshtein("wanted", "term", distance)
    held = met.withColumn("distance", apart).where(F.col("distance") >= 0)
    return held.where(F.array_min(both) == F.col("key")).select("wanted", "term", F.col("distance").cast("bigint").alias("distance"))


def suggest(wanted: DataFrame, dictionary: DataFrame, k: int, *, distance: int = 2, term_col: str = "term") -> DataFrame:
    """(wanted, term, distance, df, rank): for each wanted term the ``k`` nearest of the dictionary (term, df); ties go to the more frequent, then to the first in order."""
    found = lookup(wanted, index(dictionary, distance), distance, term_col=term_col).join(dictionary.select("term", "df"), "term")
    order = [F.asc("distance"), F.desc("df"), F.asc("term")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("wanted").orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= k).select("wanted", "term", "distance", "df", "rank")
