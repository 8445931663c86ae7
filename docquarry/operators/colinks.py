"""Hosts that link to the same targets: a similarity join of sets, by prefixes in order of rarity.

Hosts of equal target sets are one class, so copies are not paired. Targets are
ordered from the rarest; two sets with a Jaccard similarity of ``t`` or more share one of
the first ``size - ceil(t * size) + 1`` targets of each. What meets under a target is not hosts but kinds of
places (a set's size and how far down the target stands in it): kinds that cannot reach ``t`` whatever
the rest of the sets is are told apart before any pair exists. So a target that
all hosts share, which stands last in every set, emits pairs only where it alone would do. Kinds of many sets are
split by salt, and pairs of their parts meet in tasks of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.sources import scratch

#: Sets of one kind under one target that are paired in one task, about.
PART = 500


def classes(edges: DataFrame, *, host_col: str = "host", target_col: str = "target") -> tuple[DataFrame, DataFrame]:
    """((class, targets), (class, host)): different target sets, targets from the rarest on, and the hosts that have them.

    The class is the least of its hosts. Nulls and repeated edges add nothing.
    """
    known = edges.select(F.col(host_col).alias("host"), F.col(target_col).alias("target")).where("host is not null and target is not null").distinct()
    rarity = known.groupBy("target").agg(F.count("*").alias("n"))
    ordered = known.join(rarity, "target").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("n", "target"))).alias("x"))
    sets = ordered.select("host", F.col("x.target").alias("targets"))
    least = sets.groupBy("targets").agg(F.min("host").alias("class"))
    members = sets.join(least, "targets").select("class", "host")
    return least.select("class", "targets"), members


def _reach(a: Column, i: Column, b: Column, j: Column, share: float) -> Column:
    """Whether sets of sizes a and b that first meet at places i and j (from 1) can overlap enough."""
    return (1 + F.least(a - i, b - j)) * F.lit(1 + share) >= F.lit(share) * (a + b) - F.lit(1e-9)


def similar(edges: DataFrame, share: float, *, host_col: str = "host", target_col: str = "target", part: int = PART) -> tuple[DataFrame, DataFrame]:
    """((a, b, common, similarity), (class, host)): every pair of classes, a before b, whose target sets have a Jaccard similarity of ``share`` or more."""
    if not 0 < share <= 1:
        raise ValueError("share is above 0 and at most 1")
    sets, members = classes(edges, host_col=host_col, target_col=target_col)
    sets = scratch.materialise(sets, "colink-sets")
    size = F.size("targets")
    first = F.slice("targets", 1, (size - F.ceil(size * F.lit(share) - 1e-9) + 1).cast("int"))
    tokens = sets.select("class", size.alias("size"), F.posexplode(first).alias("at", "target")).withColumn("at", F.col("at") + 1)
    kinds = tokens.groupBy("target", "size", "at").agg(F.count("*").alias("n"))
    other = kinds.select("target", F.col("size").alias("size2"), F.col("at").alias("at2"), F.col("n").alias("n2"))
    parts = lambda n: F.ceil(F.col(n) / F.lit(part)).cast("int")
    # Pairs of kinds, the smaller one first; a kind that can meet itself is a pair too.
    order = (F.col("size") < F.col("size2")) | ((F.col("size") == F.col("size2")) & (F.col("at") <= F.col("at2")))
    met = kinds.join(other, "target").where(order & (F.col("size") >= F.col("size2") * F.lit(share) - 1e-9) & _reach(F.col("size"), F.col("at"), F.col("size2"), F.col("at2"), share))
    met = scratch.materialise(met.where(~((F.col("size") == F.col("size2")) & (F.col("at") == F.col("at2")) & (F.col("n") < 2))).select("target", "size", "at", "size2", "at2", parts("n").alias("p"), parts("n2").alias("q")), "colink-kinds")
    salt = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    kind = ["target", "size", "at", "size2", "at2"]
    left = tokens.join(met, ["target", "size", "at"]).select(*kind, F.col("class").alias("a"), salt("p").alias("x"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("y"))
    right = tokens.select("target", F.col("size").alias("size2"), F.col("at").alias("at2"), "class").join(met, ["target", "size2", "at2"])
    right = right.select(*kind, F.col("class").alias("b"), salt("q").alias("y"), F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("x"))
    same = (F.col("size") == F.col("size2")) & (F.col("at") == F.col("at2"))
    pairs = left.join(right, [*kind, "x", "y"]).where((F.col("a") != F.col("b")) & (~same | (F.col("a") < F.col("b"))))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one, two = (sets.select(F.col("class").alias(n), F.col("targets").alias(f"t{n}")) for n in "ab")
    common = F.size(F.array_intersect("ta", "tb")).cast("bigint")
    made = pairs.join(one, "a").join(two, "b").select("a", "b", common.alias("common"), (common / (F.size("ta") + F.size("tb") - common)).alias("similarity"))
    return made.where(F.col("similarity") >= F.lit(share) - 1e-9), members
