"""Clusters by star contraction, with hubs, and samples of an exact size."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import graphs, sampling


def plainly(edges: list[tuple]) -> dict:
    root: dict = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        for x in (a, b):
            root.setdefault(x, x)
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("hub", [2, 10_000])
def test_clusters_equal_a_plain_search(spark, hub):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)] + [(3000 - i, 3000) for i in range(50)]
    edges += [(5, 5), (None, 3), (7, None), (9000, 9000), edges[0], edges[0][::-1]]
    df = spark.createDataFrame(edges, "src bigint, dst bigint").repartition(3)
    found = graphs.clusters(df, hub=hub).collect()
    assert len(found) == len({r.node for r in found}) and {r.node: r.root for r in found} == plainly(edges)


def test_nodes_of_other_types_and_no_edges(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "u string, m string")
    assert {r.node: r.root for r in graphs.clusters(df, a_col="u", b_col="m").collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert graphs.clusters(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_a_hub_of_a_hundred_thousand_edges_is_in_no_single_task(spark):
    edges = spark.range(1, 100_001).select(F.lit(0).cast("bigint").alias("u"), F.col("id").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    size = 1000
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = graphs.salted(edges, least, least.where(F.col("n") > size), size).withColumn("task", F.spark_partition_id())
        assert dealt.count() == 100_000 and dealt.where("m <> 1").count() == 0
        # The hub's edges lie in many tasks, a few parts of about its size in each.
        assert dealt.groupBy("task").count().agg(F.max("count")).first()[0] < 10 * size
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The list of hubs stays bounded as the graph grows.
    for n in (10**3, 10**9, 10**12):
        assert 2 * n / graphs.hub_size(n) <= graphs.HUBS


def test_a_large_star_and_a_chain_through_it(spark):
    star = spark.range(1, 30_001).select(F.lit(50_000).alias("src"), F.col("id").alias("dst"))
    found = graphs.clusters(star.union(spark.createDataFrame([(50_000, 60_000), (60_000, 70_000)], "src bigint, dst bigint")), hub=500)
    assert found.agg(F.count("*"), F.min("root"), F.max("root")).first() == (30_003, 1, 1)


def key(doc, weight, seed=0):
    u = (int(hashlib.md5(f"{seed}:{doc}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return -math.log(u) / weight


@pytest.mark.parametrize("k", [1, 7, 400])
def test_samples_are_the_least_keys_of_every_stratum(spark, k, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, "hot" if i % 3 else ["a", "b", None, "c"][int(rng.integers(4))], float(rng.integers(0, 5)), f"t{i}") for i in range(3000)]
    rows += [(None, "a", 1.0, "x"), (5000, "a", None, "y"), (5001, "a", float("nan"), "z"), (5002, "a", -1.0, "w"), (5003, "only", 2.0, "v")]
    df = spark.createDataFrame(rows, "doc_id bigint, s string, w double, row string").repartition(13)
    found = sampling.stratified(df, k, "s", weight_col="w")
    assert found.columns == df.columns
    want = set()
    for stratum in {r[1] for r in rows}:
        held = sorted((key(r[0], r[2]), r[0]) for r in rows if r[1] == stratum and r[0] is not None and r[2] and r[2] > 0)
        want |= {d for _, d in held[:k]}
    got = [r.doc_id for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_sample_does_not_depend_on_partitions_and_follows_weights(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("s"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"))
    one, other = (sorted(r.doc_id for r in sampling.stratified(df.repartition(n), 1000, "s", weight_col="w", seed=3).collect()) for n in (2, 17))
    assert one == other and len(one) == 1000
    assert 0.70 < sum(x % 2 == 0 for x in one) / 1000 < 0.80


def test_empty_table(spark):
    assert sampling.stratified(spark.createDataFrame([], "doc_id bigint, s string"), 3, "s").count() == 0
