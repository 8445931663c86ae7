"""Similar hosts against all pairs, hot targets, and sketches against exact counts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import colinks, sketches


def plainly(edges: list[tuple], share: float) -> tuple[set, set]:
    sets: dict = {}
    for h, t in edges:
        if h is not None and t is not None:
            sets.setdefault(h, set()).add(t)
    groups: dict = {}
    for h, s in sets.items():
        groups.setdefault(frozenset(s), []).append(h)
    names = {s: min(hs) for s, hs in groups.items()}
    listed = sorted((n, s) for s, n in names.items())
    pairs = {(a, b, len(s & t)) for a, s in listed for b, t in listed if a < b and len(s & t) / len(s | t) >= share - 1e-9}
    return pairs, {(names[s], h) for s, hs in groups.items() for h in hs}


@pytest.mark.parametrize(("share", "part"), [(0.3, 3), (0.5, 500), (0.8, 2), (1.0, 500)])
def test_similar_hosts_are_those_of_all_pairs(spark, share, part):
    rng = np.random.default_rng(8)
    edges = [(f"h{h}", f"t{t}") for h in range(90) for t in rng.choice(14, int(rng.integers(1, 8)), replace=False)]
    edges += [(f"h{h}", "hot") for h in range(120)] + [(None, "t1"), ("h1", None), ("h2", "hot")]
    df = spark.createDataFrame(edges, "host string, target string").repartition(3)
    pairs, members = colinks.similar(df, share, part=part)
    found = pairs.collect()
    want = plainly(edges, share)
    assert len(found) == len(want[0]) and {(r.a, r.b, r.common) for r in found} == want[0]
    assert {tuple(r) for r in members.select("class", "host").collect()} == want[1]


def test_a_hot_target_pairs_nothing_that_cannot_be_similar(spark):
    """Two thousand hosts share one target and have one of their own: no pair of kinds is left to meet."""
    edges = spark.range(2000).select(F.col("id").alias("host"), F.explode(F.array(F.lit("hot"), F.col("id").cast("string"))).alias("target"))
    pairs, members = colinks.similar(edges, 0.5)
    assert pairs.count() == 0 and members.count() == 2000
    # Equal sets are one class, not two million pairs.
    pairs, members = colinks.similar(edges.where("target = 'hot'"), 0.5)
    assert pairs.count() == 0 and members.select("class").distinct().count() == 1


def test_no_edges(spark):
    pairs, members = colinks.similar(spark.createDataFrame([], "host string, target string"), 0.5)
    assert pairs.count() == 0 and members.count() == 0


def test_sketches_merge_and_intersect_within_their_bounds(spark):
    rows = spark.range(200_000).select((F.col("id") % 7).alias("day"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"), (F.col("id") % 60_000).alias("key"), (F.col("id") % 1000).cast("double").alias("value"))
    kept = sketches.stored(rows, [F.col("day"), F.col("kind")], "key", "value").cache()
    assert kept.count() == 14
    whole = sketches.merged(kept).select("n", sketches.distinct(F.col("keys")), sketches.quantile(F.col("held"), 0.25), sketches.rank(F.col("held"), F.lit(500.0))).first()
    assert whole[0] == 200_000 and abs(whole[1] / 60_000 - 1) < 4 * sketches.THETA_ERROR
    assert abs(whole[2] / 1000 - 0.25) < 2 * sketches.RANK_ERROR and abs(whole[3] - 0.501) < 2 * sketches.RANK_ERROR
    kinds = {r.kind: r for r in sketches.merged(kept, ["kind"]).collect()}
    two = sketches.merged(kept.where("day < 3"), ["kind"]).groupBy().pivot("kind", ["a", "b"]).agg(F.first("keys"))
    exact = rows.where("day < 3").groupBy("key").agg(F.max((F.col("kind") == "a").cast("int")).alias("a"), F.max((F.col("kind") == "b").cast("int")).alias("b")).agg(F.sum(F.col("a") * F.col("b")), F.sum(F.col("a") * (1 - F.col("b")))).first()
    got = two.select(sketches.shared(F.col("a"), F.col("b")), sketches.only(F.col("a"), F.col("b"))).first()
    size = 60_000
    assert len(kinds) == 2 and all(abs(g - e) < 5 * sketches.THETA_ERROR * size for g, e in zip(got, exact, strict=True))


def test_nulls_and_nans_are_left_out(spark):
    df = spark.createDataFrame([("x", 1, 1.0), ("x", None, None), ("x", 1, float("nan")), ("y", None, None)], "g string, k bigint, v double")
    found = {r[0]: r[1:] for r in sketches.stored(df, [F.col("g")], "k", "v").select("g", "n", sketches.distinct(F.col("keys")), F.kll_sketch_get_n_double("held")).collect()}
    assert found == {"x": (3, 1, 1), "y": (1, 0, 0)}


def test_event_counts_are_exact_beyond_what_a_sketch_keeps(spark, tmp_path):
    """30,000 users, where a theta sketch keeps 4,096; null users, types and values among them."""
    import duckdb

    from docquarry.plans import ORACLE_SQL, QUERIES

    at = f"{tmp_path}/events.parquet"
    made = f"SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i % 90000) SECOND AS ts, CASE WHEN i % 997 > 0 THEN (i * 7919) % 30000 END AS user_id, CASE WHEN i % 1009 > 0 THEN ['a', 'b', 'c'][1 + (i // 7) % 3] END AS event_type, CASE WHEN i % 13 > 0 THEN (i % 9973)::DOUBLE END AS value FROM range(200000) t(i)"
    duckdb.sql(f"COPY ({made}) TO '{at}'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{at}'")
    found = QUERIES["events_sketches"](spark, str(tmp_path))
    want = con.execute(ORACLE_SQL["events_sketches"])
    assert found.columns == [c[0] for c in want.description]
    assert [tuple(r) for r in found.collect()] == want.fetchall()


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_exact_quantiles_equal_sorted_values(spark, share):
    rng = np.random.default_rng(5)
    rows = [("wide", float(x)) for x in rng.normal(size=3001)] + [("ties", float(x)) for x in rng.integers(0, 4, 2000)]
    rows += [("one", 5.0), ("two", 1.0), ("two", 2.0), ("two", None), ("none", None), (None, 3.0), (None, 4.0), (None, 9.0), ("same", 7.0), ("same", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r.quantile for r in sketches.exact_quantile(df, "g", "v", share).collect()}
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", share).alias("q")).collect()}
    assert got == want


def test_no_part_of_a_flag_carries_sketches_or_every_price(spark):
    """A distinct count in one aggregate with the sketches doubles the rows and keeps all of them for every key; ``percentile`` holds each value of a group."""
    from docquarry.plans import QUERIES

    found = QUERIES["table_sketches"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "percentile(" not in plan
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n"), F.percentile("l_extendedprice", 0.5).alias("m"))
    assert {r.l_returnflag: (r.exact, r.exact_median) for r in found.collect()} == {r.l_returnflag: (r.n, r.m) for r in rows.collect()}
