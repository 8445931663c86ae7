"""The inverted file of vectors against an exhaustive search."""

from __future__ import annotations

import numpy as np
import pytest

from docquarry.operators import vectorindex


def exhaustive(rows, asked, k, metric):
    ids = np.array([i for i, v in rows if i is not None and v is not None and (metric == "l2" or any(v))])
    x = np.array([v for i, v in rows if i is not None and v is not None and (metric == "l2" or any(v))], dtype=np.float32).astype(float)
    out = {}
    for i, v in asked:
        v = np.array(v, dtype=np.float32).astype(float)
        s = x @ v / np.sqrt((x**2).sum(1) * (v**2).sum()) if metric == "cosine" else -np.sqrt(((x - v) ** 2).sum(1))
        out[i] = sorted((-round(float(b), 9), int(a)) for a, b in zip(ids, s, strict=True) if a != i)[:k]
    return out


def made(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((-round(r.score, 9), r.vec_id))
    return {q: sorted(x) for q, x in out.items()}


def table(seed=1, n=900):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(7, 8))
    rows = [(i, (centre[i % 7] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(n)]
    # A third of all rows share one vector; some have none, or a zero one, or no id.
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
    return [*rows, (n, None), (n + 1, [0.0] * 8), (None, rows[1][1]), (4, rows[4][1])]


SCHEMA = "vec_id bigint, embedding array<float>"


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_all_lists_give_the_exact_result(spark, tmp_path, metric):
    rows = table()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", list int, v int").repartition(5)
    index = vectorindex.VectorIndex.build(df, f"file://{tmp_path}/i", lists=9, metric=metric)
    asked = [(i, v) for i, v in rows if i is not None and i % 20 == 0 and v is not None]
    got = made(index.nearest(df.where("vec_id % 20 = 0"), 12, probes=9))
    assert got == exhaustive(rows, asked, 12, metric)


def test_few_probes_reach_most(spark, tmp_path):
    rows = table(2, 2000)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    index = vectorindex.VectorIndex.build(df, f"file://{tmp_path}/i", lists=12)
    asked = df.where("vec_id % 20 = 0")
    exact = index.nearest(asked, 10, probes=12).cache()
    n, reached = vectorindex.recall(index.nearest(asked, 10, probes=4), exact).first()
    assert n == 1000 and reached >= 0.9
    # Every row with a vector and an id is in the index.
    assert index.members().count() == 2001 and index.members().select("id").distinct().count() == 2000


def test_a_frequent_vector_is_one_entry(spark, tmp_path):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(500)] + [(500, [2.0, 1.0])], SCHEMA).repartition(4)
    index = vectorindex.VectorIndex.build(df, f"file://{tmp_path}/i", lists=4, max_k=20)
    entries = index.entries().collect()
    assert len(entries) == 2 and max(len(x.ids) for x in entries) == 21
    assert [r.vec_id for r in index.nearest(df.where("vec_id = 3"), 20, probes=4).orderBy("rank").collect()] == [x for x in range(21) if x != 3]
    with pytest.raises(ValueError):
        index.nearest(df, 21, probes=1)


def test_centroids_do_not_depend_on_order(spark):
    rows = table(3, 300)
    a, b = (vectorindex.centroids(spark.createDataFrame(r, SCHEMA).repartition(n), 5) for r, n in ((rows, 2), (rows[::-1], 7)))
    assert np.allclose(a, b) and len(a) == 5


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    index = vectorindex.VectorIndex.build(df, f"file://{tmp_path}/i", lists=4)
    assert index.nearest(df, 3, probes=2).count() == 0 and index.members().count() == 0
