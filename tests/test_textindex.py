"""The stored index: coding, equality with the exhaustive search, skipping, growth and merging."""

from __future__ import annotations

import numpy as np
import pytest

from docquarry.operators import search, textindex

SF = "/root/testdata/sf0.01"
TERMS = ["tion", "ing", "thatin", "ononst", "the"]


def test_numbers_survive_coding():
    rng = np.random.default_rng(1)
    for size in (0, 1, 7, 1000):
        v = np.where(rng.random(size) < 0.5, rng.integers(0, 128, size), rng.integers(0, 1 << 62, size))
        assert textindex.unpacked(textindex.packed(v)[0]).tolist() == v.tolist()
    edge = np.array([0, 127, 128, 16383, 16384, (1 << 63) - 1])
    assert textindex.unpacked(textindex.packed(edge)[0]).tolist() == edge.tolist()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(6).cache()


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    made = textindex.Index(spark, f"file://{tmp_path_factory.mktemp('index')}")
    made.append(docs)
    return made


def scores(df) -> dict:
    return {r[0]: r[1] for r in df.collect()}


def test_all_scores_equal_the_exhaustive_search(docs, index):
    want, got = scores(search.bm25(docs, TERMS)), scores(index.bm25(TERMS))
    assert want.keys() == got.keys() and all(abs(want[d] - got[d]) < 1e-9 for d in want)


@pytest.mark.parametrize(("k", "first_shards"), [(1, 1), (25, 2), (5000, 16)])
def test_top_equals_the_exhaustive_search(docs, index, k, first_shards):
    for terms in (["tion"], TERMS):
        want = [(r.doc_id, r.rank) for r in search.top(search.bm25(docs, terms), k).collect()]
        got = [(r.doc_id, r.rank) for r in index.top(terms, k, first_shards=first_shards).collect()]
        assert sorted(got, key=lambda x: x[1]) == sorted(want, key=lambda x: x[1])


def test_only_the_terms_folders_are_opened(index):
    every = {r[0] for r in index._postings().selectExpr("input_file_name()").distinct().collect()}
    opened = {r[0] for r in index._postings(["thatin", "ononst"]).selectExpr("input_file_name()").distinct().collect()}
    assert len(opened) <= 2 and len(opened) < len(every) / 8
    plan = index._postings(["thatin"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "[bucket").replace("[[", "[") or "bucket" in plan.split("PartitionFilters")[1]
    assert "ids" not in index.blocks(["thatin"])._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_blocks_below_the_threshold_are_not_decoded():
    """One rare term in few documents, one in all: beyond the rare ones' blocks none of the frequent term's is needed."""
    ids = np.arange(128 * 200)
    columns = ["block", "n", "first", "last", "max_tf", "min_dl", "ids", "tfs", "dls"]

    def rows(term, ids, tfs, dls):
        return [dict(zip(columns, x[1:], strict=True)) | {"term": term} for x in textindex._blocks(np.zeros_like(ids), ids, tfs, dls)]

    frequent = rows("often", ids, np.ones_like(ids), np.full_like(ids, 100))
    rare = rows("rare", np.array([5, 6, 7]), np.array([3, 2, 4]), np.full(3, 50))
    found, decoded = textindex.best_of_shard([*frequent, *rare], {"often": 0.1, "rare": 5.0}, 80.0, 1.2, 0.75, 3, -np.inf)
    assert [d for d, _ in found] == [7, 5, 6] and decoded == 2


def test_growth_and_merge_change_nothing(spark, docs, tmp_path):
    index = textindex.Index(spark, f"file://{tmp_path}/grown")
    for part in range(3):
        index.append(docs.where(docs.doc_id % 3 == part))
    want = scores(search.bm25(docs, TERMS))
    best = [r.doc_id for r in search.top(search.bm25(docs, TERMS), 25).orderBy("rank").collect()]

    def same():
        got = scores(index.bm25(TERMS))
        assert want.keys() == got.keys() and all(abs(want[d] - got[d]) < 1e-9 for d in want)
        assert [r.doc_id for r in index.top(TERMS, 25).orderBy("rank").collect()] == best

    same()
    before = index.blocks().count()
    assert index.merge() == 3 and index._generations() == [3]
    assert index.blocks().count() < before
    same()
    index.append(spark.createDataFrame([(10**9, "thatin newcomer"), (10**9 + 1, None)], "doc_id bigint, text string"))
    assert [r.doc_id for r in index.top(["newcomer"], 2).collect()] == [10**9]
    assert 10**9 in scores(index.bm25(["thatin"]))
    assert index._generations() == [3, 4]


def test_an_append_that_failed_is_not_seen(spark, docs, tmp_path):
    index = textindex.Index(spark, f"file://{tmp_path}/failed")
    index.append(docs.limit(50))
    index._write(1, index._built(docs, 1, "doc_id", "text"))  # postings without totals
    assert index._generations() == [0]
    assert index.dictionary(["the"]).first().df <= 50


def test_odd_documents(spark, tmp_path):
    index = textindex.Index(spark, f"file://{tmp_path}/odd")
    assert index.top(["a"], 3).count() == 0 and index.bm25(["a"]).count() == 0
    rows = [(1, None, 1), (2, "", 2), (-3, "a b a", 3), (4, "A", 4), (None, "a", 5), (5, "ä ß 9", 6), (6, "word " * 20000 + "a", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, term int")
    index.append(df)
    want = scores(search.bm25(df.where("doc_id is not null"), ["a", "missing"]))
    assert scores(index.bm25(["a", "missing"])) == pytest.approx(want)
    assert index.top(["missing"], 3).count() == 0
    with pytest.raises(ValueError):
        index.top([], 3)
    empty = textindex.Index(spark, f"file://{tmp_path}/empty")
    empty.append(spark.createDataFrame([], "doc_id bigint, text string"))
    assert empty.top(["a"], 3).count() == 0


def test_more_like_equals_the_exhaustive_search(docs, index):
    text = docs.where("doc_id = 7").first().text
    want, got = scores(search.more_like(docs, 7, 5)), scores(index.more_like(text, 5, apart=7))
    assert want.keys() == got.keys() and all(abs(want[d] - got[d]) < 1e-9 for d in want)


def test_a_shard_is_counted_in_arrays(monkeypatch):
    """A full shard of a million postings stays below 250 MB beyond what it holds before; lists of Python integers and words took more."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(200_000)])
    batch = lambda: pa.array([words[rng.integers(0, len(words), 250)] for _ in range(256)])
    given = [batch() for _ in range(16)]
    tracemalloc.start()
    shard = textindex._Shard()
    for k, x in enumerate(given):
        shard.add(pa.array(range(256 * k, 256 * k + 256)), x)
    names, columns = shard.blocks()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert shard.docs == 4096 and sum(columns[1].to_pylist()) == shard.postings and len(set(names.to_pylist())) == len({t for x in given for d in x.to_pylist() for t in d})
    assert peak < 250 << 20


def test_merging_decodes_many_blocks_at_once(spark, docs, tmp_path, monkeypatch):
    """Batches of three rows, so that lists of a term go on over several of them."""
    index = textindex.Index(spark, f"file://{tmp_path}/small")
    for part in range(2):
        index.append(docs.where(docs.doc_id % 2 == part))
    want = {tuple(r) for r in index.dictionary().collect()}
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        index.merge()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    assert {tuple(r) for r in index.dictionary().collect()} == want
    got, same = scores(index.bm25(TERMS)), scores(search.bm25(docs, TERMS))
    assert got.keys() == same.keys() and all(abs(same[d] - got[d]) < 1e-9 for d in got)
    assert index.blocks().where("n > 128 or first > last").count() == 0


def test_totals_come_from_the_shards(spark, docs, tmp_path):
    index = textindex.Index(spark, f"file://{tmp_path}/totals")
    index.append(docs)
    words = docs.selectExpr("size(filter(split(lower(text), '[^\\\\p{L}\\\\p{N}]+'), x -> x != '')) AS n").groupBy().sum("n").first()[0]
    assert tuple(index._totals().first()) == (docs.count(), words)
    assert index.blocks().where("term is null").count() == 0
