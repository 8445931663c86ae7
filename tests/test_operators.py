"""Small hand-built inputs: nulls, ties, astral characters, late events, trees and chains."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from docquarry.operators import evidence, relational, relations, retrieval, search, structure
from docquarry.sources import tables
from docquarry.streaming import events as stream


def test_outline_finds_parents(spark):
    pages = spark.createDataFrame([(1, "<h1>A</h1><h2>B</h2><h3>C</h3><h2>D</h2><h1>E</h1>"), (2, None)], "page_id bigint, html string")
    rows = {r["text"]: r["parent"] for r in structure.outline(pages).collect()}
    assert rows == {"A": None, "B": 0, "C": 1, "D": 0, "E": None}


def test_table_cells(spark):
    pages = spark.createDataFrame([(1, "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td><b>2</b></td></tr></table>")], "page_id bigint, html string")
    assert [(r["row"], r["cell"], r["text"]) for r in structure.table_cells(pages).collect()] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "1"), (1, 1, "2")]


def test_spans_count_code_points(spark):
    docs = spark.createDataFrame([(1, "😀a big red house here", "x"), (2, None, "x"), (3, "", "y")], "doc_id bigint, text string, source string")
    wanted = spark.createDataFrame([(7, "big red house"), (8, "red"), (9, None)], "item_id bigint, quote string")
    found = evidence.quotes(docs, wanted)
    assert sorted((r["doc_id"], r["item_id"], r["start"], r["length"]) for r in found.collect()) == [(1, 7, 4, 13), (1, 8, 8, 3)]
    assert {r["quote"] for r in evidence.records(docs, found).collect()} == {"big red house", "red"}


def test_ties_of_a_search_go_to_the_smaller_id(spark):
    docs = spark.createDataFrame([(2, "cat dog"), (1, "cat dog"), (3, "bird"), (4, None)], "doc_id bigint, text string")
    assert [r["doc_id"] for r in search.top(search.bm25(docs, ["cat"]), 5).orderBy("rank").collect()] == [1, 2]


def test_nearest_in_blocks_equals_one_block(spark):
    rows = spark.range(200).select(F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * k).cast("float") for k in range(1, 9))).alias("embedding"))
    queries = rows.where("vec_id % 20 = 0")
    one = sorted(map(tuple, retrieval.nearest(queries, rows, 5).select("query_id", "vec_id", "rank").collect()))
    assert one == sorted(map(tuple, retrieval.nearest(queries, rows, 5, block=3).select("query_id", "vec_id", "rank").collect()))


def test_asof_takes_the_latest_row(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), (None, 3)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 6, 60), (None, 1, 70), ("b", None, 80)], "k string, t int, v int")
    got = relational.asof(left, right, ["k"], "t", value_cols=["v"]).collect()
    assert {tuple(r) for r in got} == {("a", 5, 50), ("a", 1, None), ("b", 9, None), (None, 3, None)} and len(got) == 4


def test_page_rank_sums_to_one(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (1, 5)], "src bigint, dst bigint")
    ranks = {r["node"]: r["rank"] for r in relations.page_rank(edges).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9
    assert min(ranks, key=ranks.get) == 4
    assert {r["node"]: r["hop"] for r in relations.reachable(edges, 1, 2).collect()} == {1: 0, 2: 1, 5: 1, 3: 2}


def test_stream_equals_batch_and_drops_late_events(spark, tmp_path):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    parts = [[(1, at(0, 5), 1, 1.0), (2, at(0, 40), 1, 2.0)], [(3, at(5), 2, 4.0)], [(4, at(0, 10), 1, 8.0), (3, at(5), 2, 4.0)]]
    schema = "event_id bigint, ts timestamp, user_id bigint, value double"
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = stream.windowed(stream.unique(stream.timed(tables.stream(spark, str(tmp_path / "in"), schema), late="1 hour")), "1 hour").writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True) if k == len(parts) - 1 else None
    run = query.start()
    run.processAllAvailable()
    run.awaitTermination(60)
    done = {(r["start"], r["n"], r["total"]) for r in spark.table("out").collect()}
    assert (at(5), 2, 8.0) not in done  # the repeated event counts once
    assert all(start <= at(5) for start, _, _ in done)


def test_links_are_resolved_against_their_page(spark):
    html = '<a href="/b">x</a><a href="c?q=1">y</a><a href="#top">z</a><a href="//o.net/p">o</a><a href="http://a.org/x/c">abs</a><a href="mailto:m@n">m</a>'
    pages = spark.createDataFrame([(1, "http://a.org/x/a?k=v", html), (2, "http://a.org/b", ""), (3, "http://a.org/x/c", None), (4, None, '<a href="/b">x</a>')], "page_id bigint, url string, html string")
    got = {(r["src"], r["pos"]): (r["target"], r["dst"]) for r in relations.link_edges(pages).collect()}
    assert got[1, 0] == ("http://a.org/b", 2) and got[1, 1] == ("http://a.org/x/c?q=1", 3) and got[1, 2] == ("http://a.org/x/a#top", 1)
    assert got[1, 3] == ("http://o.net/p", None) and got[1, 4] == ("http://a.org/x/c", 3) and got[1, 5] == ("mailto:m@n", None) and got[4, 0] == (None, None)
    hosts = {(r["host"], r["href_host"]): (r["n_links"], r["n_pages"]) for r in relations.host_links(pages).collect()}
    assert hosts == {("a.org", "a.org"): (4, 1), ("a.org", "o.net"): (1, 1)}


def test_names_beyond_ascii_are_mentioned(spark):
    docs = spark.createDataFrame([(1, "Éva Çelik met Anna Berg, and xÉva Nobody"), (2, "Anna Berg saw Éva Çelik"), (3, None)], "doc_id bigint, text string")
    got = {(r["a"], r["b"]): r["n_docs"] for r in relations.cooccurrence(relations.mentions(docs)).collect()}
    assert got == {("Anna Berg", "Éva Çelik"): 2}


def test_passages_carry_spans_that_hold_the_quote(spark):
    docs = spark.createDataFrame([(1, "filler " * 20 + "the falcon landed 😀 here"), (2, "a falcon"), (3, None), (4, "")], "doc_id bigint, text string")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = evidence.support(docs, ["falcon", "landed"], 5, size=40).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [1, 2] and "falcon landed 😀" in got[0]["quote"]
    assert all(texts[r["doc_id"]][r["start"] - 1 :][: r["length"]] == r["quote"] for r in got)


def test_scores_are_fused_and_lists_diversified(spark):
    a = spark.createDataFrame([(1, 4.0), (2, 2.0), (3, 0.0)], "doc_id bigint, score double")
    b = spark.createDataFrame([(2, 7.0), (4, 7.0)], "doc_id bigint, score double")
    got = {r["doc_id"]: r["score"] for r in retrieval.score_fusion([(a, 0.5), (b, 2.0)]).collect()}
    assert got == {1: 0.5, 2: 2.25, 3: 0.0, 4: 2.0}
    rows = [(9, 1, 1.0, [1.0, 0.0]), (9, 2, 0.9, [1.0, 0.01]), (9, 3, 0.5, [0.0, 1.0])]
    picked = retrieval.diversified(spark.createDataFrame(rows, "query_id bigint, doc_id bigint, score double, embedding array<float>"), 2)
    assert [r["doc_id"] for r in picked.orderBy("rank").collect()] == [1, 3]


def test_field_scores_add_up(spark):
    docs = spark.createDataFrame([(1, "cat", "dog"), (2, "bird", "cat cat"), (3, None, None)], "doc_id bigint, title string, body string")
    whole = {r["doc_id"]: r["score"] for r in search.field_score(docs, ["cat"], {"title": 2.0, "body": 1.0}).collect()}
    title = {r["doc_id"]: r["score"] for r in search.bm25(docs, ["cat"], text_col="title").collect()}
    body = {r["doc_id"]: r["score"] for r in search.bm25(docs, ["cat"], text_col="body").collect()}
    assert whole == {1: 2 * title[1], 2: body[2]}
