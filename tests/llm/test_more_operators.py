"""Sequences with texts and media, terms that disclose, sanitised texts, stripes that are skipped, ids of any name."""

from __future__ import annotations

import glob
import re

import pytest
from pyspark.sql import functions as F

from docquarry.llm import media, nearsets, pii, tokenfile


def test_texts_and_media_keep_their_places(spark, tmp_path):
    rows = spark.createDataFrame([(0, b"one"), (1, b"two"), (2, b"one")], "n bigint, raw binary").withColumn("payload", media.padded(F.col("raw")))
    media.store(rows, f"file://{tmp_path}/m")
    at = {r.n: r.a for r in rows.select("n", media.address(F.col("payload")).alias("a")).collect()}
    page = f"<h1>Title</h1><p>first <img src='{at[0]}' alt='alt'> second</p><figure><img src='{at[1]}'><img src='{at[2]}'><figcaption>both</figcaption></figure><p>between</p><img src='sha256:gone'><p>last</p>"
    pages = spark.createDataFrame([(7, page), (8, None), (9, "<p>no media</p>")], "page_id bigint, html string")
    sequences = pages.select("page_id", media.parse(F.col("html")).alias("elements"))
    found = media.resolve(sequences, media.features(media.load(spark, f"file://{tmp_path}/m")), keys=["page_id"], texts=True).collect()
    got = [(r.position, r.kind, r.text, r.caption, r.payload_bytes) for r in sorted(found, key=lambda r: r.position) if r.page_id == 7]
    assert [x[0] for x in got] == list(range(len(got)))
    assert [x[2] if x[1] == "text" else (x[3], x[4]) for x in got] == ["Title", "first", ("alt", 64), "second", ("both", 64), ("both", 64), "between", (None, None), "last"]
    assert [(r.text, r.media) for r in found if r.page_id == 9] == [("no media", None)]


def test_every_element_of_stored_pages_is_there(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    sequences = pages.select("page_id", media.parse(F.col("html")).alias("elements")).cache()
    nothing = spark.createDataFrame([], "media string, payload_bytes bigint")
    found = media.resolve(sequences, nothing, keys=["page_id"], texts=True)
    want = sequences.select("page_id", F.inline("elements")).select("page_id", "position", "kind", "text")
    assert found.count() == want.count() > 500
    assert sorted(map(str, found.select("page_id", "position", "kind", "text").collect())) == sorted(map(str, want.collect()))


def people(spark):
    """Sixty letters: a word that stands beside addresses alone, one beside half of them and elsewhere, and common ones."""
    rows = []
    for i in range(60):
        common = "we write about the plan and the report of the week"
        if i < 20:
            text = f"{common}. zentralpostfach: person{i}@mail{i}.example, reachable today. {common}"
        elif i == 20:
            text = f"{common}, please use the Zentralpostfach for that."
        elif i < 40:
            text = f"{common}. today is fine, reachable or not. {common}"
        else:
            text = f"{common}."
        rows.append((i, text))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), dict(rows)


def test_terms_that_disclose_are_found_and_common_ones_are_not(spark):
    docs, texts = people(spark)
    found = {r.doc_id: r.spans for r in pii.detect(docs).collect()}
    want = {(i, m.start(), m.end()) for i, t in texts.items() for m in re.finditer("(?i)zentralpostfach", t)}
    got = {(i, s["start"], s["end"]) for i, spans in found.items() for s in spans if s["kind"] == "term"}
    # ``reachable`` and ``today`` stand in half of the other letters too; the parts of the addresses differ in each.
    assert len(want & got) / len(want) >= 0.9 and len(want & got) / len(got) >= 0.9
    assert sum(s["kind"] == "email" for spans in found.values() for s in spans) == 20
    assert not [s for r in pii.detect(docs, support=21).collect() for s in r.spans if s["kind"] == "term"]


def test_sanitised_texts_keep_what_is_no_span(spark):
    docs, texts = people(spark)
    marked = docs.join(pii.detect(docs).select("doc_id", "spans"), "doc_id")
    for r in marked.select("doc_id", pii.sanitise(F.col("text"), F.col("spans")).alias("t")).collect():
        want = re.sub(r"(?i)zentralpostfach", "[term]", re.sub(r"person\d+@mail\d+\.example", "[email]", texts[r.doc_id]))
        assert r.t == want
    odd = spark.createDataFrame([("ä 😀 a@b.example 10.0.0.1", [("email", 4, 15, ""), ("ip", 16, 24, "")]), ("abcdef", [("a", 1, 4, ""), ("b", 1, 3, ""), ("c", 3, 5, "")]), ("", []), (None, [])], "t string, s array<struct<kind:string,start:int,end:int,match:string>>")
    assert [r[0] for r in odd.select(pii.sanitise(F.col("t"), F.col("s"))).collect()] == ["ä 😀 [email] [ip]", "a[a]ef", "", None]


def test_a_filter_on_ids_reaches_the_stripes(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    tokenfile.write(docs, path)
    plan = spark.read.orc(path).where("doc_id = 4711")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,4711)" in plan.split("PushedFilters")[1]
    import pyarrow.orc as orc

    files = sorted(glob.glob(f"{tmp_path}/t/*.orc"))
    ranges = sorted((min(ids), max(ids)) for f in files for ids in [orc.ORCFile(f).read(columns=["doc_id"]).column(0).to_pylist()] if ids)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert tokenfile.read(spark, path).where("doc_id = 4711").count() == 1
    # Several row groups in a file, and a Bloom filter on the id, are asked for of the writer.
    assert tokenfile.INDEX_ROWS < 6000


@pytest.mark.parametrize("name", ["s", "own", "group", "root", "_later"])
def test_near_duplicates_under_any_id_name(spark, name):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, "other words stand here")], f"`{name}` bigint, text string")
    kept = nearsets.keep_one(df, id_col=name)
    assert kept.columns == df.columns and sorted(r[0] for r in kept.collect()) == [1, 3]
