"""Exact dedup by block names, against a plain grouping of the normalised texts."""

from __future__ import annotations

import hashlib
import re

import pytest

from docquarry.llm import blocknames


def plainly(rows: list[tuple]) -> list[tuple]:
    """(id, keep, size, kept, digest) by a dictionary; repeated rows share one kept row."""
    groups: dict[str, list] = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for plain, held in groups.items():
        held.sort(key=lambda x: x[:3])
        digest = hashlib.sha256(plain.encode()).hexdigest()
        out += [(x[3], held[0][3], len(held), i == 0, digest) for i, x in enumerate(held)]
    return sorted(out, key=repr)


def made(df, **options) -> list[tuple]:
    return sorted((tuple(x) for x in blocknames.report(df, **options).collect()), key=repr)


def cases() -> list[tuple]:
    block = "abcdefgh"
    texts = [None, "", " \t\n\x0b\x0c\r", "one", "o n e", "one ", "one", "ä😀", "ä 😀 ", block * 3, block * 3 + "x", block * 4, block, block * 2, " " + block * 3, "x" + block * 3, block * 60, block * 60 + "y", block * 60, "\x00", "\x00\x00"]
    rows = list(enumerate(texts))
    return [*rows, (3, "one"), (None, "one"), (None, "no id"), (-5, "one"), (-5, "o  n  e")]


@pytest.mark.parametrize("block_bytes", [8, 2048])
def test_equals_a_plain_grouping(spark, block_bytes):
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = [tuple(x) for x in blocknames.groups(df, block_bytes=block_bytes).selectExpr("row.c0", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(found, key=repr) == plainly(rows)


def test_names_are_equal_for_equal_texts_alone(spark):
    df = spark.createDataFrame(cases(), "doc_id bigint, text string").repartition(5)
    found = blocknames.groups(df, block_bytes=4).select("name", "text_sha256").distinct().collect()
    assert len({x[0] for x in found}) == len({x[1] for x in found}) == len(found)


def test_whole_table_equals_a_plain_grouping(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert made(df) == plainly([tuple(x) for x in df.select("doc_id", "text").collect()])


def test_hot_group_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(blocknames, "CHUNK_BYTES", 500)
    rows = [(i, "the same text in many rows" if i % 3 == 0 else f"text {i // 2}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert made(df) == plainly(rows)


def test_kept_rows_carry_every_column_whatever_its_name(spark):
    rows = [(1, "a b", 7, "x", None), (2, "ab", 8, None, [1]), (3, None, 9, "z", [2])]
    df = spark.createDataFrame(rows, "name bigint, text string, chunk int, row string, c0 array<int>")
    kept = blocknames.drop_copies(df, id_col="name")
    assert kept.columns == df.columns
    assert sorted(tuple(x) for x in kept.collect()) == [rows[0], rows[2]]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert made(df) == [] and blocknames.drop_copies(df).count() == 0
