"""Structure: elements, chunks and outlines of documents and pages.

Every operator is a projection and an explode, without a shuffle, but for
``outline``, which orders the headings of each page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import html as H
from docquarry.functions import text as T


def _numbered(df: DataFrame, keys: list[str], items: Column, name: str) -> DataFrame:
    return df.select(*keys, F.posexplode(items).alias("pos", name)).withColumn("pos", F.col("pos").cast("bigint"))


def lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, line); positions from 0. Null texts give no rows."""
    return _numbered(df, [id_col], T.lines(F.col(text_col)), "line")


def sentences(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _numbered(df, [id_col], T.sentences(F.col(text_col)), "sentence")


def tokens(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, term)."""
    return _numbered(df, [id_col], T.tokens(F.col(text_col)), "term")


def ngrams(df: DataFrame, n: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    words = df.select(id_col, T.tokens(F.col(text_col)).alias("w"))
    return _numbered(words, [id_col], T.ngrams(F.col("w"), n), "ngram")


def blocks(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, kind, text) of paragraphs, list items and headings in order."""
    found = _numbered(pages, [id_col], H.blocks(F.col(html_col)), "b")
    return found.select(id_col, "pos", "b.kind", "b.text")


def links(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, href)."""
    return _numbered(pages, [id_col], H.links(F.col(html_col)), "href")


def table_cells(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, row, cell, text) of all tables of a page, rows numbered through the page."""
    rows = pages.select(id_col, F.posexplode(H.table_rows(F.col(html_col))).alias("row", "cells"))
    return rows.select(id_col, "row", F.posexplode("cells").alias("cell", "text"))


def outline(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, level, text, parent): ``parent`` is the position of the last heading of a lower level, null at the top."""
    heads = pages.select(id_col, F.posexplode(H.headings(F.col(html_col))).alias("pos", "h")).select(id_col, "pos", "h.level", "h.text")
    before = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    # Six running maxima, one for each level, instead of a list of all headings before.
    last = [F.when(F.col("level") > k, F.max(F.when(F.col("level") == k, F.col("pos"))).over(before)) for k in range(1, 7)]
    return heads.select("*", F.greatest(*last).alias("parent"))


def chunk_tokens(df: DataFrame, size: int, stride: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_no, start_tok, n_tok, text): windows of ``size`` tokens at steps of ``stride``."""
    words = df.select(id_col, T.tokens(F.col(text_col)).alias("w"))
    numbered = words.select(id_col, "w", F.explode(T.windows(F.size("w"), size, stride)).alias("n"))
    part = F.slice("w", F.col("n") * stride + 1, size)
    return numbered.select(id_col, F.col("n").cast("bigint").alias("chunk_no"), (F.col("n") * stride).cast("bigint").alias("start_tok"), F.size(part).cast("bigint").alias("n_tok"), F.array_join(part, " ").alias("text"))


def chunk_chars(df: DataFrame, size: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_no, start, length, text): consecutive spans of ``size`` code points; ``start`` counts from 1."""
    numbered = df.select(id_col, F.col(text_col).alias("_t"), F.explode(T.windows(F.length(text_col), size, size)).alias("n"))
    part = F.substring(F.col("_t"), F.col("n") * size + 1, F.lit(size))
    return numbered.select(id_col, F.col("n").cast("bigint").alias("chunk_no"), (F.col("n") * size + 1).cast("bigint").alias("start"), F.length(part).cast("bigint").alias("length"), part.alias("text"))
