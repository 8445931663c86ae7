"""Retrieval: nearest vectors, fusion of rankings, diversification and retrieval metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators import search, structure, vectorindex

def nearest(queries: DataFrame, rows: DataFrame, k: int, *, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding", block: int = vectorindex.QUERY_ROWS) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best rows for each query, itself excluded; ties go to the smaller id.

    The stated query set meets all rows in blocks (of ``block`` queries), a matrix product for each pair of blocks, and of
    it only each query's best ``k`` are shuffled. ``metric``: ``cosine``, ``dot``, or ``l2``
    (negative distance). Rows without an id or a vector are left out; a zero vector has no cosine and is left out there.
    """
    if metric not in ("cosine", "dot", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    asked, held = (vectorindex.vectors(x, id_col, vector_col, metric) for x in (queries, rows))
    return vectorindex.ranked(vectorindex.exhaustive(asked, held, k, metric, block), k, id_col)


def rank_fusion(rankings: list[DataFrame], *, c: float = 60.0, id_col: str = "doc_id") -> DataFrame:
    """(id, score): sum of ``1 / (c + rank)`` over the rankings; an absent rank adds nothing."""
    parts = [r.select(id_col, (1 / (F.lit(c) + F.col("rank"))).alias("score")) for r in rankings]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(id_col).agg(F.sum("score").alias("score"))


def score_fusion(rankings: list[tuple[DataFrame, float]], *, id_col: str = "doc_id") -> DataFrame:
    """(id, score): weighted sum of scores scaled to 0 to 1 within each ranking; equal scores scale to 1."""
    parts = []
    for r, weight in rankings:
        limits = r.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))  # one row
        scaled = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
        parts.append(r.join(F.broadcast(limits)).select(id_col, (scaled * weight).alias("score")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(id_col).agg(F.sum("score").alias("score"))


def diversified(candidates: DataFrame, k: int, *, trade: float = 0.5, id_col: str = "doc_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, rank): maximal marginal relevance among each query's candidates.

    ``candidates`` has query_id, id, score and a vector and is a top list, so
    each group is small by its making.
    """

    def pick(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["score", id_col], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(pdf[vector_col].to_list()).astype(np.float64)
        v = v / np.maximum(np.sqrt((v**2).sum(1)), 1e-300)[:, None]
        chosen, left = [], list(range(len(pdf)))
        while left and len(chosen) < k:
            gains = [trade * pdf["score"][i] - (1 - trade) * (max(float(v[i] @ v[j]) for j in chosen) if chosen else 0.0) for i in left]
            chosen.append(left.pop(int(np.argmax(gains))))
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[chosen].to_numpy(), id_col: pdf[id_col].iloc[chosen].to_numpy(), "rank": range(1, len(chosen) + 1)})

    return candidates.groupBy("query_id").applyInPandas(pick, f"query_id bigint, `{id_col}` bigint, rank bigint")


def metrics(ranked: DataFrame, relevant: DataFrame, k: int, *, id_col: str = "doc_id") -> DataFrame:
    """One row per query with a relevant document: recall at k, reciprocal rank and nDCG at k.

    ``ranked`` has query_id, id and rank; ``relevant`` has query_id and id,
    all equally relevant.
    """
    wanted = relevant.select("query_id", id_col).distinct()
    hits = ranked.where(F.col("rank") <= k).join(wanted, ["query_id", id_col])
    return metrics_of(hits, wanted.groupBy("query_id").agg(F.count("*").alias("n")), k)


def metrics_of(hits: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """The same from the relevant rows (query_id, rank) among the best ``k`` and each query's number ``n`` of relevant ones, which need not be listed."""
    got = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return totals.join(got, "query_id", "left").select("query_id", zero(F.col("hits") / F.col("n")).alias("recall"), zero(1 / F.col("first")).alias("reciprocal_rank"), zero(F.col("dcg") / ideal).alias("ndcg"))


def label_purity(neighbours: DataFrame, labels: DataFrame, *, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """(query_id, purity): share of each query's neighbours that have its label."""
    own = labels.select(F.col(id_col).alias("query_id"), F.col(label_col).alias("own"))
    other = labels.select(F.col(id_col), F.col(label_col).alias("other"))
    joined = neighbours.join(own, "query_id").join(other, id_col)
    return joined.groupBy("query_id").agg(F.avg((F.col("own") == F.col("other")).cast("double")).alias("purity"))


def passages(df: DataFrame, terms: list[str], k: int, *, size: int = 500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_no, start, length, score, rank): the ``k`` best spans of ``size`` code points by BM25 over all spans.

    ``start`` counts from 1. Ties go to the smaller id and span; null and empty texts have no span with a term.
    """
    chunks = structure.chunk_chars(df, size, id_col=id_col, text_col=text_col)
    spans = chunks.select(F.struct(F.col(id_col).alias("id"), "chunk_no", "start", "length").alias("span"), F.col("text").alias("passage"))
    best = search.top(search.bm25(spans, terms, id_col="span", text_col="passage"), k, id_col="span")
    return best.select(F.col("span.id").alias(id_col), "span.chunk_no", "span.start", "span.length", "score", "rank")
