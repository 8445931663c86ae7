"""Evidence: quotes located in documents as exact spans, verified, recorded and corroborated.

Spans are code points counted from 1, as ``locate`` and ``substring`` count them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as T

#: Tokens of the anchor by which a quote's documents are found.
ANCHOR = 8
#: Different first tokens of anchors up to which they are looked up inside the row; beyond, all n-grams meet the anchors in a join.
HEADS = 10_000


def quotes(docs: DataFrame, wanted: DataFrame, *, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", quote_id: str = "item_id", quote_col: str = "quote") -> DataFrame:
    """(id, quote_id, start, length): the first place of every quote in every document that holds it verbatim.

    A document can only hold a quote if it holds each n-gram of the quote's
    tokens that lies inside; so documents and quotes meet on one n-gram of each
    quote, the second to ``anchor + 1``-th token (the first and last token may
    be cut from longer words), and only those pairs are verified. A quote that
    is too short for an anchor meets on its inner token, or is looked for in
    every document when it has none. ``wanted`` is a stated set of quotes.
    """
    q = wanted.select(quote_id, F.col(quote_col).alias("q"), T.tokens(F.col(quote_col)).alias("w")).where("q is not null and q <> ''")
    inner = F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))
    q = q.select(quote_id, "q", F.slice(inner, 1, anchor).alias("key"))
    words = docs.select(F.col(id_col), F.col(text_col).alias("_t"))
    lengths = {r[0] for r in q.select(F.size("key")).distinct().collect()}  # anchor + 1 at most
    begun = q.where(F.size("key") > 0).select(F.size("key"), F.get("key", F.lit(0))).distinct().limit(HEADS + 1).collect()
    few = len(begun) <= HEADS
    sizes = {n: sorted(h for m, h in begun if m == n) if few else None for n in lengths - {0}}

    def grams(w: Column) -> Column:
        """Of the n-grams of all lengths that are asked for, those that begin as an anchor does."""
        def of(n: int, heads: list[str] | None) -> Column:
            starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
            if heads is not None:
                starts = F.filter(starts, lambda i: F.get(w, i - 1).isin(*heads))
            return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

        return F.array_distinct(F.concat(*(of(n, heads) for n, heads in sorted(sizes.items()))))

    found = None
    if 0 in lengths:  # no inner token
        found = words.join(q.where(F.size("key") == 0).select(quote_id, "q"), F.contains(F.col("_t"), F.col("q")))
    if sizes:
        own = q.where(F.size("key") > 0).select(quote_id, "q", F.array_join("key", " ").alias("gram"))
        met = words.select("*", F.explode(T.bound(T.tokens(F.col("_t")), grams)).alias("gram")).join(own.select("gram", quote_id), "gram").select(id_col, quote_id)
        met = words.join(met, id_col).join(own.select(quote_id, "q"), quote_id)
        found = met if found is None else found.unionByName(met)
    if found is None:
        return words.limit(0).select(id_col, *(F.lit(None).cast(k).alias(c) for c, k in ((quote_id, wanted.schema[quote_id].dataType), ("start", "bigint"), ("length", "bigint"))))
    at = F.expr("locate(q, _t)")
    placed = found.withColumn("start", at.cast("bigint")).where("start > 0")
    return placed.select(id_col, quote_id, "start", F.length("q").cast("bigint").alias("length")).distinct()


def located(text: Column, quote: Column) -> Column:
    """struct<start, length> of the first place of a quote; null if the text lacks it."""
    at = F.call_function("locate", quote, text)
    return F.when(at > 0, F.struct(at.cast("bigint").alias("start"), F.length(quote).cast("bigint").alias("length")))


def verified(text: Column, start: Column, length: Column, quote: Column) -> Column:
    """Whether the span holds exactly the quote; null counts as not."""
    return F.coalesce(F.substring(text, start.cast("int"), length.cast("int")) == quote, F.lit(False))


def records(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Evidence records of (id, start, length) spans: id, source, span, quote, digest of the text, and an id made of these."""
    joined = spans.join(docs.select(id_col, F.col(text_col).alias("_t"), source_col), id_col)
    quote = F.substring(F.col("_t"), F.col("start").cast("int"), F.col("length").cast("int"))
    digest = T.content_hash(F.col("_t"))
    key = F.concat_ws(":", digest, F.col(id_col).cast("string"), F.col("start").cast("string"), F.col("length").cast("string"))
    return joined.select(F.md5(key.cast("binary")).alias("evidence_id"), id_col, source_col, "start", "length", quote.alias("quote"), digest.alias("content_hash"))


def corroboration(found: DataFrame, docs: DataFrame, *, quote_id: str = "item_id", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", independent: bool = False) -> DataFrame:
    """(quote_id, n_docs, n_sources): documents and sources that hold each quote.

    ``independent``: texts that are copies of one another count as one document,
    the one with the least id.
    """
    rows = docs.select(id_col, source_col, T.content_hash(F.col(text_col)).alias("h")).join(found.select(id_col, quote_id).distinct(), id_col)
    if independent:
        rows = rows.groupBy(quote_id, "h").agg(F.min(F.struct(id_col, source_col)).alias("r")).select(quote_id, "r.*")
    return rows.groupBy(quote_id).agg(F.count_distinct(id_col).alias("n_docs"), F.count_distinct(source_col).alias("n_sources"))


def version_diff(before: DataFrame, after: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, change): documents ``added``, ``removed`` or ``changed`` between two snapshots with unique ids."""
    own = lambda df, name: df.select(id_col, T.content_hash(F.coalesce(F.col(text_col), F.lit(""))).alias(name))
    both = own(before, "b").join(own(after, "a"), id_col, "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select(id_col, change.alias("change")).where("change is not null")


def support(df: DataFrame, claim: list[str], k: int, *, size: int = 500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, score, rank, quote): the ``k`` passages that speak most about a claim's terms, with their text."""
    from docquarry.operators import retrieval

    found = retrieval.passages(df, claim, k, size=size, id_col=id_col, text_col=text_col).drop("chunk_no")  # k rows
    texts = df.select(F.col(id_col), F.col(text_col).alias("_text")).join(F.broadcast(found), id_col)
    return texts.select(id_col, "start", "length", "score", "rank", F.substring(F.col("_text"), F.col("start").cast("int"), F.col("length").cast("int")).alias("quote"))
