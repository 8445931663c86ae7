"""Queries of search and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import evidence, fuzzy, retrieval, search, textindex, vectorindex
from docquarry.plans.documents import WORDS
from docquarry.plans.registry import ORACLE_SQL, query
from docquarry.sources import scratch
from docquarry.sources.tables import table

#: Terms of the ranked queries, and of the boolean, phrase and proximity ones.
TERMS = ["tion", "ing", "thatin", "ononst"]
PAIR = ("the", "of")
W = f"w AS (SELECT doc_id, source, lang, text, {WORDS} AS w FROM documents)"
_IN = ", ".join(f"'{t}'" for t in TERMS)
_TF = f"m AS (SELECT doc_id, len(w) AS dl, t AS term, len(list_filter(w, lambda x: x = t)) AS tf FROM w, (SELECT unnest([{_IN}]) AS t) WHERE list_contains(w, t)), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w), d AS (SELECT term, count(*) AS df FROM m GROUP BY term)"
BM25 = f"WITH {W}, {_TF}, b AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM m JOIN d USING (term), s GROUP BY doc_id)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("w"))


@query(f"SELECT t AS term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS cf FROM (SELECT doc_id, unnest({WORDS}) AS t FROM documents) GROUP BY t")
def search_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dictionary(_docs(spark, sf_dir))


@query(f"SELECT term, doc_id, count(*)::BIGINT AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS term FROM (SELECT doc_id, {WORDS} AS w FROM documents)) WHERE term IN ({_IN}) GROUP BY term, doc_id")
def search_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.postings(_docs(spark, sf_dir), TERMS)
    return found.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query(f"WITH {W} SELECT doc_id FROM w WHERE list_contains(w, 'the') AND list_has_any(w, ['thatin', 'ononst']) AND NOT list_contains(w, 'rewh')")
def search_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).where(search.boolean(F.col("w"), every=("the",), some=("thatin", "ononst"), none=("rewh",))).select("doc_id")


@query(f"WITH {W} SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i+1] = 'the'))::BIGINT AS n FROM w WHERE len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i+1] = 'the')) > 0")
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("doc_id", search.phrase(F.col("w"), ["of", "the"]).cast("bigint").alias("n")).where("n > 0")


@query(f"WITH {W}, p AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS t FROM w) SELECT a.doc_id, min(abs(a.pos - b.pos))::BIGINT AS distance FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.t = 'tion' AND b.t = 'ing' GROUP BY a.doc_id HAVING min(abs(a.pos - b.pos)) <= 20")
def search_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.proximity(_docs(spark, sf_dir), "tion", "ing", 20)


@query(f"SELECT t AS term, count(*)::BIGINT AS n FROM (SELECT unnest({WORDS}) AS t FROM documents) WHERE t LIKE 'than%' OR t LIKE '_ond%' OR regexp_full_match(t, 're.*wh') GROUP BY t")
def search_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("term"))
    t = F.col("term")
    return rows.where(t.startswith("than") | t.like("_ond%") | t.rlike("^re.*wh$")).groupBy("term").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE levenshtein(lower(p_name), 'smal rinng') <= 3")
def search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(search.fuzzy(F.col("p_name"), "smal rinng", 3)).select("p_partkey", "p_name")


@query("SELECT p_name, count(*)::BIGINT AS n FROM part WHERE lower(p_name) = 'red widget' GROUP BY p_name")
def search_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(T.folded(F.col("p_name")) == F.lit("RÉD WIDGET")).groupBy("p_name").agg(F.count("*").alias("n"))


@query(f"WITH {W}, {_TF} SELECT doc_id, round(sum(tf * ln(n / df)), 6) AS score FROM m JOIN d USING (term), s GROUP BY doc_id")
def search_tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.tf_idf(_docs(spark, sf_dir), TERMS).select("doc_id", F.round("score", 6).alias("score"))


@query(BM25 + " SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id)::BIGINT AS rank FROM b QUALIFY rank <= 20")
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 top 20."""
    best = search.top(search.bm25(_docs(spark, sf_dir), TERMS), 20)
    return best.select("doc_id", F.round("score", 6).alias("score"), "rank")


@query(BM25 + " SELECT doc_id, round(b.score, 6) AS score FROM b JOIN documents USING (doc_id) WHERE lang = 'en' AND n_chars > 2000")
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that the metadata filter keeps; statistics stay those of all documents."""
    docs = _docs(spark, sf_dir)
    kept = docs.where((F.col("lang") == "en") & (F.col("n_chars") > 2000)).select("doc_id")
    return search.bm25(docs, TERMS).join(kept, "doc_id", "left_semi").select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, substring(text, greatest(p - 20, 1), p - greatest(p - 20, 1) + 26) AS snippet FROM (SELECT doc_id, text, instr(lower(text), 'thatin') AS p FROM documents) WHERE p > 0")
def search_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", search.snippet(F.col("text"), "thatin", 20).alias("snippet")).where("snippet is not null")


@query(f"SELECT t AS term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS cf FROM (SELECT doc_id, unnest({WORDS}) AS t FROM documents) WHERE t LIKE 'th%' GROUP BY t ORDER BY df DESC, term LIMIT 10")
def search_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.suggest(_docs(spark, sf_dir), "th", 10)


PAIRS = "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 20 = 0), r AS (SELECT query_id, vec_id, embedding::DOUBLE[] AS b, a FROM q, embeddings WHERE query_id <> vec_id), "
COSINE = PAIRS + "t AS (SELECT query_id, vec_id, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS score FROM r) "
RANKED = "SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::BIGINT AS rank FROM t QUALIFY rank <= 10"


def _nearest(spark: SparkSession, sf_dir: str, metric: str = "cosine") -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return retrieval.nearest(rows.where(F.col("vec_id") % 20 == 0), rows, 10, metric=metric)


@query(COSINE + RANKED)
def retrieval_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(PAIRS + "t AS (SELECT query_id, vec_id, -list_distance(a, b) AS score FROM r) " + RANKED)
def retrieval_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "l2").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(COSINE + ", k AS (" + RANKED + ") SELECT query_id, round(avg(CASE WHEN e.label = o.label THEN 1.0 ELSE 0.0 END), 6) AS purity FROM k JOIN embeddings e ON e.vec_id = query_id JOIN embeddings o ON o.vec_id = k.vec_id GROUP BY query_id")
def retrieval_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return retrieval.label_purity(_nearest(spark, sf_dir), rows).select("query_id", F.round("purity", 6).alias("purity"))


@query(
    BM25
    + ", r1 AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 50), t AS (SELECT doc_id, len(list_filter(w, lambda x: x = 'thatin')) AS score FROM w), r2 AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM t WHERE score > 0 QUALIFY rank <= 50) SELECT doc_id, round(sum(1 / (60.0 + rank)), 6) AS score FROM (FROM r1 UNION ALL FROM r2) GROUP BY doc_id"
)
def retrieval_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal ranks of two top-50 lists, BM25 and plain counts of one term."""
    first = search.top(search.bm25(_docs(spark, sf_dir), TERMS), 50)
    counts = search.postings(_docs(spark, sf_dir), ["thatin"]).select("doc_id", F.col("tf").cast("double").alias("score"))
    return retrieval.rank_fusion([first, search.top(counts, 50)]).select("doc_id", F.round("score", 6).alias("score"))


@query(
    COSINE
    + ", k AS ("
    + RANKED
    + "), rel AS (SELECT query_id, e.vec_id FROM q JOIN embeddings o ON o.vec_id = query_id JOIN embeddings e ON e.label = o.label AND e.vec_id <> query_id), n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1), h AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM k JOIN rel USING (query_id, vec_id) GROUP BY 1) SELECT query_id, round(coalesce(hits / n, 0), 6) AS recall, round(coalesce(1 / first, 0), 6) AS reciprocal_rank, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg FROM n LEFT JOIN h USING (query_id)"
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a query's label count as relevant."""
    rows = table(spark, sf_dir, "embeddings")
    own = rows.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "label")
    # Rows of a label are counted, not paired with its queries; only neighbours are compared by label.
    totals = own.join(rows.groupBy("label").agg((F.count("*") - 1).alias("n")), "label").where("n > 0").select("query_id", "n")
    near = _nearest(spark, sf_dir).join(own, "query_id").join(rows.select("vec_id", F.col("label").alias("other")), "vec_id")
    found = retrieval.metrics_of(near.where(F.col("label") == F.col("other")).select("query_id", "rank"), totals, 10)
    return found.select("query_id", *(F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")))


@query(
    BM25
    + ", r1 AS (SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 50), r2 AS (SELECT doc_id, len(list_filter(w, lambda x: x = 'thatin'))::DOUBLE AS score FROM w WHERE list_contains(w, 'thatin') ORDER BY score DESC, doc_id LIMIT 50), s1 AS (SELECT doc_id, 0.7 * CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1.0 END AS score FROM r1), s2 AS (SELECT doc_id, 0.3 * CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1.0 END AS score FROM r2) SELECT doc_id, round(sum(score), 6) AS score FROM (FROM s1 UNION ALL FROM s2) GROUP BY doc_id"
)
def retrieval_score_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two top-50 lists, scaled and weighted 0.7 and 0.3."""
    first = search.top(search.bm25(_docs(spark, sf_dir), TERMS), 50)
    counts = search.postings(_docs(spark, sf_dir), ["thatin"]).select("doc_id", F.col("tf").cast("double").alias("score"))
    return retrieval.score_fusion([(first, 0.7), (search.top(counts, 50), 0.3)]).select("doc_id", F.round("score", 6).alias("score"))


_CHUNKS = "WITH c AS (SELECT doc_id, n::BIGINT AS chunk_no, (n * 500 + 1)::BIGINT AS start, substring(text, n*500+1, 500) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text)-500)/500.0)::INT, 0) + 1)) AS n FROM documents)), "
_SPANS = _CHUNKS + f"w AS (SELECT doc_id, chunk_no, start, length(text)::BIGINT AS length, text, {WORDS} AS w FROM c), " + _TF.replace("m AS (SELECT doc_id,", "m AS (SELECT doc_id, chunk_no, start, length, text,")
_BEST = ", b AS (SELECT doc_id, chunk_no, start, length, text, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM m JOIN d USING (term), s GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, chunk_no)::BIGINT AS rank FROM b QUALIFY rank <= 20) "


@query(_SPANS + _BEST + "SELECT doc_id, chunk_no, start, length, round(score, 6) AS score, rank FROM r")
def retrieval_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.passages(_docs(spark, sf_dir), TERMS, 20).withColumn("score", F.round("score", 6))


@query(_SPANS + _BEST + "SELECT doc_id, start, length, round(score, 6) AS score, rank, text AS quote FROM r")
def evidence_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.support(_docs(spark, sf_dir), TERMS, 20).withColumn("score", F.round("score", 6))


@query(
    f"WITH {W}, one AS (SELECT term, count(*) AS tf FROM (SELECT unnest(w) AS term FROM w WHERE doc_id = 7) GROUP BY term), f AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM w) GROUP BY term), best AS (SELECT term AS t FROM one JOIN f USING (term) ORDER BY one.tf * ln((SELECT count(*) FROM documents) / f.df) DESC, term LIMIT 5), "
    "m AS (SELECT doc_id, len(w) AS dl, t AS term, len(list_filter(w, lambda x: x = t)) AS tf FROM w, best WHERE list_contains(w, t)), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w), d AS (SELECT term, count(*) AS df FROM m GROUP BY term) "
    "SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM m JOIN d USING (term), s WHERE doc_id <> 7 GROUP BY doc_id"
)
def search_more_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.more_like(_docs(spark, sf_dir), 7, 5).select("doc_id", F.round("score", 6).alias("score"))


def _index(spark: SparkSession, *parts: DataFrame) -> textindex.Index:
    index = textindex.Index(spark, scratch.path(spark, "textindex"))
    for part in parts:
        index.append(part)
    return index


@query(BM25 + " SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id)::BIGINT AS rank FROM b QUALIFY rank <= 20")
def search_index_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 20 from a stored index of all documents, skipping blocks by their bounds."""
    return _index(spark, _docs(spark, sf_dir)).top(TERMS, 20).withColumn("score", F.round("score", 6))


@query(BM25 + " SELECT doc_id, round(score, 6) AS score FROM b")
def search_index_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score from an index that got its documents in three parts, which were then merged."""
    docs = _docs(spark, sf_dir)
    index = _index(spark, *(docs.where(F.col("doc_id") % 3 == part) for part in range(3)))
    index.merge()
    return index.bm25(TERMS).withColumn("score", F.round("score", 6))


@query(f"SELECT t AS term, count(DISTINCT doc_id)::BIGINT AS df FROM (SELECT doc_id, unnest({WORDS}) AS t FROM documents) GROUP BY t")
def search_index_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, _docs(spark, sf_dir)).dictionary()


@query(ORACLE_SQL["search_more_like"])
def search_index_more_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    one = docs.where(F.col("doc_id") == 7).select("text").first()
    return _index(spark, docs).more_like(one["text"], 5, apart=7).withColumn("score", F.round("score", 6))


def _vector_index(spark: SparkSession, sf_dir: str) -> vectorindex.VectorIndex:
    return vectorindex.VectorIndex.build(table(spark, sf_dir, "embeddings"), scratch.path(spark, "vectorindex"), lists=16)


@query(COSINE + RANKED)
def retrieval_every_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors from the inverted file, all lists probed: exact."""
    asked = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 20 == 0)
    return _vector_index(spark, sf_dir).nearest(asked, 10, probes=16).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT (SELECT count(*) FROM embeddings) AS indexed, (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) AS asked, true AS reached")
def retrieval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows indexed, queries answered by thirteen of sixteen lists (these vectors hardly cluster), and whether nine tenths of their ten exact neighbours were found."""
    index, asked = _vector_index(spark, sf_dir), table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 20 == 0)
    found = scratch.materialise(index.nearest(asked, 10, probes=13), "neighbours")
    reached = vectorindex.recall(found, _nearest(spark, sf_dir)).select((F.col("recall") >= 0.9).alias("reached"))
    counts = index.members().agg(F.count("*").alias("indexed")), found.agg(F.count_distinct("query_id").alias("asked"))
    return counts[0].crossJoin(counts[1]).crossJoin(reached)  # three tables of one row

# Letters beyond ASCII are one byte each here, as DuckDB counts bytes; both sides are in lower case.
_ONE = "translate({}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"


@query(
    f"WITH t AS (SELECT DISTINCT t, {_ONE.format('t')} AS s FROM (SELECT unnest({WORDS}) AS t FROM documents)), b AS (SELECT DISTINCT t, {_ONE.format('t')} AS s FROM (SELECT unnest({WORDS}) AS t FROM benchmark)) "
    "SELECT b.t AS wanted, t.t AS term, levenshtein(b.s, t.s)::BIGINT AS distance FROM b JOIN t ON abs(length(b.s) - length(t.s)) <= 2 AND levenshtein(b.s, t.s) <= 2"
)
def search_near_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of all documents within two edits of each term of the benchmark, by shared deletions."""
    terms = lambda name: table(spark, sf_dir, name).select(F.explode(T.tokens(F.col("text"))).alias("term"))
    return fuzzy.lookup(terms("benchmark"), fuzzy.index(terms("documents"), 2), 2)
