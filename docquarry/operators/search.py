"""Lexical search: dictionary, postings, boolean and phrase search, TF-IDF and BM25.

A query is a list of terms, made with the tokeniser of the documents. Only rows
of query terms leave the scan's tasks, so what is shuffled grows with the
matches and not with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as T

K1, B = 1.2, 0.75


def dictionary(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(term, df, cf): documents that hold the term, and its occurrences; one shuffle of partial sums.

    A text's sorted tokens tell where a term is new, so a token is one row that
    says whether it is the first of its kind in the text.
    """
    first = lambda w: F.transform(w, lambda t, i: F.struct(t.alias("term"), F.when((i == 0) | (F.get(w, i - 1) != t), 1).otherwise(0).alias("d")))
    rows = df.select(F.inline(T.bound(F.sort_array(T.tokens(F.col(text_col))), first)))
    return rows.groupBy("term").agg(F.sum("d").alias("df"), F.count("*").alias("cf"))


def postings(df: DataFrame, terms: list[str] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, id, tf, positions) of all terms or of the given ones; positions from 0, ascending."""
    rows = df.select(id_col, F.posexplode(T.tokens(F.col(text_col))).alias("pos", "term"))
    if terms is not None:
        rows = rows.where(F.col("term").isin(*terms))
    return rows.groupBy("term", id_col).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list(F.col("pos").cast("bigint"))).alias("positions"))


def boolean(words: Column, *, every: tuple[str, ...] = (), some: tuple[str, ...] = (), none: tuple[str, ...] = ()) -> Column:
    """Whether the tokens hold all of ``every``, one of ``some`` (if given) and nothing of ``none``."""
    holds = F.lit(True)
    for term in every:
        holds = holds & F.array_contains(words, term)
    if some:
        holds = holds & F.arrays_overlap(words, F.array(*map(F.lit, some)))
    for term in none:
        holds = holds & ~F.array_contains(words, term)
    return holds


def phrase(words: Column, terms: list[str]) -> Column:
    """Number of places where the terms follow one another."""
    n, wanted = len(terms), F.array(*map(F.lit, terms))

    def places(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.slice(w, i, n) == wanted)
        return F.when(F.size(w) >= n, F.size(starts)).otherwise(0)

    return T.bound(words, places)


def proximity(df: DataFrame, first: str, second: str, within: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, distance): the least distance of the two terms in each text that holds both at most ``within`` tokens apart."""
    both = df.select(id_col, T.tokens(F.col(text_col)).alias("w")).where(F.array_contains("w", first) & F.array_contains("w", second))
    places = lambda w, term: F.filter(F.transform(w, lambda x, i: F.when(x == term, i)), lambda i: i.isNotNull())
    apart = lambda a, b: F.array_min(F.transform(a, lambda i: F.array_min(F.transform(b, lambda j: F.abs(i - j)))))
    least = T.bound(F.col("w"), lambda w: T.bound(places(w, second), lambda b: apart(places(w, first), b)))
    return both.select(id_col, least.cast("bigint").alias("distance")).where(F.col("distance") <= within)


def _weighted(df: DataFrame, terms: list[str], id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(id, dl, tf, n, avgdl, df) of every text, ``tf`` and ``df`` as arrays over the query's terms, and how many they are.

    Texts are read and counted once: what leaves that scan is an id and a few
    numbers, and the totals and the scores share its exchange.
    """
    wanted = sorted(set(terms))

    def counted(w: Column) -> Column:
        times = lambda t: F.size(F.filter(w, lambda x: x == t)).cast("bigint")
        tf = F.array(*map(times, wanted))
        return F.struct(F.size(w).cast("bigint").alias("dl"), tf.alias("tf"))

    made = df.select(F.col(id_col), T.bound(T.tokens(F.coalesce(F.col(text_col), F.lit(""))), counted).alias("_x"))
    rows = made.select(id_col, "_x.dl", "_x.tf").repartition(F.col(id_col))
    held = (F.sum((F.col("tf")[k] > 0).cast("bigint")) for k in range(len(wanted)))
    totals = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.array(*held).alias("df"))  # one row
    return rows.join(F.broadcast(totals)), len(wanted)


def _summed(found: DataFrame, parts: list[Column], id_col: str) -> DataFrame:
    """(id, score) of the rows with a term. The condition names a total, as a filter of the texts alone would part the shared exchange."""
    hits = F.when(F.col("n") > 0, F.exists("tf", lambda x: x > 0))
    score = parts[0]
    for x in parts[1:]:
        score = score + x
    return found.where(hits).select(id_col, score.alias("score")).groupBy(id_col).agg(F.sum("score").alias("score"))


def bm25(df: DataFrame, terms: list[str], *, k1: float = K1, b: float = B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document with a query term.

    The weight of a term is ``ln(1 + (n - df + 0.5) / (df + 0.5))``; the choice
    of the formula and of k1 and b is ours.
    """
    if not terms:
        raise ValueError("the query has no terms")
    found, many = _weighted(df, terms, id_col, text_col)

    def part(tf: Column, held: Column) -> Column:
        idf = F.ln(1 + (F.col("n") - held + 0.5) / (held + 0.5))
        return F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)

    return _summed(found, [part(F.col("tf")[k], F.col("df")[k]) for k in range(many)], id_col)


def tf_idf(df: DataFrame, terms: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): sum of term frequency times ``ln(n / df)`` over the query terms."""
    if not terms:
        raise ValueError("the query has no terms")
    found, many = _weighted(df, terms, id_col, text_col)
    part = lambda tf, held: F.when(tf > 0, tf * F.ln(F.col("n") / held)).otherwise(0.0)
    return _summed(found, [part(F.col("tf")[k], F.col("df")[k]) for k in range(many)], id_col)


def top(scored: DataFrame, k: int, *, id_col: str = "doc_id") -> DataFrame:
    """The ``k`` best rows with their rank from 1; ties go to the smaller id."""
    best = scored.orderBy(F.desc("score"), F.asc(id_col)).limit(k)
    ranked = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("back"), F.col(id_col)))).alias("r"))
    return ranked.select(F.posexplode("r").alias("p", "x")).select(F.col(f"x.{id_col}"), (-F.col("x.back")).alias("score"), (F.col("p") + 1).cast("bigint").alias("rank"))


def field_score(df: DataFrame, terms: list[str], fields: dict[str, float], *, id_col: str = "doc_id") -> DataFrame:
    """(id, score): BM25 over several text columns, weighted and added."""
    parts = [bm25(df, terms, id_col=id_col, text_col=c).select(id_col, (F.col("score") * w).alias("score")) for c, w in fields.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(id_col).agg(F.sum("score").alias("score"))


def snippet(text: Column, term: str, reach: int) -> Column:
    """The text around the first place of ``term``, in any case, with ``reach`` characters on either side; null if it is missing."""
    at = F.locate(term.lower(), F.lower(text))
    start = F.greatest(at - reach, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + F.lit(len(term) + reach)))


def fuzzy(names: Column, term: str, distance: int) -> Column:
    return F.levenshtein(F.lower(names), F.lit(term.lower()), distance) >= 0


def more_like(df: DataFrame, doc_id: int, k_terms: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of the other documents by BM25 with the ``k_terms`` best terms of one document by tf times idf."""
    one = df.where(F.col(id_col) == doc_id).select(F.explode(T.tokens(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
    # The terms of one document, so a bounded list: only rows of them leave the scan's tasks.
    own = F.explode(F.array_distinct(T.tokens(F.col(text_col)))).alias("term")
    frequency = df.select(own).join(F.broadcast(one.select("term")), "term").groupBy("term").agg(F.count("*").alias("df"))
    weight = F.col("tf") * F.ln(F.lit(df.count()) / F.col("df"))
    best = one.join(frequency, "term").orderBy(weight.desc(), "term").limit(k_terms)
    terms = [r["term"] for r in best.select("term").collect()]  # k_terms at most
    if not terms:
        raise ValueError(f"document {doc_id} has no terms")
    return bm25(df, terms, id_col=id_col, text_col=text_col).where(F.col(id_col) != doc_id)


def suggest(df: DataFrame, prefix: str, k: int, *, text_col: str = "text") -> DataFrame:
    """(term, df, cf): the ``k`` terms with a prefix that most documents hold."""
    return dictionary(df, text_col=text_col).where(F.col("term").startswith(prefix.lower())).orderBy(F.desc("df"), "term").limit(k)
