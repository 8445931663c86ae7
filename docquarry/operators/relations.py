"""Relationships: copies, shared lines, links, co-occurrence, and ranks over a graph of edges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import html as H
from docquarry.functions import text as T

#: A name: capitalised words that follow one another.
NAME = r"(?<![\p{L}\p{N}_])\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+"


def copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(content_hash, original, n): texts that occur more than once, with their least id. Only digests are shuffled."""
    hashed = df.where(F.col(text_col).isNotNull()).select(id_col, T.content_hash(F.col(text_col)).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min(id_col).alias("original"), F.count("*").alias("n")).where("n > 1")


def shared_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(line, n_docs, n_sources) of the lines that stand in more than one document.

    Counts are of different documents and sources, so Spark combines them in
    the tasks and a line that every document holds is no hot key.
    """
    rows = df.select(id_col, source_col, F.explode(F.array_distinct(T.lines(F.col(text_col)))).alias("line")).where("line <> ''")
    per_source = rows.groupBy("line", source_col).agg(F.count_distinct(id_col).alias("n"))
    found = per_source.groupBy("line").agg(F.sum("n").alias("n_docs"), F.count(source_col).alias("n_sources"))
    return found.where("n_docs > 1")


def link_edges(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, pos, href, target, dst): ``target`` is the link resolved against its page, ``dst`` the least page at that host and path, null if none is stored."""
    links = pages.select(F.col(id_col).alias("src"), F.col(url_col).alias("base"), F.posexplode(H.links(F.col(html_col))).alias("pos", "href"))
    links = links.withColumn("target", H.resolve(F.col("base"), F.col("href"))).withColumn("place", H.place(F.col("target")))
    stored = pages.select(F.col(id_col).alias("dst"), H.place(F.col(url_col)).alias("place")).where("place is not null").groupBy("place").agg(F.min("dst").alias("dst"))
    return links.join(stored, "place", "left").select("src", F.col("pos").cast("bigint").alias("pos"), "href", "target", "dst")


def host_links(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, href_host, n_links, n_pages) between the hosts of pages and of their links, resolved."""
    links = pages.select(F.col(url_col).alias("url"), F.explode(H.links(F.col(html_col))).alias("href"))
    hosts = links.select("url", H.host(F.col("url")).alias("host"), H.host(H.resolve(F.col("url"), F.col("href"))).alias("href_host")).where("href_host is not null")
    return hosts.groupBy("host", "href_host").agg(F.count("*").alias("n_links"), F.count_distinct("url").alias("n_pages"))


def mentions(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, value, n): names that a text mentions, and how often."""
    names = F.regexp_extract_all(F.col(text_col), F.lit(NAME), F.lit(0))
    return df.select(id_col, F.explode(names).alias("value")).groupBy(id_col, "value").agg(F.count("*").alias("n"))


def cooccurrence(found: DataFrame, *, id_col: str = "doc_id", value_col: str = "value") -> DataFrame:
    """(a, b, n_docs) of values that the same document holds, a before b.

    Pairs are made inside each document's own sorted set, by a generator over
    one row, and counted with partial sums; no join of documents takes place.
    """
    sets = found.groupBy(id_col).agg(F.array_sort(F.collect_set(value_col)).alias("v"))
    pairs = F.flatten(F.transform(F.col("v"), lambda x, i: F.transform(F.slice(F.col("v"), i + 2, F.size("v")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return sets.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("n_docs"))


def reachable(edges: DataFrame, start: int, hops: int) -> DataFrame:
    """(node, hop): what ``start`` reaches in at most ``hops`` steps over (src, dst), with the least number of steps."""
    found = edges.sparkSession.createDataFrame([(start, 0)], "node bigint, hop int")
    for hop in range(1, hops + 1):
        ahead = found.join(edges, found["node"] == edges["src"]).select(F.col("dst").alias("node"), F.lit(hop).alias("hop"))
        found = found.unionByName(ahead).groupBy("node").agg(F.min("hop").alias("hop"))
    return found


def page_rank(edges: DataFrame, *, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(node, rank) over (src, dst); ranks add up to 1, and what ends in nodes without links is spread evenly.

    Ranks are written to the checkpoint folder every few rounds, which bounds
    the plan and what a lost executor costs.
    """
    spark = edges.sparkSession
    edges = edges.select("src", "dst").distinct()
    degree = edges.groupBy("src").agg(F.count("*").alias("out"))
    linked = edges.join(degree, "src")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    total = nodes.count()
    if not total:
        return spark.createDataFrame([], "node bigint, rank double")
    ranks = nodes.withColumn("rank", F.lit(1.0 / total))
    for at in range(1, rounds + 1):
        given = ranks.join(linked, ranks["node"] == linked["src"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("given"))
        after = nodes.join(given, "node", "left").select("node", F.coalesce("given", F.lit(0.0)).alias("given"))
        passed = after.agg(F.sum("given").alias("passed"))  # one row
        share = F.lit((1 - damping) / total) + F.lit(damping) * (F.col("given") + (1 - F.col("passed")) / total)
        ranks = after.crossJoin(F.broadcast(passed)).select("node", share.alias("rank"))
        if at % 5 == 0 and at < rounds and (shared := spark.conf.get("spark.checkpoint.dir", None)):
            path = f"{shared.rstrip('/')}/docquarry/ranks-{uuid.uuid4().hex}"
            ranks.write.parquet(path)
            ranks = spark.read.parquet(path)
    return ranks
