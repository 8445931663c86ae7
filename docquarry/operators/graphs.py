"""Clusters of a graph by star contraction, hubs split over many tasks.

In each round every node is linked to the least of its neighbours, in turns with its
larger ones (large star) and its smaller ones (small star), until each
cluster is a star around its least node; that takes a number of rounds that grows
with the logarithm of the graph's size. The least neighbour of a node has to go back to all of
the node's edges. A node with very many edges is a hub: its edges are dealt out over salted keys and
its least neighbour goes to each of them. How many edges make a hub grows
with the graph, so that at most ``HUBS`` nodes can be hubs, whose list is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.sources import scratch

#: Edges under one key of a join, about, and nodes that can be hubs: two numbers each.
HUB, HUBS = 10_000, 50_000


def hub_size(edges: int, hub: int = HUB) -> int:
    """Edges from which a node is a hub; twice ``edges`` ends are shared out, so no more than ``HUBS`` nodes have that many."""
    return max(hub, -(-2 * edges // HUBS))


def spread(rows: DataFrame, key: str, by: str, held: DataFrame, hubs: DataFrame, size: int) -> DataFrame:
    """``rows`` joined with ``held`` on ``key``, where keys of many rows are dealt out by ``by``: no task gets many more than ``size`` rows of one.

    ``hubs`` has the keys with more than ``size`` rows and their number n; it is
    broadcast, and with a size from ``hub_size`` it has ``HUBS`` rows at most. A hub's row
    of ``held`` goes to each of its parts.
    """
    parts = F.ceil(F.col("n") / F.lit(size)).cast("int")
    few = F.broadcast(hubs.select(key, parts.alias("_parts")))
    marked = rows.join(few, key, "left").withColumn("_salt", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"))).drop("_parts")
    copied = held.join(few, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return marked.join(copied, [key, "_salt"]).drop("_salt")


def salted(edges: DataFrame, least: DataFrame, hubs: DataFrame, size: int) -> DataFrame:
    """(u, v, m) of the edges (u, v) with their node's least neighbour m from ``least`` (u, m, n)."""
    return spread(edges, "u", "v", least.select("u", "m"), hubs, size)


class _Tables:
    """Tables of a round, deleted when the next one is there."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch.path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, paths: list[str]) -> None:
        for path in paths:
            scratch.delete(self.spark, path)
            self.paths.remove(path)


def clusters(edges: DataFrame, *, a_col: str = "src", b_col: str = "dst", hub: int = HUB) -> DataFrame:
    """(node, root): for each node of the undirected edges, the least node that it can reach.

    Edges may repeat, in either direction; an edge with a null end, or from a node to
    itself, joins nothing, so a node that has no other is left out. Nodes may be of any
    ordered type. Rounds are tables in the shared folder; earlier ones are deleted.
    """
    spark = edges.sparkSession
    tables = _Tables(spark)
    given = edges.select(F.greatest(a_col, b_col).alias("u"), F.least(a_col, b_col).alias("v"), F.col(a_col).isNotNull().alias("x"), F.col(b_col).isNotNull().alias("y"))
    now = tables.keep(given.where("x AND y AND u <> v").select("u", "v").distinct(), "edges")
    count, state = now.count(), None

    def told(links: DataFrame) -> DataFrame:
        """(u, v, m): every link with the least neighbour of its first node."""
        least = tables.keep(links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        size = hub_size(count, hub)
        return salted(links, least, least.where(F.col("n") > size), size)

    while True:
        old = list(tables.paths)
        both = now.union(now.select("v", "u"))
        # Large star: the larger neighbours of a node are linked to the least of it and its neighbours.
        large = told(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = tables.keep(large.distinct(), "edges")
        # Small star: the smaller neighbours of a node and the node itself are linked to the least of them.
        small = told(large)
        small = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = tables.keep(small, "edges")
        tables.drop([x for x in tables.paths if x in old or x != tables.paths[-1]])
        count, digest = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (count, digest) == state:
            # Every node but the least of its cluster has one edge; the least ones are added.
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        state = (count, digest)
