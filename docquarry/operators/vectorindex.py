"""Approximate nearest vectors by an inverted file: every vector lies in the list of its nearest centroid, a search probes several lists.

Centroids come from a bounded sample (``sample`` rows with the least hash of
their id). Every row is indexed. Equal vectors are one entry that knows its
``max_k`` smallest ids, which is all that a search for up to that many can
return of them as ties go to smaller ids; so a vector that a third of all rows
share is one entry, and every id is in ``members`` besides.

Entries travel in blocks, matrices of up to ``ROWS`` vectors of one list, and
so do the queries that probe a list. Blocks meet by an equi-join on the list,
each pair of blocks is one matrix product, and of it only each query's best
``k`` go on. No list is gathered, and nothing that grows is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors in a block of entries and of queries.
ROWS, QUERY_ROWS = 2048, 512
#: Rows that centroids are fitted on at most, and rounds of refinement.
SAMPLE, ROUNDS = 50_000, 12


def centroids(rows: DataFrame, lists: int, *, sample: int = SAMPLE, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "cosine") -> np.ndarray:
    """Up to ``lists`` centroids of at most ``sample`` rows, the same for the same rows whatever their order."""
    wanted = vectors(rows, id_col, vector_col, metric).orderBy(F.xxhash64("id"), "id").limit(sample)
    held = wanted.select("v").toPandas()["v"]  # bounded by ``sample``
    if not len(held):
        return np.empty((0, 0))
    x = np.unique(_prepared(np.stack(held.to_list()), metric), axis=0)
    rng = np.random.default_rng(7)
    found = [x[rng.integers(len(x))]]
    far = ((x - found[0]) ** 2).sum(1)
    # The first centroids are drawn in proportion to their squared distance from those before.
    while len(found) < min(lists, len(x)) and far.sum() > 0:
        found.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, ((x - found[-1]) ** 2).sum(1))
    c = np.stack(found)
    for _ in range(rounds):
        own = _order(x, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        sizes = np.bincount(own, minlength=len(c))[:, None]
        moved = np.where(sizes > 0, sums / np.maximum(sizes, 1), c)
        if np.allclose(moved, c):
            break
        c = moved
    return c


def _prepared(x: np.ndarray, metric: str) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x**2).sum(1))[:, None] if metric == "cosine" else x


def _order(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each vector."""
    return np.argsort((c**2).sum(1)[None, :] - 2 * (x @ c.T), axis=1, kind="stable")[:, :n]


def vectors(rows: DataFrame, id_col: str, vector_col: str, metric: str) -> DataFrame:
    """(id, v): rows without an id or a vector are left out, under cosine zero vectors too."""
    made = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    return made.where(F.exists("v", lambda x: x != 0)) if metric == "cosine" else made


def _blocks(rows: DataFrame, columns: list[str], size: int) -> DataFrame:
    """(list, block, ``columns`` as arrays, m): up to ``size`` rows of a list; wherever a task's rows of a list end, a smaller block."""
    kinds = ", ".join(f"{c} array<{rows.schema[c].dataType.simpleString()}>" for c in columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, now = TaskContext.get().partitionId() << 32, [], None

        def full() -> pa.RecordBatch:
            nonlocal number
            number += 1
            made = [pa.array([now], pa.int32()), pa.array([number])]
            made += [pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.concat_arrays([x[0][i] for x in held])) for i in range(len(columns))]
            matrix = np.stack([x[1] for x in held]).astype(np.float64)
            return pa.RecordBatch.from_arrays([*made, pa.array([matrix.tobytes()])], names=["list", "block", *columns, "m"])

        for b in batches:
            for i, (which, v) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), strict=True)):
                if held and (which != now or len(held) == size):
                    yield full()
                    held = []
                now = which
                held.append(([b.column(2 + k).slice(i, 1) for k in range(len(columns))], v))
        if held:
            yield full()

    return rows.select("list", "v", *columns).mapInArrow(pack, f"list int, block bigint, {kinds}, m binary")


@dataclass(frozen=True)
class VectorIndex:
    """An index in a folder that driver and executors share."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    metric: str = "cosine"
    max_k: int = 100

    @classmethod
    def build(cls, rows: DataFrame, path: str, *, lists: int, sample: int = SAMPLE, max_k: int = 100, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> VectorIndex:
        """Index every row with an id and a vector. ``metric``: ``cosine`` or ``l2``. Rows that repeat an id and vector count once."""
        if metric not in ("cosine", "l2"):
            raise ValueError(f"unknown metric {metric!r}")
        found = centroids(rows, lists, sample=sample, id_col=id_col, vector_col=vector_col, metric=metric)
        index = cls(rows.sparkSession, path, found, metric, max_k)
        every = vectors(rows, id_col, vector_col, metric)
        every.select("id", F.xxhash64("v").alias("key")).write.parquet(f"{path}/members")
        # Each task keeps its own smallest ids of a vector before anything is shuffled, so a frequent vector does not gather.
        small = every.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= max_k + 1)
        entries = small.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
        listed = index._listed(entries, 1)
        # Written by list; lists that are larger than others take several files.
        listed.hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/entries")
        return index

    def _listed(self, rows: DataFrame, probes: int) -> DataFrame:
        """``rows`` once for each of the ``probes`` nearest lists of ``v``."""
        c, metric = self.centres, self.metric  # lists times dimensions, a parameter of the index

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = _prepared(np.stack(b.column("v").to_numpy(zero_copy_only=False)), metric)
                near = _order(x, c, probes)
                rows = b.take(pa.array(np.repeat(np.arange(len(x)), near.shape[1])))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(near.reshape(-1).astype(np.int32))], names=[*b.schema.names, "list"])

        if not len(c):
            return rows.where("false").withColumn("list", F.lit(0))
        return rows.mapInArrow(deal, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", list int")

    def entries(self) -> DataFrame:
        return self.spark.read.schema("v array<double>, ids array<bigint>, list int").parquet(f"{self.path}/entries")

    def members(self) -> DataFrame:
        """Every indexed id with the digest of its vector."""
        return self.spark.read.schema("id bigint, key bigint").parquet(f"{self.path}/members")

    def nearest(self, queries: DataFrame, k: int, *, probes: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """(query_id, id, score, rank): the ``k`` best rows in the ``probes`` lists nearest to each query, itself excluded; ties go to the smaller id.

        With as many probes as lists the result is exact. The score is the
        cosine or the negative distance. ``k`` is ``max_k`` at most.
        """
        if k > self.max_k:
            raise ValueError(f"the index keeps {self.max_k} ids of a vector")
        metric = self.metric
        asked = vectors(queries, id_col, vector_col, metric).withColumnRenamed("id", "query_id").dropDuplicates(["query_id"])
        blocks = _blocks(self._listed(asked, probes).repartition("list").sortWithinPartitions("list"), ["query_id"], QUERY_ROWS)
        stored = _blocks(self.entries().sortWithinPartitions("list"), ["ids"], ROWS)
        pairs = blocks.select("list", "query_id", F.col("m").alias("q")).join(stored.select("list", "ids", "m"), "list")
        return ranked(compared(pairs, k, metric), k, id_col)


def compared(pairs: DataFrame, k: int, metric: str) -> DataFrame:
    """(query_id, id, score): each query's ``k`` best of every pair of blocks (query_id, q, ids, m)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                who = b.column(0)[i].values.to_numpy()
                q = np.frombuffer(b.column(1)[i].as_py()).reshape(len(who), -1)
                lists = b.column(2)[i].values
                starts = lists.offsets.to_numpy().astype(np.int64)
                ids = lists.values.to_numpy()
                m = np.frombuffer(b.column(3)[i].as_py()).reshape(len(lists), -1)
                yield _best(who, q, starts, ids, m, k, metric)

    return pairs.select("query_id", "q", "ids", "m").mapInArrow(score, "query_id bigint, id bigint, score double")


def ranked(found: DataFrame, k: int, id_col: str) -> DataFrame:
    """The ``k`` best of each query with their rank from 1; ties go to the smaller id."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k).withColumnRenamed("id", id_col)


def exhaustive(queries: DataFrame, rows: DataFrame, k: int, metric: str, block: int = QUERY_ROWS) -> DataFrame:
    """(query_id, id, score): the ``k`` best rows of each task for each query, both as (id, v).

    Blocks of rows are dealt out in parts and every part gets the queries' blocks, by an equi-join on the part's
    number: what moves is the rows once and the queries once for each part, and nothing passes through the driver.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = _blocks(queries.select(F.lit(0).alias("list"), "v", F.col("id").alias("query_id")), ["query_id"], block)
    blocks = blocks.select("query_id", F.col("m").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    stored = _blocks(rows.select(F.lit(0).alias("list"), "v", F.array("id").alias("ids")), ["ids"], ROWS)
    stored = stored.select("ids", "m", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"))
    return compared(stored.join(blocks, "part"), k, metric)


def _best(who: np.ndarray, q: np.ndarray, starts: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int, metric: str) -> pa.RecordBatch:
    """Each query's ``k`` best ids of one block of entries."""
    dots = q @ m.T
    if metric == "dot":
        s = dots
    elif metric == "cosine":
        s = dots / (np.sqrt((q**2).sum(1))[:, None] * np.sqrt((m**2).sum(1))[None, :])
    else:
        s = -np.sqrt(np.maximum((q**2).sum(1)[:, None] + (m**2).sum(1)[None, :] - 2 * dots, 0))
    s = np.where(np.isnan(s), -np.inf, s)
    # An entry gives one id at least other than the query's own, unless that is its only one: k + 1 entries hold the k best, and equal scores further ones.
    out: list[list] = [[], [], []]
    for row, query in zip(s, who.tolist(), strict=True):
        if len(row) > k + 1:
            least = np.partition(row, len(row) - k - 1)[len(row) - k - 1]
            chosen = np.flatnonzero(row >= least)
        else:
            chosen = np.arange(len(row))
        found = sorted((-row[e], x) for e in chosen if row[e] > -np.inf for x in ids[starts[e] : starts[e + 1]][: k + 1].tolist() if x != query)[:k]
        out[0] += [query] * len(found)
        out[1] += [x for _, x in found]
        out[2] += [-x for x, _ in found]
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "id", "score"])


def recall(found: DataFrame, exact: DataFrame, *, id_col: str = "vec_id") -> DataFrame:
    """One row (n, recall): the share of exact neighbours that were found."""
    hit = exact.select("query_id", id_col).join(found.select("query_id", id_col, F.lit(1).alias("hit")), ["query_id", id_col], "left")
    return hit.agg(F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
