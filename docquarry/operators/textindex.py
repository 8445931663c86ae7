"""A stored inverted index: postings by term with bounds per block, and a ranked search that skips blocks.

Documents are read once and not shuffled. Each task gathers up to ``SHARD_DOCS`` of its
documents into a shard and writes, for each term of the shard, blocks of up to
``BLOCK`` postings: ids as differences, term frequencies and document lengths
as variable-length integers, and beside them the largest frequency and the
smallest length. Only these rows are dealt out, by a bucket of the term, which
is a folder: a search opens the folders of its terms alone.

The best score that a block can hold follows from its largest frequency and
smallest length whatever the corpus' averages are, so blocks need not be
rewritten as the index grows. A ranked search first reads the bounds without
the postings, scores the shards that promise most for a threshold, and then only
those shards, and in them only those stretches of ids, whose bounds reach it.

An index grows by generations (``append``), which ``merge`` combines. One writer
works on an index at a time; a search that runs while ``merge`` deletes the old
generations has to be started again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as T

K1, B = 1.2, 0.75
BLOCK, BUCKETS = 128, 64
#: Documents and postings after which a shard is full, and the shards that are scored first for a threshold.
SHARD_DOCS, SHARD_POSTINGS, FIRST_SHARDS = 4096, 1_000_000, 16
#: Documents counted at once, rows that a task gives back at once, and the folder of the shards' totals.
SLICE, OUT_ROWS, TOTALS = 256, 20_000, -1
#: Rows that go to a Python worker at once.
ARROW_ROWS = 1000

POSTINGS = "term string, generation int, shard bigint, block int, n int, first bigint, last bigint, max_tf bigint, min_dl bigint, ids binary, tfs binary, dls binary"
_COLUMNS = [x.split()[0] for x in POSTINGS.split(", ")]
_STORED = POSTINGS.replace("generation int, ", "") + ", generation int, bucket int"


def packed(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Non-negative integers in groups of seven bits, low ones first, where the high bit says that more follow; and the byte at which each begins, and the end."""
    v = values.astype(np.uint64)
    sizes = np.ones(len(v), dtype=np.int64)
    for depth in range(1, 9):
        sizes += v >= np.uint64(1 << 7 * depth)
    starts = np.concatenate([[0], sizes.cumsum()])
    out = np.empty(starts[-1], dtype=np.uint8)
    for depth in range(int(sizes.max(initial=0))):
        own = sizes > depth
        digit = (v[own] >> np.uint64(7 * depth)) & np.uint64(127)
        out[starts[:-1][own] + depth] = digit | (sizes[own] > depth + 1).astype(np.uint64) << np.uint64(7)
    return out.tobytes(), starts


def unpacked(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, dtype=np.uint8)
    if not len(b):
        return np.empty(0, dtype=np.int64)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    depth = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * depth).astype(np.uint64), starts).astype(np.int64)


def _coded(terms: np.ndarray, ids: np.ndarray, tfs: np.ndarray, dls: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The term of each block, and its columns block, n, first, last, max_tf, min_dl, ids, tfs, dls, of postings in any order; ``terms`` are numbers.

    The three lists of a term come out one after another, so they are slices of one buffer each.
    """
    order = np.lexsort((ids, terms))
    terms, ids, tfs, dls = terms[order], ids[order], tfs[order], dls[order]
    fresh = np.ones(len(terms), dtype=bool)
    fresh[1:] = terms[1:] != terms[:-1]
    heads = np.flatnonzero(fresh)
    place = np.arange(len(terms)) - np.repeat(heads, np.diff([*heads, len(terms)]))
    starts = np.flatnonzero(place % BLOCK == 0)
    stops = np.concatenate([starts[1:], [len(terms)]]).astype(np.int64)
    gaps = np.diff(ids, prepend=0)
    gaps[starts] = 0
    least = lambda f, x: f.reduceat(x, starts) if len(starts) else x
    columns = [pa.array((place[starts] // BLOCK).astype(np.int32)), pa.array((stops - starts).astype(np.int32)), pa.array(ids[starts]), pa.array(ids[stops - 1]), pa.array(least(np.maximum, tfs)), pa.array(least(np.minimum, dls))]
    for values in (gaps, tfs, dls):
        raw, at = packed(values)
        cuts = at[np.concatenate([starts, [len(terms)]])].astype(np.int32)
        columns.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(raw)]))
    return terms[starts], columns


def _blocks(terms: np.ndarray, ids: np.ndarray, tfs: np.ndarray, dls: np.ndarray) -> Iterator[tuple]:
    """(term, block, n, first, last, max_tf, min_dl, ids, tfs, dls) of one shard's postings, one tuple per block."""
    found, columns = _coded(terms, ids, tfs, dls)
    yield from zip(found.tolist(), *(c.to_pylist() for c in columns), strict=True)


def _rows(names: pa.Array, generation: int, shards: np.ndarray, columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    """Rows of ``POSTINGS``, ``OUT_ROWS`` at a time."""
    made = pa.RecordBatch.from_arrays([names, pa.array(np.full(len(names), generation, dtype=np.int32)), pa.array(shards.astype(np.int64)), *columns], names=_COLUMNS)
    for at in range(0, made.num_rows, OUT_ROWS):
        yield made.slice(at, OUT_ROWS)


class _Shard:
    """Documents of one task until a shard is full: for each batch its different terms, and by number the term, document and frequency of each posting."""

    def __init__(self):
        self.terms: list[pa.Array] = []
        self.found: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.docs = self.postings = self.names = 0

    def add(self, ids: pa.Array, words: pa.Array) -> None:
        coded = words.flatten().dictionary_encode()
        lengths = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        many = max(1, len(coded.dictionary))
        keys = np.repeat(np.arange(len(words), dtype=np.int64), lengths) * many + coded.indices.to_numpy()
        keys, times = np.unique(keys, return_counts=True)
        self.found.append(np.stack([self.names + keys % many, self.docs + keys // many, times]))
        self.terms.append(coded.dictionary)
        self.ids.append(ids.to_numpy())
        self.lengths.append(lengths)
        self.names += len(coded.dictionary)
        self.docs += len(words)
        self.postings += len(keys)

    def blocks(self) -> tuple[pa.Array, list[pa.Array]]:
        every = pa.concat_arrays(self.terms).dictionary_encode()
        (term, doc, tf), ids, dl = np.concatenate(self.found, axis=1), np.concatenate(self.ids), np.concatenate(self.lengths)
        found, columns = _coded(every.indices.to_numpy().astype(np.int64)[term], ids[doc], tf, dl[doc])
        return every.dictionary.take(pa.array(found)), columns

    def total(self) -> list[pa.Array]:
        """A row without a term: the number of documents as ``n`` and their length as ``last``."""
        none = pa.array([0], pa.int64())
        length = pa.array([sum(int(x.sum()) for x in self.lengths)], pa.int64())
        return [pa.array([0], pa.int32()), pa.array([self.docs], pa.int32()), none, length, none, none, *[pa.array([b""], pa.binary())] * 3]


@dataclass(frozen=True)
class Index:
    """An index in a folder that driver and executors share."""

    spark: SparkSession
    path: str

    # -- writing

    def append(self, df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Add documents as a new generation and return its number; their ids must be new, and rows without an id are left out.

        A null or empty text counts as a document without terms.
        """
        generation = max(self._generations(), default=-1) + 1
        self._write(generation, self._built(df, generation, id_col, text_col))
        # The number of documents and their total length, from the rows that the shards left: one row per generation, written last, so a failed append is not seen.
        left = self.spark.read.schema(_STORED).parquet(f"{self.path}/postings/generation={generation}").where(F.col("bucket") == TOTALS)
        totals = left.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(to) for c, to in (("n", "n"), ("last", "length"))))
        totals.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/totals/generation={generation}")
        return generation

    def _built(self, df: DataFrame, generation: int, id_col: str, text_col: str) -> DataFrame:
        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, shard = TaskContext.get().partitionId() << 32, _Shard()

            def full() -> Iterator[pa.RecordBatch]:
                if shard.docs:
                    yield from _rows(pa.array([None], pa.string()), generation, np.array([number]), shard.total())
                if shard.postings:
                    names, columns = shard.blocks()
                    yield from _rows(names, generation, np.full(len(names), number), columns)

            for b in batches:
                at = 0
                while at < b.num_rows:
                    part = b.slice(at, min(SLICE, SHARD_DOCS - shard.docs))
                    shard.add(part.column(0), part.column(1))
                    at += part.num_rows
                    if shard.docs >= SHARD_DOCS or shard.postings >= SHARD_POSTINGS:
                        yield from full()
                        number, shard = number + 1, _Shard()
            yield from full()

        _bounded(self.spark)
        words = T.tokens(F.coalesce(F.col(text_col), F.lit("")))
        return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), words.alias("w")).mapInArrow(_released(build), POSTINGS)

    def _write(self, generation: int, rows: DataFrame) -> None:
        bucket = _bucket(F.col("term"))
        # Sorted by term within a bucket, so that row groups are skipped by their minima and maxima.
        dealt = rows.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "term", "shard", "block")
        dealt.drop("generation").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/generation={generation}")

    def merge(self) -> int:
        """Combine all generations into one: small shards are joined up to a shard's size, blocks filled again; texts are not read."""
        old = self._seen()
        if len(old) < 2:
            return max(old, default=-1)
        generation = max(old) + 1
        postings = self.blocks().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        # Whole shards are joined, so that all terms of a document stay in one.
        into = F.pmod(F.xxhash64("generation", "shard"), F.lit(max(1, -(-postings // SHARD_POSTINGS))))

        def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: list[pa.RecordBatch] = []  # rows of the last term and shard, which may go on

            def joined(rows: pa.RecordBatch, fresh: np.ndarray) -> Iterator[pa.RecordBatch]:
                n, ids, tfs, dls = _decoded(rows)
                groups, columns = _coded(np.repeat(fresh.cumsum() - 1, n), ids, tfs, dls)
                at = pa.array(np.flatnonzero(fresh)[groups])
                yield from _rows(rows.column("term").take(at), generation, rows.column("into").take(at).to_numpy(), columns)

            for b in batches:
                rows = pa.Table.from_batches([*kept, b]).combine_chunks().to_batches()[0] if kept else b
                fresh = _changes(rows)
                last = int(np.flatnonzero(fresh)[-1])
                if last:
                    yield from joined(rows.slice(0, last), fresh[:last])
                    kept = [rows.slice(last)]
                else:
                    kept.append(b)
            if kept:
                rows = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                yield from joined(rows, _changes(rows))

        _bounded(self.spark)
        rows = self._postings().select("bucket", "term", into.alias("into"), "n", "first", "ids", "tfs", "dls")
        merged = rows.repartition("bucket", "term", "into").sortWithinPartitions("bucket", "term", "into", "first").drop("bucket").mapInArrow(_released(rebuild), POSTINGS)
        self._write(generation, merged)
        # Readers turn to the merged generation when its totals are there, and no longer look at older ones.
        self._totals().agg(F.sum("n").alias("n"), F.sum("length").alias("length")).coalesce(1).write.parquet(f"{self.path}/totals/base={generation}")
        for x, name in old.items():
            for part in (f"totals/{name}", f"postings/generation={x}"):
                _delete(self.spark, f"{self.path}/{part}")
        return generation

    # -- reading

    def _seen(self) -> dict[int, str]:
        """Generations that count, with their totals' folders: the latest merged one (``base``) and those after it, each once its totals are written."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/totals")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return {}
        names = [x.getPath() for x in fs.listStatus(root)]
        done = {int(p.getName().split("=")[1]): p.getName() for p in names if "=" in p.getName() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}
        base = max((g for g, name in done.items() if name.startswith("base=")), default=-1)
        return {g: name for g, name in done.items() if g >= base}

    def _generations(self) -> list[int]:
        return sorted(self._seen())

    def _postings(self, terms: list[str] | None = None) -> DataFrame:
        seen = self._generations()
        if not seen:
            return self.spark.createDataFrame([], _STORED)
        found = self.spark.read.schema(_STORED).option("basePath", f"{self.path}/postings").parquet(*(f"{self.path}/postings/generation={x}" for x in seen))
        if terms is None:
            return found.where(F.col("bucket") != TOTALS)
        # The terms' folders, from the same hash on the driver: literals, so that folders are pruned before listing tasks.
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"))).distinct().collect()]
        return found.where(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms))

    def blocks(self, terms: list[str] | None = None) -> DataFrame:
        """Bounds without postings."""
        return self._postings(terms).drop("ids", "tfs", "dls")

    def _totals(self) -> DataFrame:
        return self.spark.read.schema("n bigint, length bigint").parquet(*(f"{self.path}/totals/{x}" for x in self._seen().values()))

    def dictionary(self, terms: list[str] | None = None) -> DataFrame:
        """(term, df) of all terms or of the given ones."""
        return self.blocks(terms).groupBy("term").agg(F.sum("n").cast("bigint").alias("df"))

    def _weights(self, terms: list[str]) -> tuple[dict[str, float], float]:
        """Weight of each query term that occurs, and the mean length: numbers of the query's size."""
        if not terms:
            raise ValueError("the query has no terms")
        if not self._generations():
            return {}, 1.0
        n, length = self._totals().agg(F.sum("n"), F.sum("length")).first()
        found = {r["term"]: r["df"] for r in self.dictionary(terms).collect()}
        return {t: float(np.log(1 + (n - df + 0.5) / (df + 0.5))) for t, df in found.items()}, (length / n if n else 1.0)

    def bm25(self, terms: list[str], *, k1: float = K1, b: float = B) -> DataFrame:
        """(doc_id, score) of every document with a query term; only the terms' postings are read."""
        weights, mean = self._weights(sorted(set(terms)))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                n, ids, tf, dl = _decoded(x)
                weight = np.repeat(np.array([weights[t] for t in x.column("term").to_pylist()], dtype=np.float64), n)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_bm25(weight, tf, dl, mean, k1, b))], names=["doc_id", "score"])

        if not weights:
            return self.spark.createDataFrame([], "doc_id bigint, score double")
        parts = self._postings(list(weights)).select("term", "n", "first", "ids", "tfs", "dls").mapInArrow(score, "doc_id bigint, score double")
        return parts.groupBy("doc_id").agg(F.sum("score").alias("score"))

    def top(self, terms: list[str], k: int, *, k1: float = K1, b: float = B, first_shards: int = FIRST_SHARDS) -> DataFrame:
        """(doc_id, score, rank): the ``k`` best of ``bm25``, ties to the smaller id, without scoring what cannot be among them."""
        empty = self.spark.createDataFrame([], "doc_id bigint, score double, rank bigint")
        weights, mean = self._weights(sorted(set(terms)))
        if not weights or k < 1:
            return empty
        bound = F.create_map(*(x for t, w in weights.items() for x in (F.lit(t), F.lit(w))))[F.col("term")]
        bound = bound * F.col("max_tf") * (k1 + 1) / (F.col("max_tf") + k1 * ((1 - b) + b * F.col("min_dl") / mean))
        # A document has one list per term, so a shard's best is at most the sum of its terms' best blocks.
        shards = self.blocks(list(weights)).groupBy("generation", "shard", "term").agg(F.max(bound).alias("most")).groupBy("generation", "shard").agg(F.sum("most").alias("most"))
        postings = self._postings(list(weights)).drop("bucket", "block")

        def best(chosen: DataFrame, least: float) -> DataFrame:
            read = postings.join(chosen.select("generation", "shard"), ["generation", "shard"])
            return read.repartition("generation", "shard").sortWithinPartitions("generation", "shard", "term", "first").mapInArrow(lambda x: _ranked(x, weights, mean, k1, b, k, least), "doc_id bigint, score double")

        order = [F.desc("score"), F.asc("doc_id")]
        start = best(shards.orderBy(F.desc("most"), "generation", "shard").limit(first_shards), -np.inf).orderBy(*order).limit(k)
        reached = start.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()  # two numbers
        least = reached["least"] if reached["n"] == k else -np.inf
        # Bounds and scores are sums in different orders: a hair below the threshold still counts.
        found = best(shards.where(F.col("most") >= least - 1e-9), least - 1e-9).orderBy(*order).limit(k)
        ranked = found.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("back"), "doc_id"))).alias("r"))
        return ranked.select(F.posexplode("r").alias("p", "x")).select("x.doc_id", (-F.col("x.back")).alias("score"), (F.col("p") + 1).cast("bigint").alias("rank"))

    def more_like(self, text: str, k_terms: int, *, apart: int | None = None) -> DataFrame:
        """(doc_id, score) by BM25 with the ``k_terms`` terms of ``text`` that have the largest tf times ``ln(n / df)``; ``apart`` is left out.

        Terms that the index does not have are passed over. One text's terms are looked up, nothing else is counted.
        """
        one = self.spark.createDataFrame([(text,)], "text string").select(F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("tf")).collect()
        tf = {r["term"]: r["tf"] for r in one}
        n = self._totals().agg(F.sum("n")).first()[0] if tf and self._generations() else 0
        known = self.dictionary(list(tf)).collect() if n else []
        best = sorted(((-tf[r["term"]] * np.log(n / r["df"]), r["term"]) for r in known))[:k_terms]
        if not best:
            raise ValueError("no term of the text is in the index")
        found = self.bm25([t for _, t in best])
        return found if apart is None else found.where(F.col("doc_id") != apart)


def _bucket(term):
    return F.when(term.isNull(), TOTALS).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int"))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _scores(row: dict, weight: float, mean: float, k1: float, b: float) -> tuple[np.ndarray, np.ndarray]:
    tf, dl = unpacked(row["tfs"]), unpacked(row["dls"])
    return row["first"] + np.cumsum(unpacked(row["ids"])), _bm25(weight, tf, dl, mean, k1, b)


def _bm25(weight, tf: np.ndarray, dl: np.ndarray, mean: float, k1: float, b: float) -> np.ndarray:
    return weight * tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * dl / mean))


def _decoded(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many postings each row has, and the ids, frequencies and lengths of all of them, row after row."""
    n = rows.column("n").to_numpy().astype(np.int64)
    gaps, tfs, dls = (unpacked(_bytes(rows.column(c))) for c in ("ids", "tfs", "dls"))
    # A row's first gap is 0: its ids are its first one plus what the gaps have added since.
    run, heads = gaps.cumsum(), n.cumsum() - n
    return n, run + np.repeat(rows.column("first").to_numpy() - run[heads], n), tfs, dls


def _bytes(column: pa.Array) -> bytes:
    """The values of a binary column, joined."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return data[int(ends[0]) : int(ends[-1])].to_pybytes() if data is not None and len(column) else b""


def _changes(rows: pa.RecordBatch) -> np.ndarray:
    """Whether a row's term or ``into`` differs from those of the row before it."""
    fresh = np.ones(rows.num_rows, dtype=bool)
    term, into = rows.column("term").dictionary_encode().indices.to_numpy(), rows.column("into").to_numpy()
    fresh[1:] = (term[1:] != term[:-1]) | (into[1:] != into[:-1])
    return fresh


def _bounded(spark: SparkSession) -> None:
    """Lower the rows per Arrow batch to ``ARROW_ROWS`` so that long texts fit a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def _released(batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hands freed memory back when its task ends: a reused worker would keep it."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from batches(found)
        finally:
            pa.default_memory_pool().release_unused()

    return run


def best_of_shard(rows: list[dict], weights: dict[str, float], mean: float, k1: float, b: float, k: int, least: float) -> tuple[list[tuple[int, float]], int]:
    """The shard's ``k`` best (id, score) from ``least`` on, and how many blocks were decoded.

    Block ends cut the ids into stretches; a stretch's bound is the sum of the
    bounds of the blocks over it. Stretches are scored from the highest bound
    down until the next bound is below the k-th score found.
    """
    first, last = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("first", "last"))
    tf, dl = (np.array([r[c] for r in rows], dtype=np.float64) for c in ("max_tf", "min_dl"))
    bound = np.array([weights[r["term"]] for r in rows]) * tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * dl / mean))
    edges = np.unique(np.concatenate([first, last + 1]))
    change = np.zeros(len(edges))
    np.add.at(change, np.searchsorted(edges, first), bound)
    np.add.at(change, np.searchsorted(edges, last + 1), -bound)
    over = change.cumsum()[:-1]
    decoded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    found: list[tuple[float, int]] = []
    for s in np.argsort(-over, kind="stable"):
        if over[s] <= 0 or over[s] < least - 1e-9:
            break
        lo, hi = edges[s], edges[s + 1]
        ids, scores = [], []
        for i in np.flatnonzero((first < hi) & (last >= lo)):
            if i not in decoded:
                decoded[i] = _scores(rows[i], weights[rows[i]["term"]], mean, k1, b)
            own, score = decoded[i]
            x, y = np.searchsorted(own, [lo, hi])
            ids.append(own[x:y])
            scores.append(score[x:y])
        docs, place = np.unique(np.concatenate(ids), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(scores), minlength=len(docs))
        keep = total >= least
        found += zip((-total[keep]).tolist(), docs[keep].tolist(), strict=True)
        if len(found) >= k:
            found = sorted(found)[:k]
            least = max(least, -found[-1][0])
    return [(doc, -score) for score, doc in sorted(found)[:k]], len(decoded)


def _ranked(batches: Iterator[pa.RecordBatch], weights: dict[str, float], mean: float, k1: float, b: float, k: int, least: float) -> Iterator[pa.RecordBatch]:
    """One shard at a time; the k-th score of the task's shards so far is the next one's threshold."""
    best: list[tuple[float, int]] = []
    now, rows = None, []

    def take() -> None:
        nonlocal best, least
        best = sorted([*best, *((-s, d) for d, s in best_of_shard(rows, weights, mean, k1, b, k, least)[0])])[:k]
        if len(best) == k:
            least = max(least, -best[-1][0] - 1e-9)

    for x in batches:
        for row in x.to_pylist():
            key = (row["generation"], row["shard"])
            if key != now and rows:
                take()
                rows = []
            now = key
            rows.append(row)
    if rows:
        take()
    yield pa.RecordBatch.from_arrays([pa.array([d for _, d in best], pa.int64()), pa.array([-s for s, _ in best], pa.float64())], names=["doc_id", "score"])
