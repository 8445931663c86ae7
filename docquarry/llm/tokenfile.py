"""Token ids in ORC files: ordered by document, with row indexes and Bloom filters.

Files hold ascending, disjoint ranges of document ids (one file, one shard).
Spark's ORC writer packs the integers by run-length encoding, cuts stripes,
keeps minima and maxima of every row group and a Bloom filter on the document
id; readers take stripes in parallel and skip those that a filter on the id
excludes. Each row also stores how many ids its shard holds before it, so a
global position is that plus the total of the shards before: one small number
per file instead of a sort of all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import OUT_BYTES, bounded_arrow, released
from .tokens import encoder, public

END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Bytes of a stripe, and rows between two entries of its row index.
STRIPE_BYTES, INDEX_ROWS = 16 << 20, 1000


def write(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode every text and write (doc_id, shard, before, n_tokens, ids) as ORC under ``path``.

    A null or empty text is the end id alone. Rows are in ascending id order,
    nulls first; rows that repeat an id are ordered by their text. Other
    columns are ignored. An empty table writes files without rows.
    """
    vocabulary = tokenizer or public(VOCABULARY)
    bounded_arrow(df.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, before = encoder(vocabulary).encode, TaskContext.get().partitionId(), 0
        docs, packed = [], []

        def batch() -> pa.RecordBatch:
            nonlocal before
            lengths = np.array([len(x) // 4 for x in packed], dtype=np.int64)
            ends = np.concatenate([[0], lengths.cumsum()])
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
            columns = [pa.array(docs, kind), pa.array(np.full(len(docs), shard, dtype=np.int32)), pa.array(ends[:-1] + before), pa.array(lengths), ids]
            before += int(ends[-1])
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard", "before", "n_tokens", "ids"])

        size, kind = 0, None
        for b in batches:
            kind = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs.append(doc)
                packed.append(encode(text) + end)
                size += len(packed[-1])
                if size >= OUT_BYTES:
                    yield batch()
                    docs, packed, size = [], [], 0
        if docs:
            yield batch()

    name = df.schema[id_col].dataType.simpleString()
    ordered = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    encoded = ordered.mapInArrow(released(rows), f"doc_id {name}, shard int, before bigint, n_tokens bigint, ids array<int>")
    options = {"compression": "zstd", "orc.stripe.size": STRIPE_BYTES, "orc.create.index": "true", "orc.row.index.stride": INDEX_ROWS, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01}
    encoded.write.options(**options).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids from the files; a filter on doc_id reaches the stripes."""
    rows = spark.read.orc(path)
    # One row per shard, that is per written file: bounded by the number of partitions, so it may be broadcast.
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "ids")


def digests(rows: DataFrame, *, ids_col: str = "ids", keep: list[str]) -> DataFrame:
    """``keep`` columns, n_tokens and ids_crc32 of the little-endian unsigned 32-bit ids; a null list counts as empty."""
    bounded_arrow(rows.sparkSession)
    schema = ", ".join(f"`{x}` {rows.schema[x].dataType.simpleString()}" for x in keep)

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(len(keep))
            offsets = ids.offsets.to_numpy(zero_copy_only=False)
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            ends = [(4 * x, 4 * y) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            columns = [*b.columns[: len(keep)], pa.array(np.diff(offsets).astype(np.int64)), pa.array([zlib.crc32(raw[x:y]) for x, y in ends], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", "ids_crc32"])

    return rows.select(*keep, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids")).mapInArrow(released(crc), f"{schema}, n_tokens bigint, ids_crc32 bigint")
