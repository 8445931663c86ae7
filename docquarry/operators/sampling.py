"""Samples of an exact size in every stratum, weighted if asked, by mergeable lists of the least keys.

A row's key is ``-ln(u) / weight`` with u from the digest of a seed and its id, so a
sample does not depend on how rows are dealt out, and the ``k`` least keys are a
weighted sample without replacement. Each task keeps the ``k`` least rows of every stratum it
meets; these lists are merged, in two steps so that no task gets the lists of a stratum from all tasks.
A stratum is never gathered, sorted or counted.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks' lists of a stratum are merged in this many groups first.
GROUPS = 32


def key(id_col: Column, weight: Column | None = None, *, seed: int = 0) -> Column:
    """Exponential with rate ``weight``, from the first 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), id_col.cast("string")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.ln(u) / (weight.cast("double") if weight is not None else F.lit(1.0))


class _Least:
    """The ``k`` least (key, id) of each stratum, with their places."""

    def __init__(self, k: int):
        self.k, self.heaps = k, {}

    def offer(self, stratum, rank: tuple, place) -> None:
        heap = self.heaps.setdefault(stratum, [])
        item = (_Reversed(rank), place)
        if len(heap) < self.k:
            heapq.heappush(heap, item)
        elif rank < heap[0][0].rank:
            heapq.heapreplace(heap, item)


class _Reversed:
    __slots__ = ("rank",)

    def __init__(self, rank: tuple):
        self.rank = rank

    def __lt__(self, other: _Reversed) -> bool:
        return other.rank < self.rank


def stratified(df: DataFrame, k: int, by: str, *, id_col: str = "doc_id", weight_col: str | None = None, seed: int = 0) -> DataFrame:
    """``min(k, size)`` rows of every stratum ``by``, with all columns of ``df``.

    Rows without an id, and rows whose weight is null, zero, negative or NaN, are
    never drawn. A null stratum is a stratum. Rows that repeat an id are one draw
    after the other; ties of keys go to the smaller id. Strata are as many as a
    task can hold lists of ``k`` rows for.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    columns = df.columns
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    chosen = df.where(F.col(id_col).isNotNull() & (weight > 0) & ~F.isnan(weight))
    rows = chosen.select(F.to_json(F.struct(F.col(by).alias("s"))).alias("s"), key(F.col(id_col), weight, seed=seed).alias("k"), F.col(id_col).alias("i"), F.struct(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(columns)]).alias("row"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, held, schema = _Least(k), {}, None
        for number, b in enumerate(batches):
            schema = b.schema
            for at, (s, rank, i) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
                least.offer(s, (rank, i), (number, at))
            # Of each batch only the rows that are still among the least stay.
            held[number] = b
            wanted: dict[int, list[int]] = {}
            for heap in least.heaps.values():
                for _, (n, at) in heap:
                    wanted.setdefault(n, []).append(at)
            if len(held) > 8:
                packed, places = [], {}
                for n, part in held.items():
                    for new, at in enumerate(sorted(wanted.get(n, []))):
                        places[(n, at)] = (number, sum(map(len, packed)) + new)
                    if n in wanted:
                        packed.append(part.take(pa.array(sorted(wanted[n]))))
                held = {number: pa.Table.from_batches(packed).combine_chunks().to_batches()[0]} if packed else {}
                least.heaps = {s: [(r, places[p]) for r, p in heap] for s, heap in least.heaps.items()}
        wanted = {}
        for heap in least.heaps.values():
            for _, (n, at) in heap:
                wanted.setdefault(n, []).append(at)
        for n, at in wanted.items():
            yield held[n].take(pa.array(at)).cast(schema) if schema else held[n]

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    once = rows.mapInArrow(merge, kind)
    twice = once.repartition("s", F.pmod(F.xxhash64("i"), F.lit(GROUPS))).mapInArrow(merge, kind)
    last = twice.repartition("s").mapInArrow(merge, kind)
    return last.select(*[F.col(f"row.c{n}").alias(c) for n, c in enumerate(columns)])
