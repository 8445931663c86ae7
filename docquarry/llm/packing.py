"""Sum-of-squares online packing of token ids into fixed windows.

A document longer than the window fills whole windows; its rest, or a shorter
document, goes to one fill level. ``N[h]`` counts the partly filled windows at
level ``h``. Of the levels where the document fits (level 0: a new window) the
one is taken that leaves the smallest sum of ``N[h] ** 2``; ties go to the
fullest. Every Spark partition packs its own stream of documents. When it ends,
its open windows are closed by pouring the emptiest into the fullest, and the
one that is left is cut at powers of two, so that nothing needs padding but
windows that the caller makes by hand.

A worker holds one batch and the ids of its open windows: ``window - 1`` of
them at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OUT_BYTES, bounded_arrow, released
from .tokens import encoder, public

#: Tokens of a sequence.
WINDOW = 4096
#: Id that ends each document.
END_ID = 2
VOCABULARY = "word_bpe_49k.json"

#: A change of counts that stands for no open window at a level.
_NONE = np.int32(1 << 30)


class Packer:
    """Places (document, start, packed ids, document's tokens) pieces into windows."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int32)
        self.open: dict[int, list[list]] = {}

    def add(self, doc, ids: bytes) -> Iterator[list]:
        """Yields the windows that this document fills."""
        n, size = len(ids) // 4, self.window
        whole = n // size * size
        for at in range(0, whole, size):
            yield [(doc, at, ids[4 * at : 4 * (at + size)], n)]
        if whole < n:
            yield from self._place((doc, whole, ids[4 * whole :], n), n - whole)

    def level(self, length: int) -> int:
        """The fill level, 0 for a new window, that minimises the squared counts."""
        counts, size = self.counts, self.window
        rest = size - length
        best, cost = 0, 2 * int(counts[length]) + 1
        if rest > 1:
            # Backwards, so that the first of equal changes is the fullest level.
            here = counts[rest - 1 : 0 : -1]
            apart = np.where(here > 0, counts[size - 1 : length : -1] - here, _NONE)
            at = int(apart.argmin())
            change = 2 * int(apart[at]) + 2
            if change <= cost:
                best, cost = rest - 1 - at, change
        if counts[rest] and 1 - 2 * int(counts[rest]) <= cost:
            best = rest
        return best

    def _place(self, piece: tuple, length: int) -> Iterator[list]:
        at = self.level(length)
        pieces = self._take(at) if at else []
        pieces.append(piece)
        if at + length == self.window:
            yield pieces
        else:
            self.counts[at + length] += 1
            self.open.setdefault(at + length, []).append(pieces)

    def _take(self, level: int) -> list:
        self.counts[level] -= 1
        found = self.open[level]
        pieces = found.pop()
        if not found:
            del self.open[level]
        return pieces

    def close(self) -> Iterator[list]:
        """Pours the emptiest open windows into the fullest; the last is cut at powers of two."""
        left = [[level, pieces] for level in sorted(self.open) for pieces in self.open[level]]
        self.open, low = {}, 0
        while left[low + 1 :]:
            level, pieces = left.pop()
            while level < self.window and low < len(left):
                donor = left[low]
                doc, start, ids, n = donor[1].pop()
                take = min(self.window - level, len(ids) // 4)
                if 4 * take < len(ids):
                    donor[1].append((doc, start, ids[: -4 * take], n))
                    start, ids = start + len(ids) // 4 - take, ids[-4 * take :]
                pieces.append((doc, start, ids, n))
                level, donor[0] = level + take, donor[0] - take
                low += not donor[0]
            if level < self.window:
                left.append([level, pieces])
                break
            yield pieces
        for level, pieces in left[low:]:
            yield from self._powers(level, pieces)

    @staticmethod
    def _powers(level: int, pieces: list) -> Iterator[list]:
        rest = list(reversed(pieces))
        while level:
            need = 1 << (level.bit_length() - 1)
            level, out = level - need, []
            while need:
                doc, start, ids, n = rest.pop()
                take = min(need, len(ids) // 4)
                if 4 * take < len(ids):
                    rest.append((doc, start + take, ids[4 * take :], n))
                out.append((doc, start, ids[: 4 * take], n))
                need -= take
            yield out


def pack(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, ids, doc_tokens, sequence_id, offset.

    ``start`` counts the document's ids before the piece, ``offset`` those of
    the sequence before it. A null or empty text is the end id alone; rows that
    repeat an id or text are packed each for itself; a null id stays null; other
    columns are ignored; an empty table gives no rows. Sequence ids are unique
    over the whole result, and a sequence never spans two Spark partitions.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    path = tokenizer or public(VOCABULARY)
    bounded_arrow(df.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path).encode, Packer(window)
        sequence, out, held, kind = TaskContext.get().partitionId() << 32, [], 0, None

        def batch() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x[2] for x in out), dtype="<i4")
            lengths = np.array([len(x[2]) // 4 for x in out], dtype=np.int64)
            ends = pa.array(np.concatenate([[0], lengths.cumsum()]).astype(np.int32))
            columns = [pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.int64()), pa.array(lengths), pa.ListArray.from_arrays(ends, pa.array(ids)), pa.array([x[3] for x in out], pa.int64()), pa.array([x[4] for x in out], pa.int64()), pa.array([x[5] for x in out], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def windows() -> Iterator[list]:
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield from packer.add(doc, encode(text) + end)
            yield from packer.close()

        for pieces in windows():
            offset = 0
            for piece in pieces:
                out.append((*piece, sequence, offset))
                offset += len(piece[2]) // 4
            held, sequence = held + offset, sequence + 1
            if 4 * held >= OUT_BYTES:
                yield batch()
                out, held = [], 0
        if out:
            yield batch()

    name = df.schema[id_col].dataType.simpleString()
    made = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(rows), f"doc_id {name}, start bigint, length bigint, ids array<int>, doc_tokens bigint, sequence_id bigint, offset bigint")
    return made.withColumnRenamed("doc_id", id_col)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids in order; a group holds one window at most."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(ordered.alias("p")).select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
