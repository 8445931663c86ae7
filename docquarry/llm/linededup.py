"""Repeated line runs by a suffix array over line ids, later copies deleted.

Physical lines are wrapped softly where a word's digest is the least among its
neighbours. Such points depend on the words around them alone, so a passage
pasted into a paragraph is cut like its other copies although the physical
lines differ. A line's id is the 64-bit digest of its text.

Prefix doubling gives each position the rank, in sorted order, of the
``2 ** k`` lines that start there; ranks of one level are ranked in pairs for
the next. A position whose run occurs once drops out, so levels shrink fast. The
suffixes that share their first L lines are one interval of the suffix array at
prefix length L, and the two ranks that cover those L lines name it. A run
counts from ``min_words`` words on: for every start the shortest such run, and
the longer ones that a later start could not reach, are looked up. Every
maximal repeated run is a chain of such intervals that overlap, so marking them
marks it whole, whatever its length, and longer prefixes need no level of their
own. In each interval the first copy stays and the others are deleted. Whole
physical lines of fewer words are intervals of their own, from
``min_line_words`` words on: a line that a site repeats everywhere goes too.

The texts' lines are arrays, and texts in order of id make up chunks of bounded
size. On each level a chunk sends every different interval that it holds once,
with its first start, to the bucket that has that range of the suffix array;
Spark groups the buckets, ranks and minimises there, and groups the answers by
chunk. So a hot line or passage is one entry of a chunk, whatever its number of
copies, and no text or group of copies is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OUT_BYTES, bounded_arrow, discard, materialise_at, release, released, utf8

#: Words on either side among which a soft line break's digest is the least.
RADIUS = 4
#: Words that a repeated run inside lines has at least, and that a whole physical line has: any that repeats counts.
MIN_WORDS, MIN_LINE_WORDS = 20, 1
#: Lines of a chunk (a longer text is one by itself), and different intervals of a bucket on average.
CHUNK, BUCKET = 1 << 18, 1 << 20
#: Ranges of the suffix array at most, and sampled pairs of ranks for each, from which their bounds are taken. They bound
#: what the driver holds; a range beyond ``BUCKET`` intervals is split by their digests.
RANGES, SAMPLE = 4096, 16
#: Odd, so that it has an inverse.
BASE = 0x9E3779B97F4A7C15
#: Bytes of which one running sum is taken, so that no table grows with a text.
SLICE = 1 << 18


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(size - 1, base, np.uint64)), dtype=np.uint64)


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each word that depends on its bytes alone: differences of one running sum over all.

    The sum at a place is taken modulo 2 ** 64 with powers of ``BASE``; only its
    values at the words' ends are kept, slice by slice.
    """
    low, back = _powers(BASE, SLICE), _powers(pow(BASE, -1, 1 << 64), SLICE)
    at_start, at_end, total = np.zeros(len(starts), np.uint64), np.zeros(len(ends), np.uint64), np.uint64(0)
    unshift, shift = np.empty(len(starts), np.uint64), 1
    for at in range(0, len(data) + 1, SLICE):
        part = data[at : at + SLICE]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((part + np.uint64(1)) * low[: len(part)], out=sums[1:])
        sums *= np.uint64(shift)
        sums += total
        for points, out in ((starts, at_start), (ends, at_end)):
            lo, hi = np.searchsorted(points, (at, at + SLICE))
            out[lo:hi] = sums[points[lo:hi] - at]
            if out is at_start:
                unshift[lo:hi] = back[points[lo:hi] - at] * np.uint64(pow(shift, -1, 1 << 64))
        total = sums[-1]
        shift = shift * pow(BASE, SLICE, 1 << 64) % (1 << 64)
    found = (at_end - at_start) * unshift
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    return found ^ found >> np.uint64(29)


def soft_lines(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, physical line, words) of the soft lines; joined by spaces and then by line feeds they are the text."""
    data = np.frombuffer(text, np.uint8)
    breaks = np.flatnonzero((data == 32) | (data == 10))
    starts, ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(data)]])
    line = np.concatenate([[0], np.cumsum(data[breaks] == 10)])
    own = _digests(data, starts, ends)
    least = np.bincount(line)[line] > RADIUS + 1
    for k in range(1, min(RADIUS + 1, len(own))):
        apart = line[k:] != line[:-k]
        least[k:] &= apart | (own[k:] < own[:-k])
        least[:-k] &= apart | (own[:-k] <= own[k:])
    least[0] = True
    least[1:] |= line[1:] != line[:-1]
    at = np.flatnonzero(least)
    solid = np.concatenate([[0], np.cumsum((data != 32) & ((data < 9) | (data > 13)))])
    words = np.add.reduceat((solid[ends] > solid[starts]).astype(np.int64), at)
    return starts[at], ends[np.concatenate([at[1:] - 1, [len(ends) - 1]])], line[at], words


def _runs(counts: np.ndarray, stop: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the shortest run with ``min_words`` words and the longest that its next line could not cover; 0 if its text ends (at ``stop``) before."""
    ends = np.concatenate([[0], counts.cumsum()])
    at = np.arange(len(counts))
    shortest = np.searchsorted(ends, ends[:-1] + min_words, side="left") - at
    longest = np.searchsorted(ends, ends[1:] + min_words, side="left") - 1 - at
    reached = shortest + at <= stop
    longest = np.minimum(np.maximum(longest, shortest), stop - at)
    return np.where(reached, shortest, 0), np.where(reached, longest, 0)


def lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """(id, row, rank, words, phys): 64-bit ids and numbers of words of a text's soft lines, as little-endian arrays; ``row`` is the text's digest.

    ``phys`` has, at the first soft line of a physical line of at least
    ``min_line_words`` and fewer than ``min_words`` words, that line's id, 1 at
    its further soft lines and 0 elsewhere. Soft lines without words are left
    out, and texts of too few words for either. A task returns an id and text once.
    """
    bounded_arrow(df.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        seen: set[tuple] = set()

        def batch(ids: pa.Array, digests: pa.Array, at: list[int], texts: list[bytes]) -> pa.RecordBatch:
            # Texts as physical lines of one: a text's first line follows those of the texts before it.
            whole = b"\n".join(texts)
            starts, ends, physical, words = soft_lines(whole)
            total = np.bincount(physical, weights=words)[physical]
            short = (min_line_words <= total) & (total < min_words)
            opens = np.flatnonzero(short & np.append(True, physical[1:] != physical[:-1]))
            phys = short.astype("<i8")
            closes = np.searchsorted(physical, physical[opens], side="right") - 1
            kept = words > 0
            # The id stands at the line's first soft line that has words.
            opens = opens + np.array([int(np.argmax(kept[a : z + 1])) for a, z in zip(opens.tolist(), closes.tolist(), strict=True)], dtype=np.int64)
            named = [digest(whole[starts[a] : ends[z]].strip(), 1) for a, z in zip(opens.tolist(), closes.tolist(), strict=True)]
            phys[opens] = np.maximum(np.array(named, dtype="<u8"), np.uint64(2)).view("<i8")
            starts, ends, words, phys = starts[kept], ends[kept], words[kept].astype("<i4"), phys[kept]
            bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]))
            line = np.array([digest(whole[a:b].strip()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype="<u8")
            line[line == 0] = 1  # zero marks a position that dropped out
            total = np.concatenate([[0], words.cumsum(dtype=np.int64)])
            long = np.flatnonzero(np.diff(total[bounds]) >= min(min_words, min_line_words)).tolist()
            cut = lambda x: pa.array([x[bounds[k] : bounds[k + 1]].tobytes() for k in long], pa.binary())
            index = pa.array([at[k] for k in long], pa.int64())
            return pa.RecordBatch.from_arrays([ids.take(index), digests.take(index), cut(line), cut(words), cut(phys)], names=["id", "row", "rank", "words", "phys"])

        for b in batches:
            at, texts, held = [], [], 0
            for k, (key, text) in enumerate(zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), utf8(b.column(2)), strict=True)):
                if key in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(key)
                at.append(k)
                texts.append(text)
                held += len(text)
                if held > OUT_BYTES:
                    yield batch(b.column(0), b.column(1), at, texts)
                    at, texts, held = [], [], 0
            if texts:
                yield batch(b.column(0), b.column(1), at, texts)

    kind = df.schema[id_col].dataType.simpleString()
    made = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    return made.mapInArrow(released(rows), f"id {kind}, row bigint, rank binary, words binary, phys binary")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by id and digest: the chunk and the place ``base`` of each text's first line in the sequence of all; repeated rows once."""
    base = TaskContext.get().partitionId() << 36
    chunk, before = base, None
    for b in batches:
        kept, chunks, bases = [], [], []
        for k, (key, size) in enumerate(zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), (len(x) // 8 for x in b.column(2).to_pylist()), strict=True)):
            if key == before:
                continue
            before = key
            if base + size - chunk > CHUNK:
                chunk = base
            kept.append(k)
            chunks.append(chunk)
            bases.append(base)
            base += size
        index = pa.array(kept, pa.int64())
        columns = [b.column(k).take(index) for k in range(5)]
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(bases, pa.int64()), *columns, pa.array([b""] * len(kept), pa.binary())], names=["chunk", "base", "id", "row", "rank", "words", "phys", "gone"])


def _joined(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


class _Chunk:
    """The lines of a chunk's texts, end to end."""

    def __init__(self, base: np.ndarray, rank, words, phys, min_words: int):
        self.rank, self.phys = _joined(rank, "<i8"), _joined(phys, "<i8")
        self.sizes = np.array([len(x) // 8 for x in rank.to_pylist()], dtype=np.int64)
        self.bounds = np.concatenate([[0], self.sizes.cumsum()])
        self.stop = np.repeat(self.bounds[1:], self.sizes)
        self.place = np.arange(len(self.rank)) + np.repeat(base - self.bounds[:-1], self.sizes)
        self.shortest, self.longest = _runs(_joined(words, "<i4").astype(np.int64), self.stop, min_words)

    def runs(self, level: int) -> tuple[np.ndarray, ...]:
        """(index, n, first, last): runs of up to ``2 ** level`` lines that are looked up on this level; all of that length itself."""
        if not level:  # a physical line is a run of no length
            at, own = np.arange(len(self.rank)), np.flatnonzero((self.phys != 0) & (self.phys != 1))
            first = np.concatenate([self.rank, self.phys[own]])
            return np.concatenate([at, own]), np.concatenate([np.ones(len(at), np.int64), np.zeros(len(own), np.int64)]), first, first
        half, found = 1 << (level - 1), []
        live = np.flatnonzero(self.rank)
        for n in range(half + 1, 2 * half + 1):
            at = live[live + n - half < self.stop[live]]
            at = at[self.rank[at + n - half] != 0]
            if n < 2 * half:
                at = at[(self.shortest[at] <= n) & (n <= self.longest[at])]
            found.append((at, np.full(len(at), n)))
        at, n = (np.concatenate(x) for x in zip(*found, strict=True))
        return at, n, self.rank[at], self.rank[at + n - half]

    def length(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Lines of the runs; those of a physical line reach to its end."""
        out = n.copy()
        own = np.flatnonzero(n == 0)
        if len(own):
            ends = np.append(np.flatnonzero(self.phys != 1), len(self.phys))
            out[own] = ends[np.searchsorted(ends, at[own], side="right")] - at[own]
            out[own] = np.minimum(out[own], self.stop[at[own]] - at[own])
        return out

    def different(self, level: int) -> tuple:
        """The runs, the number of the interval of each, and of each interval its (first, last, n), least place and whether it is repeated here."""
        at, n, first, last = self.runs(level)
        order, heads = _grouped(first, last, n)
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(heads) - 1
        lead = np.flatnonzero(heads)
        least = np.minimum.reduceat(self.place[at][order], lead) if len(lead) else lead
        many = np.diff(np.append(lead, len(order))) > 1
        return at, n, number, (first[order][lead], last[order][lead], n[order][lead]), least, many


def _mixed(first: np.ndarray, last: np.ndarray, n: np.ndarray) -> np.ndarray:
    mixed = (first.view(np.uint64) * np.uint64(BASE) ^ last.view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) + n.astype(np.uint64)
    return mixed ^ mixed >> np.uint64(31)


def _grouped(first: np.ndarray, last: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal triples are neighbours, and where in it a new one begins."""
    mixed = _mixed(first, last, n)
    order = np.argsort(mixed)
    heads = lambda order, columns: np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in columns], axis=0)])[: len(order)]
    new = heads(order, (first, last, n))
    if new.sum() != heads(order, (mixed,)).sum():  # two triples with one mixed value
        order = np.lexsort((n, last, first))
        new = heads(order, (first, last, n))
    return order, new


def _bucket(first: np.ndarray, last: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of pairs, in order, between the sorted ``bounds`` (two rows) that holds each pair."""
    low, high = (np.searchsorted(bounds[0], first, side=s) for s in ("left", "right"))
    out = low.copy()
    for k in np.unique(low[high > low]):
        own = np.flatnonzero((low == k) & (high > low))
        out[own] += np.searchsorted(bounds[1, k : high[own[0]]], last[own], side="right")
    return out


def _asked(level: int, bounds: np.ndarray, splits: int, min_words: int):
    """Per chunk and bucket the chunk's different intervals, as arrays; a range has ``splits`` buckets."""

    def ask(texts: pa.Table) -> pa.Table:
        texts = texts.sort_by("base")
        _, _, _, (first, last, n), least, many = _Chunk(texts["base"].to_numpy(), texts["rank"], texts["words"], texts["phys"], min_words).different(level)
        bucket = _bucket(first, last, bounds)
        if splits > 1:
            bucket = bucket * splits + (_mixed(first, last, n) % np.uint64(splits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        columns = [order.astype("<i8"), *(x[order] for x in (first, last, n, least)), many[order].astype("<i8")]
        sent = np.stack(columns, axis=1)
        parts = [sent[a:b].tobytes() for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True)] if len(order) else []
        return pa.table({"bucket": pa.array(bucket[order][edges], pa.int64()), "chunk": pa.array([texts["chunk"][0].as_py()] * len(parts), pa.int64()), "sent": pa.array(parts, pa.binary())})

    return ask


def _answered(level: int):
    """Per chunk the intervals of a bucket that occur twice: their number there, rank and first place."""

    def answer(asked: pa.Table) -> pa.Table:
        parts = asked["sent"].to_pylist()
        sent = np.frombuffer(b"".join(parts), "<i8").reshape(-1, 6)
        owner = np.repeat(np.arange(len(parts)), [len(x) // 48 for x in parts])
        first, last, n = (np.ascontiguousarray(sent[:, k]) for k in (1, 2, 3))
        order = np.lexsort((n, last, first))
        new = np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in (first, last, n)], axis=0)])
        lead, number = np.flatnonzero(new), np.cumsum(new) - 1
        least = np.minimum.reduceat(sent[order, 4], lead)
        twice = np.add.reduceat(1 + sent[order, 5], lead) > 1
        rank = (asked["bucket"][0].as_py() << 36) + 1 + number
        kept = twice[number]
        out = np.stack([sent[order, 0], rank, least[number]], axis=1)[kept]
        owner = owner[order][kept]
        by = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[by], np.arange(len(parts) + 1))
        chunks, replies = asked["chunk"].to_pylist(), out[by]
        there = [k for k in range(len(parts)) if edges[k] < edges[k + 1]]
        return pa.table({"chunk": pa.array([chunks[k] for k in there], pa.int64()), "reply": pa.array([replies[edges[k] : edges[k + 1]].tobytes() for k in there], pa.binary())})

    return answer


def _advanced(level: int, min_words: int, share: float):
    """The chunk's texts with ranks of ``2 ** level`` lines and later copies marked; a sample of the next level's pairs."""

    def advance(texts: pa.Table, replies: pa.Table) -> pa.Table:
        texts = texts.sort_by("base")
        here = _Chunk(texts["base"].to_numpy(), texts["rank"], texts["words"], texts["phys"], min_words)
        at, n, number, (first, _, _), _, _ = here.different(level)
        reply = _joined(replies["reply"], "<i8").reshape(-1, 3)
        rank, least = np.zeros(len(first), np.int64), np.full(len(first), -1)
        rank[reply[:, 0]], least[reply[:, 0]] = reply[:, 1], reply[:, 2]
        step, size = 1 << level, len(here.rank)
        wanted = (here.shortest[at] <= n) & (n <= here.longest[at]) & (here.shortest[at] > 0) | (n == 0)
        later = wanted & (least[number] >= 0) & (least[number] != here.place[at])
        marks = _joined(texts["gone"], np.uint8) if len(texts["gone"][0].as_py()) else np.zeros(size, np.uint8)
        gone = marks | _covered(at[later], here.length(at[later], n[later]), size)
        up = np.zeros(size, np.int64)
        whole = n == step
        up[at[whole]] = rank[number[whole]]
        # Only what can be part of a longer run stays: all its lines are repeated.
        ends = np.flatnonzero(up == 0) if size else up
        first_end = np.append(ends, size)[np.searchsorted(ends, np.arange(size))]
        reach = np.minimum(here.stop, first_end + step - 1) - np.arange(size)
        start = np.flatnonzero((up != 0) & (np.minimum(here.longest, reach) > step) & (here.shortest <= reach))
        up *= _covered(start, np.minimum(here.longest, reach)[start], size)
        cut = lambda x, width: [x[a:b].astype(width).tobytes() for a, b in zip(here.bounds[:-1].tolist(), here.bounds[1:].tolist(), strict=True)]
        total = np.concatenate([[0], (up != 0).cumsum()])
        live = np.diff(total[here.bounds]) > 0
        pair = np.flatnonzero(up)
        pair = pair[pair + step < here.stop[pair]]
        pairs = np.stack([up[pair], up[pair + step]], axis=1)[up[pair + step] != 0]
        mixed = (pairs[:, 0].astype(np.uint64) * np.uint64(BASE) ^ pairs[:, 1].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        drawn = np.unique(pairs[(mixed >> np.uint64(11)) < int(share * (1 << 53))], axis=0)
        sample = [drawn.astype("<i8").tobytes()] + [b""] * (len(texts) - 1)
        left = np.diff(np.concatenate([[0], gone.cumsum(dtype=np.int64)])[here.bounds])
        kept = lambda parts, there: pa.array([x if t else b"" for x, t in zip(parts, there.tolist(), strict=True)], pa.binary())
        own = {c: texts[c] for c in ("chunk", "base", "id", "row")}
        own |= {"phys": pa.array([b""] * len(texts), pa.binary())}
        own |= {"rank": kept(cut(up, "<i8"), live), "words": kept(texts["words"].to_pylist(), live), "gone": kept(cut(gone, np.uint8), live | (left > 0))}
        own = {c: own[c] for c in ("chunk", "base", "id", "row", "rank", "words", "phys", "gone")}
        release()
        return pa.table(own | {"live": pa.array(live), "n_gone": pa.array(left), "sample": pa.array(sample, pa.binary())})

    return advance


def _covered(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """1 where any of the runs (start, length) lies, else 0."""
    change = np.bincount(at, minlength=size + 1) - np.bincount(at + n, minlength=size + 1)
    return (change.cumsum()[:size] > 0).astype(np.uint8)


def _bounds(state: DataFrame, buckets: int) -> np.ndarray:
    """Pairs that cut the sampled ones into ``buckets`` ranges of equal size; the sample has about ``SAMPLE`` for each, whatever the input."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = _joined(b.column(0), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    drawn = state.where(F.octet_length("sample") > 0).select("sample").mapInArrow(released(rows), "a bigint, b bigint").distinct().collect()
    pairs = np.array(sorted((r[0], r[1]) for r in drawn), dtype=np.int64).reshape(-1, 2)
    return pairs[np.unique(np.arange(1, buckets) * len(pairs) // buckets)].T if len(pairs) else np.empty((2, 0), np.int64)


def repeated_lines(found: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, row, gone, n_gone): for texts with later copies a byte for each soft line with words, 1 where it goes.

    The first copy is the first in order of id (nulls first), digest and position.
    """
    spark = found.sparkSession
    total = int(found.agg(F.sum(F.octet_length("rank"))).first()[0] or 0) // 8
    buckets = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET + 1))
    splits = total // (BUCKET * buckets) + 1
    kind = found.schema["id"].dataType.simpleString()
    schema = f"chunk bigint, base bigint, id {kind}, row bigint, rank binary, words binary, phys binary, gone binary"
    ordered = found.repartitionByRange("id", "row").sortWithinPartitions("id", "row")
    state, path = materialise_at(ordered.mapInArrow(released(_numbered), schema), "line-chunks")
    bounds = np.repeat(np.linspace(-(2**63), 2**63, buckets + 1)[1:-1].astype(np.int64)[None], 2, axis=0)
    share, done, level = min(1.0, SAMPLE * buckets / max(total, 1)), [], 0
    while True:
        asked = state.groupBy("chunk").applyInArrow(_asked(level, bounds, splits, min_words), "bucket bigint, chunk bigint, sent binary")
        replies = asked.groupBy("bucket").applyInArrow(_answered(level), "chunk bigint, reply binary")
        step = state.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_advanced(level, min_words, share), f"{schema}, live boolean, n_gone bigint, sample binary")
        after, _ = materialise_at(step, "line-levels")
        if not level:
            discard(spark, path)
        done.append(after.where("not live and n_gone > 0").select("id", "row", "gone", "n_gone"))
        state, level = after.where("live").drop("live", "n_gone", "sample"), level + 1
        if not state.head(1):
            break
        bounds = _bounds(after, buckets)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def deleted(text: str, gone: bytes) -> str:
    """The text without the soft lines marked in ``gone``; a physical line that loses all of its own goes too."""
    whole = text.encode()
    out, pos, before = [], 0, None
    for start, end, line, words in zip(*(x.tolist() for x in soft_lines(whole)), strict=True):
        if not words or not gone[pos]:
            if before == line:
                out[-1].append(whole[start:end])
            else:
                out.append([whole[start:end]])
            before = line
        pos += words > 0
    return b"\n".join(map(b" ".join, out)).decode()


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS, count_col: str | None = None) -> DataFrame:
    """``df`` with later copies of repeated runs cut out of ``text_col``; no row is dropped.

    A run counts from ``min_words`` words on, a whole physical line from
    ``min_line_words`` on. Copies inside one text count as well. The first copy
    is the one with the least id (null first), then digest of the text, then
    position. Rows equal in id and text are one document and get the same text.
    Null and empty texts stay as they are; a text that consists of copies
    becomes empty. Texts without a copy are unchanged to the byte. ``count_col``
    gets the number of deleted soft lines, in place of a column of that name.
    Other columns stay, whatever their names.
    """
    found, path = materialise_at(lines(df, id_col=id_col, text_col=text_col, min_words=min_words, min_line_words=min_line_words), "lines")
    marked = repeated_lines(found, min_words).select(F.struct("id", "row").alias("key"), F.struct("gone", "n_gone").alias("mark"))
    discard(df.sparkSession, path)
    # The rows of ``df`` are one struct meanwhile, so that no name of theirs can clash.
    whole = df.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row")).alias("key"), F.struct(*df.columns).alias("kept"))
    joined = whole.join(marked, whole["key"].eqNullSafe(marked["key"]), "left").select("kept", "mark")

    def cut(texts: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or g is None else deleted(t, g) for t, g in zip(texts, gone, strict=True)], dtype=object)

    text = F.col("kept").getField(text_col)
    rest = F.pandas_udf(cut, "string")(F.when(F.col("mark").isNotNull(), text), F.col("mark.gone"))
    cut_out = joined.select("kept", F.coalesce(rest, text).alias("rest"), F.coalesce("mark.n_gone", F.lit(0)).cast("long").alias("n"))
    columns = [(F.col("rest") if c == text_col else F.col("kept").getField(c)).alias(c) for c in df.columns if c != count_col]
    return cut_out.select(*columns, *([F.col("n").alias(count_col)] if count_col else []))
