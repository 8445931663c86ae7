"""Near-duplicates by SimHash and exact Jaccard similarity of five-word shingle sets.

The pigeonring chains of ``simhash`` propose pairs of fingerprints of the
shingles, which must prove a similarity of 0.8 on their whole sets. Fingerprints
miss most pairs near that bound, so a second search completes them: sets are ordered by how often a shingle occurs in a sample, then by hash. By the
pigeonhole principle two sets of similarity 0.8 share one of the first
``n - ceil(0.8 * n) + 1`` shingles of each, whatever the order; the sample only
keeps common shingles out of these prefixes. Pairs under a shared shingle must
pass the bound on their difference, and one on how many hashes they can share by
the sizes of ``PARTS`` parts of each set, before their whole sets are compared.

First each set is compared with one other under each of its shingles, and with
those that the fingerprints propose, which joins groups of copies at a cost in
proportion to the rows. Then only shingles
that still hold sets of different groups have all such pairs compared, in
bounded blocks. So the groups are exactly those of all similar pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators import graphs

from . import simhash
from .common import OUT_BYTES, Scratch, bounded_arrow, materialise, released, utf8
from .simhash import BLOCK, SEED, components

#: Words of a shingle; sets are linked from a similarity of 4 / 5 on.
SHINGLE = 5
#: Sets (in expectation) in which shingles are counted for the order, and the count from which one is common.
SAMPLE, COMMON = 10_000, 3
#: Share of a prefix that sets have in common from which they are compared before the exact search, to join copies cheaply.
COPIES = 0.3
#: Parts of a set whose sizes are compared first, and the largest size that is told.
PARTS, FULL = 128, 255
#: Pairs of one set, about, that are compared in one task.
LEADER = 1000
#: Digests of sets, 8 bytes each, up to which they are broadcast.
BROADCAST = 1_000_000


def _shingles(text: bytes) -> np.ndarray:
    import xxhash

    found = text.lower().split()
    joined = found if len(found) > SHINGLE else [b" ".join(found)] if found else []
    if len(found) > SHINGLE:
        for k in range(1, SHINGLE):
            joined = list(map(b" ".join, zip(joined, found[k:])))
    return np.unique(np.array([xxhash.xxh64_intdigest(x, SEED) for x in joined], dtype="<u8").view("<i8"))


def _sizes(hashes: np.ndarray) -> bytes:
    """Hashes in each part, by their lowest bits; ``FULL`` stands for that many and more."""
    return np.minimum(np.bincount(hashes & (PARTS - 1), minlength=PARTS), FULL).astype(np.uint8).tobytes()


def _possible(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """For pairs of sets whether they can have a similarity of 4 / 5 by the sizes of their parts."""
    x, y = (np.frombuffer(b"".join(a), np.uint8).reshape(-1, PARTS).astype(np.int64) for a in (x, y))
    both = np.minimum(x, y)
    return (9 * both.sum(axis=1) >= 4 * (x.sum(axis=1) + y.sum(axis=1))) | (x == FULL).any(axis=1) | (y == FULL).any(axis=1)


def sets(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, s, own, fp, sizes): a digest of each row's shingle set; the set's sorted hashes, its fingerprint and the sizes of its parts where a task meets it first."""
    bounded_arrow(df.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[int] = set()
        for b in batches:
            at, digests, owns, prints, sizes, held = 0, [], [], [], [], 0

            def batch(at: int, digests: list, owns: list, prints: list, sizes: list) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([b.column(0).slice(at, len(owns)), pa.array(digests, pa.int64()), pa.array(owns, pa.binary()), pa.array(prints, pa.int64()), pa.array(sizes, pa.binary())], names=[id_col, "s", "own", "fp", "sizes"])

            for text in utf8(b.column(1)):
                hashes = _shingles(text)
                own = hashes.tobytes()
                digest = int(np.uint64(xxhash.xxh64_intdigest(own, SEED)).view(np.int64))
                if len(seen) > 1_000_000:
                    seen.clear()
                digests.append(digest)
                owns.append(None if digest in seen else own)
                prints.append(None if digest in seen else simhash.majority(hashes))
                sizes.append(None if digest in seen else _sizes(hashes))
                held += len(owns[-1] or b"")
                seen.add(digest)
                if held > OUT_BYTES:
                    yield batch(at, digests, owns, prints, sizes)
                    at, digests, owns, prints, sizes, held = at + len(owns), [], [], [], [], 0
            if owns:
                yield batch(at, digests, owns, prints, sizes)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(released(rows), f"`{id_col}` {kind}, s bigint, own binary, fp bigint, sizes binary")


def _common(own: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the shingles that are common in the sample; bounded with it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, "<i8"))], names=["h"])

    drawn = own.where(F.pmod(F.xxhash64("s"), F.lit(max(1, total // SAMPLE))) == 0).select("own")
    found = drawn.mapInArrow(released(rows), "h bigint").groupBy("h").count().where(F.col("count") >= COMMON).toPandas().sort_values("h")
    return found["h"].to_numpy(np.int64), found["count"].to_numpy(np.int64)


def _prefixes(own: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(k, n, s, i): the shingles of each set's prefix, with its size and their places in the order."""
    shared = own.sparkSession.sparkContext.broadcast(common)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for b in batches:
            made, held = [], 0
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(x, "<i8")
                n = len(own)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    own = own[np.argsort(np.where(known[at] == own, counts[at], 0), kind="stable")]
                own = own[: n - (4 * n + 4) // 5 + 1]
                made.append(np.stack([own, np.full(len(own), n), np.full(len(own), s), np.arange(len(own))]))
                held += 32 * len(own)
                if held > OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(made, axis=1)], names=["k", "n", "s", "i"])
                    made, held = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(made, axis=1)], names=["k", "n", "s", "i"])

    return own.select("s", "own").mapInArrow(released(rows), "k bigint, n bigint, s bigint, i bigint")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (k, n, s): those of shingles with several sets, once, with the first set ``lead`` under it of about the size."""
    carried, before, lead = np.empty((4, 0), np.int64), None, (None, None, 0)

    def out(x: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal carried, before, lead
        x = np.concatenate([carried, x], axis=1)
        if not x.shape[1]:
            return
        x = x[:, np.append(True, (x[[0, 2], 1:] != x[[0, 2], :-1]).any(axis=0))]
        # The last row waits for the next one.
        end = x.shape[1] if last else x.shape[1] - 1
        k, size = x[0], np.floor(np.log(np.maximum(x[1], 1)) / np.log(1.25)).astype(np.int64)
        same = np.append(k[1:] == k[:-1], False)
        kept = same | np.append(before is not None and before == k[0], same[:-1])
        new = np.append((int(k[0]), int(size[0])) != lead[:2], (k[1:] != k[:-1]) | (size[1:] != size[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        leads = np.where(first >= 0, x[2, first], lead[2])
        carried = x[:, end:]
        if end:
            before, lead = int(k[end - 1]), (int(k[end - 1]), int(size[end - 1]), int(leads[end - 1]))
            own = np.flatnonzero(kept[:end])
            yield pa.RecordBatch.from_arrays([*(pa.array(c[own]) for c in x), pa.array(leads[own])], names=["k", "n", "s", "i", "lead"])

    for b in batches:
        yield from out(np.stack([np.asarray(c) for c in b.columns]).astype(np.int64), False)
    yield from out(np.empty((4, 0), np.int64), True)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by block: pairs of sets of different groups that can be similar if this shingle is the first they share."""
    held = np.empty((7, 0), np.int64)

    def of_block(n: np.ndarray, s: np.ndarray, i: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(s), 256):
            own = slice(at, at + 256)
            apart = i[own, None] + i[None, :] + np.abs((n - i)[own, None] - (n - i)[None, :])
            x, y = np.nonzero((9 * apart <= n[own, None] + n[None, :]) & (root[own, None] != root[None, :]) & (s[own, None] < s[None, :]))
            if len(x):
                yield np.stack([s[own][x], s[y]])

    def out(x: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        x = np.concatenate([held, x], axis=1)
        edges = np.flatnonzero((x[:3, 1:] != x[:3, :-1]).any(axis=0)) + 1
        bounds = np.concatenate([[0], edges, [x.shape[1]]])
        if not last:
            held, bounds = x[:, bounds[-2] :], bounds[:-1]
        found, size = [], 0
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo > 1:
                for pairs in of_block(*x[3:, lo:hi]):
                    found.append(pairs)
                    size += pairs.shape[1]
                    if size > 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(found, axis=1)], names=["a", "b"])
                        found, size = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(found, axis=1)], names=["a", "b"])

    for b in batches:
        yield from out(np.stack([np.asarray(c) for c in b.columns]).astype(np.int64), False)
    yield from out(np.empty((7, 0), np.int64), True)


def _similar(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 4 / 5 at least."""
    scratch = Scratch(own.sparkSession)
    sizes = own.select("s", "sizes").dropDuplicates(["s"])

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = pa.array(_possible(b.column(2).to_pylist(), b.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(kept) for c in (0, 1)], names=["a", "b"])

    of = lambda c, name: sizes.select(F.col("s").alias(c), F.col("sizes").alias(name))
    sized = pairs.distinct().join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y")
    pairs = scratch.keep(sized.mapInArrow(released(fitting), "a bigint, b bigint"), "nearsets-pairs")
    nodes = scratch.keep(pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct(), "nearsets-asked")
    # Few names go to where the sets are; many are joined by a shuffle.
    few = F.broadcast(nodes) if nodes.count() <= BROADCAST else nodes
    wanted = scratch.keep(own.select("s", "own").join(few, "s", "left_semi").dropDuplicates(["s"]), "nearsets-wanted")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for k, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 9 * both >= 4 * (len(x) + len(y)):
                    kept.append(k)
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(kept, pa.int64())) for c in (0, 1)], names=["a", "b"])

    # The leader of a large group has very many pairs: they are dealt out by their other set, and the leader's goes to each part.
    size = graphs.hub_size(pairs.count(), LEADER)
    for side, name, other in (("a", "x", "b"), ("b", "y", "a")):
        hubs = scratch.keep(pairs.groupBy(side).agg(F.count("*").alias("n")).where(F.col("n") > size), f"nearsets-hubs-{side}")
        joined = graphs.spread(pairs if side == "a" else joined, side, other, wanted.select(F.col("s").alias(side), F.col("own").alias(name)), hubs, size)
    found = materialise(joined.select("a", "b", "x", "y").mapInArrow(released(rows), "a bigint, b bigint"), "nearsets-links")
    scratch.clear()
    return found


def _proposed(own: DataFrame) -> DataFrame:
    """(a, b): sets whose fingerprints the pigeonring chains link; of sets with one fingerprint the least stands for them."""
    prints = own.groupBy("fp", "s").agg(F.lit(1)).select("fp", "s")
    first = prints.groupBy("fp").agg(F.min("s").alias("lead"))
    equal = prints.join(first, "fp").where("s <> lead").select(F.col("lead").alias("a"), F.col("s").alias("b"))
    near = simhash.links(first.select("fp")).where("a <> b").distinct()
    of = lambda c: first.select(F.col("fp").alias(c), F.col("lead").alias(f"{c}_set"))
    linked = near.join(of("a"), "a").join(of("b"), "b").select(F.least("a_set", "b_set").alias("a"), F.greatest("a_set", "b_set").alias("b"))
    return equal.unionByName(linked)


def links(own: DataFrame, total: int) -> DataFrame:
    """Links (a, b) between digests of sets that connect exactly those joined by steps of similarity 4 / 5."""
    scratch = Scratch(own.sparkSession)
    keyed = _prefixes(own, _common(own, total)).repartition("k").sortWithinPartitions("k", "n", "s")
    shared = scratch.keep(keyed.mapInArrow(released(_shared), "k bigint, n bigint, s bigint, i bigint, lead bigint"), "nearsets-shared")
    # Copies share much of their prefixes; pairs that share less are left to the exact search below.
    lead = shared.where("s <> lead").groupBy(F.least("s", "lead").alias("a"), F.greatest("s", "lead").alias("b")).agg(F.count("*").alias("both"), F.min("n").alias("n"))
    lead = lead.where(F.col("both") >= COPIES * (F.col("n") - F.ceil(0.8 * F.col("n")) + 1)).select("a", "b")
    first = _similar(lead.unionByName(_proposed(own)), own)
    named = shared.join(components(first), F.col("s") == F.col("node"), "left").select("k", "n", "s", "i", F.coalesce("root", "s").alias("root"))
    named = scratch.keep(named, "nearsets-named")
    mixed = named.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low <> high")
    mixed = scratch.keep(mixed.select("k", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "nearsets-mixed")
    own_block = named.join(mixed, "k").withColumn("b", F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int"))
    # Block b of a large key meets every block: pairs (i, j) with i < j hold both.
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (x != F.col("b")) | (F.col("blocks") == 1))
    dealt = own_block.select("k", F.explode(others).alias("o"), "b", "n", "s", "i", "root")
    dealt = dealt.select("k", F.least("b", "o").alias("low"), F.greatest("b", "o").alias("high"), "n", "s", "i", "root")
    dealt = dealt.repartition("k", "low", "high").sortWithinPartitions("k", "low", "high")
    rest = _similar(dealt.mapInArrow(released(_pairs), "a bigint, b bigint"), own)
    scratch.clear()
    return first.unionByName(rest)


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without the later ones of each group of near-duplicates.

    Rows are linked where the sets of their five-word shingles have a Jaccard
    similarity of 0.8 at least; null, empty and wordless texts have the empty
    set and are one group. The row with the least id stays; rows that repeat an
    id are one document and share its fate; rows without an id stay when their
    group has no id.
    """
    scratch = Scratch(df.sparkSession)
    # Under names of our own, so that an id column may have any.
    given = df.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    marks = materialise(sets(given, id_col="_doc", text_col="_text"), "nearsets")
    own = marks.where(F.col("own").isNotNull()).select("s", "own", "fp", "sizes")
    nodes = scratch.keep(marks.groupBy("s").agg(F.min("_doc").alias("least")), "nearsets-nodes")
    roots = components(links(own, nodes.count()))
    joined = scratch.keep(nodes.join(roots, nodes["s"] == roots["node"], "left").select("s", "least", F.coalesce("root", "s").alias("root")), "nearsets-roots")
    named = joined.join(joined.groupBy("root").agg(F.min("least").alias("group")), "root").select("s", "group")
    later = marks.select("_doc", "s").join(named, "s").where(F.col("_doc") != F.col("group")).select(F.col("_doc").alias("_later")).distinct()
    later = materialise(later, "nearsets-later")
    scratch.clear()
    return df.join(later, df[id_col] == later["_later"], "left_anti")
