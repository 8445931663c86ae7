"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is a ring of eight one-byte segments. If two differ in at most
three bits, then some segment starts a chain whose first ``l`` segments differ
in at most ``3 * l / 8`` bits for every ``l`` (the ring form of the pigeonhole
principle). So the first two segments of that chain are equal and the next
three differ in one bit at most, which leaves two of those three equal: each
fingerprint gets a key for each of eight starts and three ways to leave a
segment out, 32 bits each, and every linked pair shares one. Pairs under a key
must pass the chain's later budgets before the whole distance is taken.

Equal fingerprints are merged first, so a group of copies is one row. A key
never emits its pairs: a worker compares one bounded block of it and emits the
links of a spanning forest; a key with more rows than a block is dealt out as
pairs of blocks. Groups are then the connected components of those links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators import graphs

from .common import bounded_arrow, materialise, released, utf8

SEED = 42
#: Bits in which linked fingerprints may differ, segments of the ring, and words of a shingle.
DISTANCE, SEGMENTS, SHINGLE = 3, 8, 3
#: Fingerprints that are compared with one another in one go.
BLOCK = 2048


def _fingerprint(text: bytes, words: int) -> int:
    import xxhash

    digest, found = xxhash.xxh64_intdigest, text.lower().split()
    if not found:
        return 0
    if len(found) <= words:
        hashes = [digest(b" ".join(found), SEED)]
    else:
        joined = found
        for k in range(1, words):
            joined = list(map(b" ".join, zip(joined, found[k:])))
        hashes = [digest(x, SEED) for x in joined]
    return majority(np.array(hashes, dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """Of 64-bit hashes the bits that are set in over half of them, as a signed long; zero for none."""
    raw = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(raw), 1 << 16):  # a slice at a time: a very long text stays small
        ones += np.unpackbits(raw[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(raw), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """``id_col`` and the 64-bit fingerprint ``fp`` (a signed long) of every row.

    Words are runs of bytes other than space and U+0009 to U+000D of the text
    with A-Z lower-cased. Fewer words than a shingle make one shingle; a null
    or wordless text has fingerprint zero. Other columns are ignored.
    """
    bounded_arrow(df.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([_fingerprint(x, words) for x in utf8(b.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), found], names=[id_col, "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(released(rows), f"`{id_col}` {kind}, fp bigint")


def _chain_keys(distinct: DataFrame) -> DataFrame:
    """(k, r): the chain's key, and the fingerprint turned so that the chain starts at its top byte."""
    keys = []
    for start in range(SEGMENTS):
        turned = "fp" if not start else f"(shiftleft(fp, {8 * start}) | shiftrightunsigned(fp, {64 - 8 * start}))"
        for way, kept in enumerate((0xFFFF00FFFF, 0xFFFFFF00FF, 0xFFFFFFFF00)):
            keys.append(f"struct({(3 * start + way)}L * {1 << 40}L + (shiftrightunsigned({turned}, 24) & {kept}L) as k, {turned} as r)")
    return distinct.selectExpr(f"inline(array({', '.join(keys)}))")


def _links(ring: np.ndarray) -> np.ndarray:
    """Of rows under one key: for each row the first row of its linked group."""
    n = len(ring)
    near = np.zeros((n, n), dtype=bool)
    for at in range(0, n, 256):
        apart = ring[at : at + 256, None] ^ ring[None, :]
        fits = np.ones(apart.shape, dtype=bool)
        for segments in range(5, SEGMENTS):  # the chain's prefixes of 5, 6 and 7 segments, and then all
            fits &= np.bitwise_count(apart >> np.uint64(64 - 8 * segments)) <= DISTANCE * segments // SEGMENTS
        near[at : at + 256] = fits & (np.bitwise_count(apart) <= DISTANCE)
    label = np.arange(n)
    while True:
        lower = np.where(near, label[None, :], n).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by group: links (a, b) between fingerprints, a spanning forest for each group."""

    def turned_back(group_key: int, ring: np.ndarray) -> np.ndarray:
        by = np.uint64(8 * ((group_key >> 40) // 3))
        return ring if not by else (ring >> by) | (ring << (np.uint64(64) - by))

    held_keys, held = np.empty((3, 0), dtype=np.int64), np.empty(0, dtype=np.uint64)

    def links(keys: np.ndarray, ring: np.ndarray, last: bool):
        nonlocal held_keys, held
        keys, ring = np.concatenate([held_keys, keys], axis=1), np.concatenate([held, ring])
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        bounds = np.concatenate([[0], edges, [len(ring)]]) if len(ring) else np.zeros(1, dtype=np.int64)
        if not last and len(bounds) > 1:
            held_keys, held = keys[:, bounds[-2] :], ring[bounds[-2] :]
            bounds = bounds[:-1]
        a, b = [], []
        for x in np.flatnonzero(np.diff(bounds) > 1):
            own = ring[bounds[x] : bounds[x + 1]]
            first = _links(own)
            moved = np.flatnonzero(first != np.arange(len(own)))
            if len(moved):
                own = turned_back(int(keys[0, bounds[x]]), own).view(np.int64)
                a.append(own[moved])
                b.append(own[first[moved]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    for batch in batches:
        columns = [np.asarray(x) for x in batch.columns]
        yield from links(np.stack(columns[:3]).astype(np.int64), columns[3].astype(np.int64).view(np.uint64), False)
    yield from links(np.empty((3, 0), dtype=np.int64), np.empty(0, dtype=np.uint64), True)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints joined by steps of at most three bits.

    ``distinct`` has one row per fingerprint, ``fp``. Two linked fingerprints
    may be joined by a path instead of a row of their own.
    """
    keyed = _chain_keys(distinct)
    sizes = keyed.groupBy("k").count().where(F.col("count") > BLOCK)
    large = materialise(sizes.select("k", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "simhash-large")
    near = keyed.join(large, "k", "left_anti").select("k", F.lit(0).alias("i"), F.lit(0).alias("j"), "r")
    # Block b of a large key meets every block: pairs (i, j) with i < j hold both.
    own = keyed.join(large, "k").withColumn("b", F.pmod(F.xxhash64("r"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("b"))
    far = own.select("k", F.explode(others).alias("o"), "b", "r").select("k", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "r")
    grouped = near.unionByName(far).repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "r")
    return grouped.mapInArrow(released(_forest), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the links, the least node that it can reach; nodes with very many links are split over tasks."""
    return graphs.clusters(edges, a_col="a", b_col="b")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """One row per row of ``df``: id, ``fp`` and ``component_id``, the least id of its group.

    Null, empty and wordless texts share fingerprint zero and are linked like
    any other. A null id is never a group's least id unless all ids of the
    group are null. Repeated rows are repeated. An empty table gives no rows.
    """
    marks = materialise(fingerprints(df, id_col=id_col, text_col=text_col, words=words), "simhash")
    nodes = materialise(marks.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp")))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = materialise(joined, "simhash-roots")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "root").select("fp", "component_id")
    return marks.join(named, "fp").select(id_col, "fp", "component_id")


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """The rows of ``df`` without the later ones of each near-duplicate group.

    The row with the least id stays; rows that repeat an id are one document
    and share its fate; rows without an id stay when their group has no id.
    """
    found = near_duplicates(df, id_col=id_col, text_col=text_col, words=words)
    later = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_later")).distinct()
    return df.join(later, df[id_col] == later["_later"], "left_anti")
