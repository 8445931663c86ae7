"""Exact duplicates by naming blocks: equal texts end with the same integer, different ones never do.

A text without its white space is cut into blocks of a fixed number of bytes.
Blocks are dealt out, sorted and numbered: a block's name is an integer, equal
blocks share it. Then adjacent names are paired, the pairs are sorted and named
in turn, until one name stands for the whole text. A name is given to content
that was compared byte by byte, so no digest can collide. A block or pair that
one document alone holds ends that document early: no other can be equal to it.

Documents are handled in chunks of bounded size. A chunk asks for each different
block once, and the answers come back to it in one row: a block that a third of
all documents hold is one entry per chunk in the task that names it, and a group
of copies is never gathered. Each level is written as a table, so a lost
executor costs a re-read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_arrow, released, utf8

#: Bytes of a block, and bytes of text after which a chunk is full.
BLOCK_BYTES, CHUNK_BYTES = 2048, 2 << 20
WHITE_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: A name holds its level, the task that gave it and a running number: 6, 22 and 35 bits.
LEVEL_SHIFT, TASK_SHIFT = 57, 35

_STATE = "chunk bigint, done array<struct<doc:int,name:bigint,alone:boolean>>, open array<int>, lists array<array<int>>, keys array<binary>, several array<boolean>"


def _distinct(lists: list[list[bytes]]) -> tuple[list[list[int]], list[bytes], list[bool]]:
    """Each list by places in the list of different keys, that list, and whether several documents hold the key."""
    place: dict[bytes, int] = {}
    holder: list[int] = []
    several: list[bool] = []
    out = []
    for doc, keys in enumerate(lists):
        at = []
        for key in keys:
            i = place.setdefault(key, len(holder))
            if i == len(holder):
                holder.append(doc)
                several.append(False)
            elif holder[i] != doc:
                several[i] = True
            at.append(i)
        out.append(at)
    return out, list(place), several


def _chunks(df: DataFrame, text_col: str, carry: list[str], block_bytes: int) -> DataFrame:
    """One row per chunk: its documents (carried columns, code points, digest) and its different blocks."""
    row = ",".join(f"`c{i}`:{df.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, docs, blocks, size, kind = TaskContext.get().partitionId() << 32, [], [], 0, None

        def full() -> pa.RecordBatch:
            lists, keys, several = _distinct(blocks)
            carried = pa.concat_arrays([x[0] for x in docs])
            held = pa.StructArray.from_arrays([carried, pa.array([x[1] for x in docs], pa.int32()), pa.array([x[2] for x in docs])], ["row", "chars", "sha"])
            one = pa.array([0, len(docs)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.ListArray.from_arrays(one, held), pa.array([list(range(len(docs)))], pa.list_(pa.int32())), pa.array([lists], pa.list_(pa.list_(pa.int32()))), pa.array([keys], pa.list_(pa.binary())), pa.array([several])],
                names=["chunk", "docs", "open", "lists", "keys", "several"],
            )

        for b in batches:
            kind = kind or b.schema
            rows = pa.StructArray.from_arrays(b.columns[2:], [f"c{i}" for i in range(len(carry))])
            for i, (text, chars) in enumerate(zip(utf8(b.column(0)), b.column(1).to_pylist(), strict=True)):
                plain = text.translate(None, WHITE_SPACE)
                blocks.append([plain[x : x + block_bytes] for x in range(0, len(plain), block_bytes)] or [b""])
                docs.append((rows.slice(i, 1), chars, hashlib.sha256(plain).hexdigest()))
                size += len(plain) + 64
                if size >= CHUNK_BYTES:
                    yield full()
                    docs, blocks, size, number = [], [], 0, number + 1
        if docs:
            yield full()

    given = df.select(F.col(text_col).alias("t"), F.coalesce(F.length(text_col), F.lit(0)).alias("n"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
    return given.mapInArrow(released(cut), f"chunk bigint, docs array<struct<row:struct<{row}>,chars:int,sha:string>>, open array<int>, lists array<array<int>>, keys array<binary>, several array<boolean>")


def _answers(state: DataFrame, level: int) -> DataFrame:
    """(chunk, names): the name of each key of the chunk and whether other documents hold it, in no order."""
    asked = state.select("chunk", F.arrays_zip("keys", "several").alias("asked")).select("chunk", F.posexplode("asked").alias("place", "asked"))
    asked = asked.select("chunk", "place", F.col("asked.several").alias("several"), F.col("asked.keys").alias("key"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, run = (level << LEVEL_SHIFT) | (TaskContext.get().partitionId() << TASK_SHIFT), None, 0
        held: list | None = None  # the latest row: whether its key is shared is known once the next row is seen

        for b in batches:
            chunk, place, name, shared = [], [], [], []
            for c, p, s, key in zip(*(x.to_pylist() for x in b.columns), strict=True):
                same = key == last
                if held is not None:
                    held[3] = held[3] or same
                    for out, x in zip((chunk, place, name, shared), held, strict=True):
                        out.append(x)
                run, last = (run + 1, last) if same else (1, key)
                now += not same
                held = [c, p, now, s or run > 1]
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(place, pa.int32()), pa.array(name, pa.int64()), pa.array(shared, pa.bool_())], names=["chunk", "place", "name", "shared"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in held[:1]] + [pa.array([held[1]], pa.int32()), pa.array([held[2]]), pa.array([held[3]])], names=["chunk", "place", "name", "shared"])

    ordered = asked.repartition(F.xxhash64("key")).sortWithinPartitions("key")
    named = ordered.mapInArrow(released(name), "chunk bigint, place int, name bigint, shared boolean")
    # One entry per different key of a chunk: bounded by the chunk.
    return named.groupBy("chunk").agg(F.collect_list(F.struct("place", "name", "shared")).alias("names"))


def _advance(state: DataFrame, answers: DataFrame) -> DataFrame:
    """The next level: documents with one name, or a name of their own, are done; the others' names are paired."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {k: [] for k in ("chunk", "done", "open", "lists", "keys", "several")}
            for chunk, held, lists, names in zip(*(x.to_pylist() for x in b.columns), strict=True):
                named: list = [None] * len(names)
                for x in names:
                    named[x["place"]] = (x["name"], x["shared"])
                done, still, pairs = [], [], []
                for doc, places in zip(held, lists, strict=True):
                    found = [named[i] for i in places]
                    own = next((n for n, shared in found if not shared), None)
                    if own is not None or len(found) == 1:
                        done.append({"doc": doc, "name": found[0][0] if own is None else own, "alone": own is not None})
                    else:
                        raw = np.array([n for n, _ in found], dtype="<i8").tobytes()
                        still.append(doc)
                        pairs.append([raw[i : i + 16] for i in range(0, len(raw), 16)])
                made = _distinct(pairs)
                for k, x in zip(out, (chunk, done, still, *made), strict=True):
                    out[k].append(x)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["chunk"], pa.int64()),
                    pa.array(out["done"], pa.list_(pa.struct([("doc", pa.int32()), ("name", pa.int64()), ("alone", pa.bool_())]))),
                    pa.array(out["open"], pa.list_(pa.int32())),
                    pa.array(out["lists"], pa.list_(pa.list_(pa.int32()))),
                    pa.array(out["keys"], pa.list_(pa.binary())),
                    pa.array(out["several"], pa.list_(pa.bool_())),
                ],
                names=list(out),
            )

    return state.join(answers, "chunk").select("chunk", "open", "lists", "names").mapInArrow(released(pair), _STATE)


def _identities(chunks: DataFrame, scratch: Scratch) -> DataFrame:
    """(chunk, doc, name, alone): one name for every document, equal for equal texts alone."""
    state, done, level = chunks, [], 0
    while True:
        state = scratch.keep(_advance(state, _answers(state, level)), f"block-level-{level}")
        done.append(state.select("chunk", F.inline("done")))
        # A count, not the documents; the number of levels is the logarithm of the longest text's blocks.
        if not state.agg(F.sum(F.size("open"))).first()[0]:
            break
        state, level = state.where(F.size("open") > 0), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``df``: ``row`` (struct of the carried columns c0, c1, ...), keep_id, group_size, kept, name, text_sha256.

    The first carried column is the id; others are ``carry``. Texts are equal
    when they are identical without space, tab, line feed, vertical tab, form
    feed and carriage return. A null text is empty, and empty texts are one
    group. Of a group the row with the most code points stays, then the one
    with the smallest id (a null id counts as the largest); of rows that repeat
    both, exactly one, whichever comes first in the files. An empty table gives
    no rows. Columns of ``df`` may have any name.
    """
    bounded_arrow(df.sparkSession)
    columns = [id_col, *(x for x in carry or [] if x != id_col)]
    scratch = Scratch(df.sparkSession)
    chunks = scratch.keep(_chunks(df, text_col, columns, block_bytes), "block-chunks")
    ids = chunks.schema["docs"].dataType.elementType["row"].dataType
    levels = Scratch(df.sparkSession)
    named = scratch.keep(_identities(chunks, levels).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("doc", "name", "alone"))).alias("named")), "block-names")
    levels.clear()

    rows = named.join(chunks.select("chunk", "docs"), "chunk").select("chunk", F.explode(F.arrays_zip("docs", "named")).alias("x")).where(~F.col("x.named.alone"))
    # The largest of these stays; a null id comes after all others.
    rank = F.struct(F.col("x.docs.chars").alias("chars"), F.col("x.docs.row.c0").isNotNull().alias("known"))
    asked = rows.select("chunk", F.col("x.named.name").alias("name"), rank.alias("rank"), F.col("x.docs.row.c0").alias("id"), F.struct("chunk", F.col("x.named.doc").alias("doc")).alias("at"))

    def best(found: DataFrame, by: list[str], size) -> DataFrame:
        """The first of (more code points, smaller id, earlier place), by three minima in one aggregate of a struct."""
        order = F.struct((-F.col("rank.chars")).alias("a"), (~F.col("rank.known")).alias("b"), F.col("id").alias("c"), F.col("at").alias("d"))
        held = found.groupBy(*by).agg(size.alias("size"), F.min(order).alias("first"))
        return held.select(*by, "size", F.struct((-F.col("first.a")).alias("chars"), (~F.col("first.b")).alias("known")).alias("rank"), F.col("first.c").alias("id"), F.col("first.d").alias("at"))

    # Combined by chunk first, so that a large group is one entry per chunk.
    per_chunk = scratch.keep(best(asked, ["chunk", "name"], F.count("*")), "block-groups")
    totals = best(per_chunk, ["name"], F.sum("size")).select("name", "size", F.col("id").alias("keep"), "at")
    told = per_chunk.select("chunk", "name").join(totals, "name").groupBy("chunk").agg(F.collect_list(F.struct("name", "size", "keep", "at")).alias("told"))
    whole = chunks.select("chunk", "docs").join(named, "chunk").join(told, "chunk", "left")

    kinds = ids.simpleString()
    id_kind = ids["c0"].dataType.simpleString()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = b.column(1)
            for i, (chunk, names, told) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                held = docs.slice(i, 1).flatten()
                row, sha = held.field("row"), held.field("sha")
                answers = {x["name"]: x for x in told or []}
                own = row.field("c0")
                keep, size, kept = own.to_pylist(), [1] * len(row), [True] * len(row)
                for x in names:
                    if not x["alone"]:
                        a, doc = answers[x["name"]], x["doc"]
                        keep[doc], size[doc], kept[doc] = a["keep"], a["size"], (a["at"]["chunk"], a["at"]["doc"]) == (chunk, doc)
                yield pa.RecordBatch.from_arrays([row, pa.array(keep, own.type), pa.array(size, pa.int64()), pa.array(kept), pa.array([x["name"] for x in names], pa.int64()), sha], names=["row", "keep_id", "group_size", "kept", "name", "text_sha256"])

    return whole.select("chunk", "docs", "named", "told").mapInArrow(released(settle), f"row {kinds}, keep_id {id_kind}, group_size bigint, kept boolean, name bigint, text_sha256 string")


def report(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 for every row of ``df``, those of copies too."""
    return groups(df, id_col=id_col, text_col=text_col).select(F.col("row.c0").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    columns = [id_col, *(x for x in df.columns if x != id_col)]
    place = {c: f"c{i}" for i, c in enumerate(columns)}
    kept = groups(df, id_col=id_col, text_col=text_col, carry=columns).where("kept")
    return kept.select(*[F.col(f"row.{place[c]}").alias(c) for c in df.columns])
