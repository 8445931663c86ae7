"""Alignment of two tokenizers over the same texts by a sweep over the ends of their tokens.

Both tokenizers' tokens are end events: a byte offset, a side and an id. The
events of both sides are one table, dealt out by document and sorted by offset
within a partition; up to ``RUN`` consecutive events of a side travel in one row. A
machine reads them in that order. At each offset where a token ends, the open token
of A and the open token of B overlap, which is a link, and every pair of
tokens that overlaps is met so exactly once; an offset where both end closes a
group. Between two batches it keeps only the events since the last such offset.

How often a pair of ids is linked counts documents of the whole corpus. Finished
documents make up chunks of bounded size, and a chunk sends each different pair
once with its number of documents: a pair of frequent tokens is one entry per
chunk in the task that counts it. The task lists the chunks beside the count, so
that what is found of a pair is found once, and then goes back to them.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OUT_BYTES, Scratch, bounded_arrow, released
from .tokens import public

#: Files of the two tokenizers: A by tokenizers (byte-level), B by sentencepiece.
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Events in one row, and pairs of documents after which a chunk is full.
RUN, CHUNK_PAIRS = 2048, 1_500_000
#: Texts that B gets together.
TEXTS = 50


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: visible Latin-1 as itself, the others from U+0100 on."""
    seen = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0)]
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in seen)}


#: How a byte-level file cuts texts before it merges: fixed value of the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run without a break that is longer goes to the tokenizers library, whose merging does not slow down with its square.
LONG_RUN = 1000


@dataclass
class Pair:
    """Both tokenizers: ids of texts by either, and the bytes of every id.

    Where A's ids ascend along its merges they are ranks, and texts are merged by rank (tiktoken),
    which gives the same ids in a third of the time.
    """

    a_path: str
    b_path: str

    def __post_init__(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(self.a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=self.b_path)
        letters = _byte_letters()
        added = {i: x.content.encode() for i, x in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = added[i] if i in added else bytes(letters[x] for x in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.kind = np.dtype("<u4" if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16 else "<u2")
        longest = max(map(len, [*self.a_bytes, *self.b_bytes]))
        self.size_kind = np.dtype("<u1" if longest < 1 << 8 else "<u2")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], dtype=self.size_kind) for t in (self.a_bytes, self.b_bytes))
        self.ranked = self._ranked(set(added))

    def _ranked(self, added: set[int]):
        made = json.loads(self.a.to_str())
        cut, model = made["pre_tokenizer"] or {}, made["model"]
        if made["normalizer"] or cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space") or model.get("type") != "BPE":
            return None
        merged = [model["vocab"]["".join(x.split(" ") if isinstance(x, str) else x)] for x in model["merges"]]
        if merged != sorted(merged) or model.get("dropout") or model.get("ignore_merges"):
            return None
        import tiktoken

        ranks = {raw: i for i, raw in enumerate(self.a_bytes) if raw and i not in added}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _a(self, spaced: str) -> np.ndarray | None:
        if self.ranked and " " * LONG_RUN not in spaced and max(map(len, spaced.split(" "))) < LONG_RUN:
            return np.array(self.ranked.encode_ordinary(spaced), dtype=self.kind)
        ids = self.a.encode(spaced, add_special_tokens=False).ids
        return np.array(ids, dtype=self.kind) if b"".join(map(self.a_bytes.__getitem__, ids)) == spaced.encode() else None

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """For each text the ids of space and text by A, of text by B; None without tokens."""
        for at in range(0, len(texts), TEXTS):
            part = [t or "" for t in texts[at : at + TEXTS]]
            for text, ids in zip(part, self.b.encode(part, num_threads=1), strict=True):
                spaced = " " + text
                same = text and b"".join(map(self.b_bytes.__getitem__, ids)) == spaced.encode()
                a = self._a(spaced) if same else None
                yield None if a is None else (a, np.array(ids, dtype=self.kind))

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        return next(self.encode_all([text]))


_loaded: dict[tuple[str, str], Pair] = {}


def loaded(a_path: str, b_path: str) -> Pair:
    """One pair of tokenizers for each worker process."""
    key = (a_path, b_path)
    if key not in _loaded:
        _loaded[key] = Pair(*key)
    return _loaded[key]


_EVENT = ["key", "at", "side", "doc", "ids", "sizes"]


def events(df: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str) -> DataFrame:
    """(key, at, side, doc, ids, sizes): first a row of side -1 with the document's id, then runs of end events of side 0 (A) and 1 (B).

    ``at`` is the byte offset where the run's first token starts; a token ends
    where it starts plus its size. A document without tokens has its first row alone.
    """
    bounded_arrow(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, key = loaded(a_path, b_path), TaskContext.get().partitionId() << 40
        out, size = [[] for _ in range(5)], 0
        own: list = []

        def batch(docs: pa.Array) -> pa.RecordBatch:
            taken = docs.take(pa.array(own, pa.int64()))
            keys, at, side, ids, sizes = out
            made = [pa.array(keys, pa.int64()), pa.array(at, pa.int64()), pa.array(side, pa.int32()), taken, pa.array(ids, pa.binary()), pa.array(sizes, pa.binary())]
            return pa.RecordBatch.from_arrays(made, names=_EVENT)

        for b in batches:
            for i, found in enumerate(pair.encode_all(b.column(1).to_pylist())):
                key += 1
                tokens = [(-1, 0, b"", b"")]
                for side, ids in enumerate(found or ()):
                    lengths = (pair.a_sizes, pair.b_sizes)[side][ids]
                    ends = lengths.cumsum(dtype=np.int64)
                    for x in range(0, len(ids), RUN):
                        tokens.append((side, int(ends[x - 1]) if x else 0, ids[x : x + RUN].tobytes(), lengths[x : x + RUN].tobytes()))
                for side, at, packed, lengths in tokens:
                    for to, x in zip(out, (key, at, side, packed, lengths), strict=True):
                        to.append(x)
                    own.append(i if side < 0 else None)
                    size += len(packed) + len(lengths) + 32
                if size >= OUT_BYTES:
                    yield batch(b.column(0))
                    out, own, size = [[] for _ in range(5)], [], 0
            if own:
                yield batch(b.column(0))
                out, own, size = [[] for _ in range(5)], [], 0

    given = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return given.mapInArrow(released(rows), f"key bigint, at bigint, side int, doc {kind}, ids binary, sizes binary")


_NONE = np.empty(0, dtype=np.int64)


class _Sweep:
    """The machine: takes rows in order, gives finished documents as (doc, n_a, n_b, n_groups, n_links, digest, pairs, times).

    Its state is the events since the last offset where both sides end, and of
    the document that is being read its counts, its digest so far and its pairs.
    """

    def __init__(self, pair: Pair):
        count = max(len(pair.a_bytes), len(pair.b_bytes))
        self.kind, self.size_kind = pair.kind, pair.size_kind
        self.marked = {mark: np.array([f"{mark}{i}" for i in range(count)], dtype=object) for mark in ",;|"}
        self.left = [(_NONE, _NONE), (_NONE, _NONE)]
        self.base = self.end = 0
        self.docs: list = []  # those not finished: (id, first offset)
        self._fresh()

    def _fresh(self) -> None:
        self.counts, self.digest, self.pairs = np.zeros(4, dtype=np.int64), None, []

    def take(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        got: list[list] = [[self.left[0]], [self.left[1]]]
        at, side, docs, ids, sizes = (batch.column(i).to_pylist() for i in range(1, 6))
        for i, s in enumerate(side):
            if s < 0:
                self.base = self.end
                self.docs.append((docs[i], self.base))
            else:
                ends = np.frombuffer(sizes[i], dtype=self.size_kind).cumsum(dtype=np.int64) + (self.base + at[i])
                got[s].append((np.frombuffer(ids[i], dtype=self.kind), ends))
                self.end = max(self.end, int(ends[-1]))
        (a, a_end), (b, b_end) = ((np.concatenate([x[0] for x in g]).astype(np.int64), np.concatenate([x[1] for x in g])) for g in got)
        # Both sides' ends in one order; those that occur twice close a group.
        both = np.concatenate([a_end, b_end])
        both.sort(kind="stable")
        same = both[1:][both[1:] == both[:-1]]
        upto = same[-1] if len(same) else -1
        na, nb = np.searchsorted(a_end, upto, "right"), np.searchsorted(b_end, upto, "right")
        self.left = [(a[na:], a_end[na:]), (b[nb:], b_end[nb:])]
        a, a_end, b, b_end = a[:na], a_end[:na], b[:nb], b_end[:nb]
        offsets = both[: np.searchsorted(both, upto, "right")]
        offsets = offsets[np.concatenate([[True], offsets[1:] != offsets[:-1]])] if len(offsets) else offsets
        links = (a[np.searchsorted(a_end, offsets)] << 32) | b[np.searchsorted(b_end, offsets)]
        listed = self._listed(a, a_end, b, b_end, same)
        yield from self._finish(a_end, b_end, same, offsets, links, listed)

    def _listed(self, a, a_end, b, b_end, same) -> np.ndarray:
        """Ids with the mark before them, group by group, A's before B's."""
        a_group, b_group = np.searchsorted(same, a_end), np.searchsorted(same, b_end)
        first_a, first_b = (np.concatenate([[True], g[1:] != g[:-1]])[: len(g)] for g in (a_group, b_group))
        b_before = np.concatenate([[0], np.searchsorted(b_end, same, "right")])
        a_until = np.searchsorted(a_end, same, "right")
        out = np.empty(len(a) + len(b), dtype=object)
        out[np.arange(len(a)) + b_before[a_group]] = np.where(first_a, self.marked[";"][a], self.marked[","][a])
        out[np.arange(len(b)) + a_until[b_group]] = np.where(first_b, self.marked["|"][b], self.marked[","][b])
        return out

    def _finish(self, a_end, b_end, same, offsets, links, listed) -> Iterator[tuple]:
        """Deal the finished groups out to their documents; all but the last document are complete."""
        starts = [x[1] for x in self.docs]
        stops = np.array([*starts[1:], np.iinfo(np.int64).max])
        cut = [np.concatenate([[0], np.searchsorted(x, stops, "right")]) for x in (a_end, b_end, same, offsets)]
        for i, (doc, _) in enumerate(self.docs):
            lo, hi = [c[i] for c in cut], [c[i + 1] for c in cut]
            if hi[0] > lo[0]:
                text = "".join(listed[lo[0] + lo[1] : hi[0] + hi[1]].tolist())
                if self.digest is None:
                    self.digest, text = hashlib.sha256(), text[1:]
                self.digest.update(text.encode())
                self.counts += np.subtract(hi, lo)
                self.pairs.append(links[lo[3] : hi[3]])
            if i + 1 < len(self.docs):
                yield self._document(doc)
        self.docs = self.docs[-1:]

    def _document(self, doc) -> tuple:
        pairs, times = np.unique(np.concatenate(self.pairs), return_counts=True) if self.pairs else (_NONE, _NONE)
        out = (doc, *self.counts.tolist(), self.digest.hexdigest() if self.digest else "", pairs, times)
        self._fresh()
        return out

    def last(self) -> Iterator[tuple]:
        if self.docs:
            yield self._document(self.docs[0][0])


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def chunks(found: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Sweep the events; a row per chunk of documents with the different pairs, ascending, and how many of its documents hold each."""
    kind = found.schema["doc"].dataType.simpleString()
    schema = f"chunk bigint, docs array<struct<doc:{kind},{','.join(f'{c}:bigint' for c in _COUNTS)},groups_sha256:string,pairs:int>>, places binary, times binary, pairs array<bigint>, held array<bigint>"

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = loaded(a_path, b_path), TaskContext.get().partitionId() << 32
        machine = _Sweep(pair)
        done, size, doc_kind = [], 0, None

        def full() -> pa.RecordBatch:
            every, places, held = np.unique(np.concatenate([x[6] for x in done]), return_inverse=True, return_counts=True)
            columns = [pa.array([x[i] for x in done], doc_kind if i == 0 else pa.string() if i == 5 else pa.int64()) for i in range(6)]
            docs = pa.StructArray.from_arrays([*columns, pa.array([len(x[6]) for x in done], pa.int32())], ["doc", *_COUNTS, "groups_sha256", "pairs"])
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            times = np.concatenate([x[7] for x in done]).astype("<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), one(docs), pa.array([places.astype("<u4").tobytes()]), pa.array([times.tobytes()]), one(pa.array(every)), one(pa.array(held.astype(np.int64)))],
                names=["chunk", "docs", "places", "times", "pairs", "held"],
            )

        def finished() -> Iterator[tuple]:
            nonlocal doc_kind
            for b in batches:
                doc_kind = b.schema.field("doc").type
                yield from machine.take(b)
            yield from machine.last()

        for x in finished():
            done.append(x)
            size += len(x[6]) + 32
            if size >= CHUNK_PAIRS:
                yield full()
                done, size, number = [], 0, number + 1
        if done:
            yield full()

    return found.repartition("key").sortWithinPartitions("key", "at", "side").mapInArrow(released(sweep), schema)


def align(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``df``.

    A text that is null or empty, or that a tokenizer does not give back as it
    is (B turns U+2581 into a space), has no tokens: zeros and an empty digest.
    Repeated rows are documents of their own. Other columns are ignored, and
    the id column may have any name. An empty table gives no rows.
    """
    a_path, b_path = a_path or public(A_FILE), b_path or public(B_FILE)
    kept = Scratch(df.sparkSession).keep(chunks(events(df, id_col, text_col, a_path, b_path), a_path, b_path), "align-chunks")
    told = pair_counts(kept).select(F.explode("chunks").alias("chunk"), F.struct("pair", "count", "best").alias("x")).groupBy("chunk").agg(F.collect_list("x").alias("told"))
    kind = kept.schema["docs"].dataType.elementType["doc"].dataType.simpleString()
    totals = ["n_best", "count_sum"]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                docs, told = b.column(0).slice(i, 1).flatten(), b.column(3).slice(i, 1).flatten()
                order = np.argsort(told.field("pair").to_numpy())
                count = told.field("count").to_numpy()[order]
                best = told.field("best").to_numpy(zero_copy_only=False)[order]
                places, times = (np.frombuffer(b.column(k)[i].as_py(), dtype="<u4").astype(np.int64) for k in (1, 2))
                ends = docs.field("pairs").to_numpy().cumsum()
                sums = [np.concatenate([[0], (times * x[places]).cumsum()]) for x in (best, count)]
                made = [x[ends] - x[np.concatenate([[0], ends[:-1]])] for x in sums]
                columns = [docs.field("doc"), *(docs.field(c) for c in _COUNTS), *map(pa.array, made), docs.field("groups_sha256")]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", *_COUNTS, *totals, "groups_sha256"])

    whole = kept.select("chunk", "docs", "places", "times").join(told, "chunk", "left").withColumn("told", F.coalesce("told", F.array().cast(told.schema["told"].dataType)))
    return whole.select("docs", "places", "times", "told").mapInArrow(released(settle), f"doc {kind}, {', '.join(f'{c} bigint' for c in [*_COUNTS, *totals])}, groups_sha256 string")


def pair_counts(kept: DataFrame) -> DataFrame:
    """(pair, count, best, chunks): a pair is A's id times 2**32 plus B's; best if no pair of that A id has more documents; the chunks that hold it."""
    found = kept.select("chunk", F.explode(F.arrays_zip("pairs", "held")).alias("x"))
    counts = found.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("count"), F.collect_list("chunk").alias("chunks"))
    counts = Scratch(kept.sparkSession).keep(counts, "align-counts")
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("top"))
    # A row for each id of A's vocabulary at most: sent to the pairs, so that the lists of chunks stay where they are.
    return counts.join(F.broadcast(top), F.shiftright("pair", 32) == F.col("a")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"), "chunks")
