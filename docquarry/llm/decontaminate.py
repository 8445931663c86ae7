"""Benchmark decontamination by Wu-Manber search over words.

The symbols are words and a pattern is a window of an item's words. For each
pattern length the shift table says, for a block of two words, how far the
window may move on without passing over an occurrence; a block that is in no
pattern moves it by the whole window less one word. Where the shift is zero, the bucket of
that suffix block lists the patterns to compare word by word.

A benchmark beyond a block of bounded bytes is searched for block by block, each
in a pass of its own over a written table, so that neither the driver nor a
worker ever holds more than one block of it.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_arrow, materialise

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Bytes of benchmark text that are searched for in one pass, and so broadcast at once.
BLOCK_BYTES = 2 << 20

_KEPT = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: A-Z to a-z, bytes of words to themselves, all others to a space.
_TABLE = bytes(x + 32 if 0x41 <= x <= 0x5A else x if x in _KEPT else 32 for x in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII of the text with A-Z lower-cased; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Search:
    """Tables of all windows of some items, one set for each window length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        owners: dict[int, dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            found = words(text)
            size = min(window, len(found))
            for at in range(len(found) - size + 1 if size else 0):
                owners[size][tuple(found[at : at + size])].add(item)
        self.tables = [self._tables(size, patterns) for size, patterns in owners.items()]

    @staticmethod
    def _tables(size: int, patterns: dict[tuple, set[str]]) -> tuple:
        block = min(2, size)
        shift: dict[tuple, int] = {}
        buckets: dict[tuple, list] = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(block, size + 1):
                key = pattern[end - block : end]
                shift[key] = min(shift.get(key, size), size - end)
            buckets[pattern[size - block :]].append((list(pattern), items))
        return size, block, shift, dict(buckets)

    def hits(self, found: list[bytes]) -> tuple[list[int], list[str]]:
        """Positions of words in any occurrence, ascending, and the items that occur."""
        hit: set[int] = set()
        items: set[str] = set()
        n = len(found)
        for size, block, shift, buckets in self.tables:
            get, far, end = shift.get, size - block + 1, size
            while end <= n:
                step = get(tuple(found[end - block : end]), far)
                if step:
                    end += step
                    continue
                for pattern, owners in buckets[tuple(found[end - block : end])]:
                    if found[end - size : end] == pattern:
                        hit.update(range(end - size, end))
                        items |= owners
                end += 1
        return sorted(hit), sorted(items)


#: The search that this worker last built, by the broadcast it came from.
_searches: dict[str, Search] = {}
_HITS = "n_words int, hits array<int>, items array<string>"


def _search(text: Column, items: list[tuple[str, str]], window: int, spark) -> tuple:
    """Column of hits of these items alone, and the broadcast that it needs."""
    key, part = uuid.uuid4().hex, spark.sparkContext.broadcast(items)

    def search(texts: pd.Series) -> pd.DataFrame:
        if key not in _searches:
            _searches.clear()
            _searches[key] = Search(part.value, window)
        found = [words(x) for x in texts]
        each = [_searches[key].hits(x) for x in found]
        return pd.DataFrame({"n_words": [len(x) for x in found], "hits": [x[0] for x in each], "items": [x[1] for x in each]})

    return F.pandas_udf(search, _HITS)(text), part


def with_hits(docs: DataFrame, benchmark: DataFrame, *, out_col: str = "hits", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``out_col``: struct<n_words int, hits array<int>, items array<string>>; a column of that name is replaced.

    ``hits`` are the word positions inside any occurrence of a window, ``items``
    the items that occur, as strings, in order. A null text has no words. A null
    item id is called ``null``; items without words never occur; items may
    repeat; an empty benchmark hits nothing. Rows may repeat.
    """
    spark = docs.sparkSession
    bounded_arrow(spark)
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    block = lambda k: [(r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()]
    if n == 1:
        return docs.withColumn(out_col, _search(docs[text_col], block(0), window, spark)[0])
    scratch, found = Scratch(spark), None
    marked = materialise(docs.select(F.struct(*docs.columns).alias("kept"), F.monotonically_increasing_id().alias("row")), "decontaminate-docs")
    text = F.col("kept").getField(text_col)
    for k in range(n):
        column, part = _search(text, block(k), window, spark)
        own = scratch.keep(marked.select("row", column.alias("h")).where(F.size("h.hits") > 0).select("row", "h.hits", "h.items"), "decontaminate-block")
        part.destroy()
        found = own if found is None else found.unionByName(own)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    merged = materialise(found.groupBy("row").agg(union("hits"), union("items")), "decontaminate-hits")
    scratch.clear()
    count = F.pandas_udf(lambda texts: pd.Series([len(words(x)) for x in texts], dtype="int32"), "int")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    hits = F.struct(count(text).alias("n_words"), F.coalesce("hits", none("int")).alias("hits"), F.coalesce("items", none("string")).alias("items"))
    out = marked.join(merged, "row", "left").select("kept", hits.alias("h"))
    return out.select(*(F.col("kept").getField(c).alias(c) for c in docs.columns if c != out_col), F.col("h").alias(out_col))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs; all columns stay as they are."""
    kept = docs.select(F.struct(*docs.columns).alias("kept"), F.col(text_col).alias("text"))
    found = with_hits(kept, benchmark, window=window, block_bytes=block_bytes)
    return found.where(F.size("hits.hits") == 0).select(*(F.col("kept").getField(c).alias(c) for c in docs.columns))


def report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: its words, hit words, items and their digest; repeated rows are repeated."""
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text")) if id_col != "text" else docs.select(id_col)
    found = with_hits(texts, benchmark, out_col="h", window=window, block_bytes=block_bytes)
    return found.select(
        id_col,
        F.col("h.n_words").cast("long").alias("n_words"),
        F.size("h.hits").cast("long").alias("n_hit"),
        F.size("h.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("h.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("h.hits") > 0).alias("contaminated"),
    )
