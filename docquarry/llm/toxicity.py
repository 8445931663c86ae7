"""Toxicity by class-conditional Kneser-Ney bigram models.

The vocabulary has the words that tell the classes apart, those that end a
bigram that does, and one symbol for all others. For each class c the
probability of a word after another is the discounted bigram count plus a share
of the class's word probability, which is the discounted word count plus a share
of one distribution for both classes: in how many different contexts the word
was seen at all, over every document of the corpus, labelled or not. Class
counts are numbers of different texts, so copies and repetitions inside one text
weigh once. An expression that is rare, or whose counts in the two classes a
common rate explains (by the likelihood-ratio statistic), is left to the shared
distribution and cancels out instead of speaking for the class that happened to
hold it: without that, chance counts of rare words and the classes' mix of
languages outweigh the few words that matter. A document's evidence is its
log-likelihood ratio by length, and a logistic curve, fitted on labelled
documents that the counts did not see, turns it into a score.

Class counts are of the labelled rows of the training folds, at most about
``max_labelled`` of them; so are the tables that go to the workers. Contexts are
counted over all documents, by a distributed aggregation.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_arrow, released
from .decontaminate import words as _split

#: Folds by crc32 of the id: 0 is held out, the last calibrates, the others are counted.
FOLDS = 5
#: Labelled rows that a model is fitted on at most (in expectation, by hash of the id).
MAX_LABELLED = 100_000
DISCOUNT = 0.75
#: Likelihood-ratio statistic from which the classes are taken to use an expression at different rates.
SIGNIFICANT = 16.0
#: Pull of the curve's weights to zero.
PULL = 0.1
#: Values of a context's digest; a vocabulary has at most 2 ** 21 words.
CONTEXT = 1 << 42
#: Number of all words that have none of their own.
UNKNOWN = 0


@dataclass
class Model:
    """Log ratios toxic to ordinary: of words, and of bigrams beyond their second word; and the curve."""

    word: dict[bytes, float]
    bigram: dict[bytes, float]
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def evidence(self, text: str | None) -> tuple[float, int]:
        """Sum of log ratios, and the number of words."""
        found = words(text)
        if not found:
            return 0.0, 0
        total = sum(filter(None, map(self.word.get, found)), 0.0)
        if self.bigram:
            total += sum(filter(None, map(self.bigram.get, map(b" ".join, zip(found, found[1:])))), 0.0)
        return total, len(found)

    def score(self, text: str | None) -> float:
        total, n = self.evidence(text)
        bias, by_mean, by_root = self.curve
        mean = total / n if n else 0.0
        return float(1 / (1 + np.exp(-np.clip(bias + by_mean * mean + by_root * mean * np.sqrt(n), -30, 30))))


def words(text: str | None) -> list[bytes]:
    return _split((text or "").lower())


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, modulo ``FOLDS``; a null id is in fold 0."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % FOLDS, F.lit(0))


def _counted(docs: DataFrame) -> DataFrame:
    """(w, n0, n1): texts of each class with the word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def batch() -> pa.RecordBatch:
            grams = list(counts[0].keys() | counts[1].keys())
            out = [pa.array(grams, pa.binary()).cast(pa.string())] + [pa.array([c[g] for g in grams], pa.int64()) for c in counts]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(out, names=["w", "n0", "n1"])

        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[int(label)].update(set(words(text)))
                if len(counts[0]) + len(counts[1]) > 100_000:
                    yield batch()
        if counts[0] or counts[1]:
            yield batch()

    made = docs.select("text", "label").mapInArrow(released(rows), "w string, n0 bigint, n1 bigint")
    return made.groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _counted_pairs(docs: DataFrame, numbers: Broadcast) -> DataFrame:
    """(v, w, n0, n1): texts of each class with the bigram, as numbers of words; a word without one is ``UNKNOWN``."""
    base = len(numbers.value) + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, labels, size = numbers.value, [], [], 0

        def batch() -> pa.RecordBatch:
            pairs, at = np.unique(np.concatenate(held), return_inverse=True)
            toxic = np.bincount(at, weights=np.repeat(labels, [len(x) for x in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(np.bincount(at) - toxic), pa.array(toxic)], names=["pair", "n0", "n1"])

        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = words(text)
                own = np.fromiter((known.get(x, UNKNOWN) for x in found), np.int64, len(found))
                if len(own) > 1:
                    held.append(np.unique(own[:-1] * base + own[1:]))
                    labels.append(int(label))
                    size += len(held[-1])
                if size > 1_000_000:
                    yield batch()
                    held, labels, size = [], [], 0
        if size:
            yield batch()

    made = docs.select("text", "label").mapInArrow(released(rows), "pair bigint, n0 bigint, n1 bigint")
    summed = made.groupBy("pair").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return summed.select(F.expr(f"pair div {base}L").alias("v"), (F.col("pair") % base).alias("w"), "n0", "n1")


def _contexts(docs: DataFrame, vocabulary: Broadcast, text_col: str) -> DataFrame:
    """(w, contexts): for each number of the vocabulary, after how many different words it stands in any document.

    A pair is one number, the word's before 42 bits of the context's digest. A
    batch sends it once, and nothing is gathered by word before pairs are distinct.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known, digest, held, size = vocabulary.value, xxhash.xxh64_intdigest, [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], names=["pair"])

        for b in batches:
            for text in b.column(0).to_pylist():
                found = words(text)
                if len(found) > 1:
                    own = np.array([known.get(x, UNKNOWN) for x in found[1:]], np.int64)
                    before = np.array([digest(x) for x in found[:-1]], dtype=np.uint64) & np.uint64(CONTEXT - 1)
                    held.append(own * CONTEXT + before.astype(np.int64))
                    size += len(own)
                if size > 1_000_000:
                    yield batch()
                    held, size = [], 0
        if size:
            yield batch()

    pairs = docs.select(F.col(text_col).alias("text")).mapInArrow(released(rows), "pair bigint").distinct()
    return pairs.groupBy(F.expr(f"pair div {CONTEXT}L").alias("w")).agg(F.count("*").alias("contexts"))


def labelled(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(fold, text, label) of the labelled rows outside fold 0, about ``max_labelled`` at most.

    A label is null (ignored), 0 or not 0; an id with several labels has the
    highest. The sampled ids are few enough to broadcast by that bound, so the
    texts are not shuffled.
    """
    known = labels.where(F.col(label_col).isNotNull() & (fold(F.col(id_col)) != 0)).groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) != 0).cast("int")).alias("label"))
    total = known.count()
    if total > max_labelled:
        known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int((1 << 20) * max_labelled / total))
    # Of equal texts the least id stays; only ids and digests are moved for that.
    digests = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("h")).join(F.broadcast(known), "_id")
    chosen = digests.groupBy("h").agg(F.min(F.struct("_id", "label")).alias("least")).select("least.*")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "_id").select(fold(F.col("_id")).alias("fold"), "text", "label")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Count, smooth and calibrate. Without labels of both classes every score is the share of the one.

    Null and empty texts have no words; rows of equal text are counted once; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_arrow(spark)
    scratch = Scratch(spark)
    rows = scratch.keep(labelled(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_labelled=max_labelled), "toxicity-labelled")
    counted = rows.where(F.col("fold") < FOLDS - 1)
    sizes = {r[0]: r[1] for r in counted.groupBy("label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        scratch.clear()
        return Model({}, {}, (4.0 if sizes.get(1) else -4.0, 0.0, 0.0))
    model = _model(docs, counted, sizes, text_col, scratch)
    model = _calibrated(model, rows)
    scratch.clear()
    return model


def _model(docs: DataFrame, counted: DataFrame, sizes: dict[int, int], text_col: str, scratch: Scratch) -> Model:
    spark = docs.sparkSession
    # With fewer texts no expression can reach the statistic, so nothing that counts is left out here.
    least = SIGNIFICANT / (2 * np.log((sizes[0] + sizes[1]) / min(sizes[0], sizes[1])))
    frequent = F.col("n0") + F.col("n1") >= float(least)
    told = _statistic(sizes[0], sizes[1]) >= SIGNIFICANT
    # Words of several labelled texts, so as many as the sample allows; numbered from 1.
    counts = scratch.keep(_counted(counted), "toxicity-words")
    total = [r or 0 for r in counts.agg(F.sum("n0"), F.sum("n1")).first()]
    seen = sorted(tuple(r) for r in counts.where(frequent).select("w", "n0", "n1", told.alias("told")).collect())
    if not seen or not total[0] or not total[1]:
        return Model({}, {})
    numbers = spark.sparkContext.broadcast({r[0].encode(): k for k, r in enumerate(seen, 1)})
    pairs = scratch.keep(_counted_pairs(counted, numbers), "toxicity-bigrams")
    numbers.destroy()
    after = pairs.groupBy("v").agg(*(F.sum(f"n{k}").alias(f"s{k}") for k in (0, 1)), *(F.sum((F.col(f"n{k}") > 0).cast("long")).alias(f"t{k}") for k in (0, 1)))
    kept = pairs.where(frequent & told & (F.col("v") != UNKNOWN) & (F.col("w") != UNKNOWN)).join(after, "v").toPandas()
    # What follows is as long as there are telling expressions in the sample.
    chosen = sorted({k for k, r in enumerate(seen, 1) if r[3]} | set(kept["w"].tolist()))
    vocabulary = spark.sparkContext.broadcast({seen[w - 1][0].encode(): k for k, w in enumerate(chosen, 1)})
    contexts = np.zeros(len(chosen) + 1)
    for w, n in _contexts(docs, vocabulary, text_col).collect():
        contexts[w] = n
    vocabulary.destroy()
    n = np.array([[0, 0]] + [seen[w - 1][1:3] for w in chosen], dtype=float)
    n[UNKNOWN] = np.array(total) - n.sum(axis=0)
    p = word_probabilities(n, contexts)
    telling = np.array([False] + [seen[w - 1][3] for w in chosen])
    p[~telling] = p[~telling].mean(axis=1, keepdims=True)
    at = np.searchsorted(chosen, kept["w"].to_numpy()) + 1
    behind = [bigram_probability(kept[f"n{c}"].to_numpy(), kept[f"s{c}"].to_numpy(), kept[f"t{c}"].to_numpy(), p[at, c]) for c in (0, 1)]
    gain = np.log(behind[1] / behind[0]) - np.log(p[at, 1] / p[at, 0])
    ratio = np.log(p[:, 1] / p[:, 0])
    name = lambda w: seen[int(w) - 1][0]
    word = {name(w).encode(): float(ratio[k]) for k, w in enumerate(chosen, 1) if ratio[k]}
    return Model(word, {f"{name(v)} {name(w)}".encode(): float(g) for v, w, g in zip(kept["v"], kept["w"], gain, strict=True)})


def word_probabilities(n: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Of each word (row) and class (column): discounted counts, and the discounts shared out by contexts; each column sums to 1."""
    shared = (contexts + 0.5) / (contexts + 0.5).sum()
    freed = np.minimum(n, DISCOUNT)
    return (n - freed + freed.sum(axis=0) * shared[:, None]) / n.sum(axis=0)


def bigram_probability(n: np.ndarray, followed: np.ndarray, types: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Of words after a context that ``followed`` texts and ``types`` different words follow; a class that never saw it backs off wholly."""
    seen = (np.maximum(n - DISCOUNT, 0) + DISCOUNT * types * word) / np.maximum(followed, 1)
    return np.where(followed > 0, seen, word)


def _statistic(size0: int, size1: int) -> Column:
    """Twice the log-likelihood by which two rates for n0 of size0 and n1 of size1 texts beat a common one."""
    def part(k: Column, n: int, rate: Column) -> Column:
        there = F.when(k > 0, k * F.ln(k / (n * rate))).otherwise(0.0)
        return there + F.when(k < n, (n - k) * F.ln((n - k) / (n * (1 - rate)))).otherwise(0.0)

    both = (F.col("n0") + F.col("n1")) / (size0 + size1)
    return F.when(both < 1, 2 * (part(F.col("n0"), size0, both) + part(F.col("n1"), size1, both))).otherwise(0.0)


def _calibrated(model: Model, rows: DataFrame) -> Model:
    """Logistic regression of the label on mean and mean times root of the length, over the last fold."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def evidence(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.evidence(x) for x in texts]
        return pd.DataFrame({"total": [x[0] for x in found], "n": [x[1] for x in found]})

    seen = rows.where(F.col("fold") == FOLDS - 1).select(F.pandas_udf(evidence, "total double, n int")("text").alias("e"), "label").select("e.total", "e.n", "label").toPandas()
    shared.destroy()
    seen = seen[seen.n > 0]
    mean = (seen.total / seen.n).to_numpy()
    x = np.stack([np.ones(len(seen)), mean, mean * np.sqrt(seen.n.to_numpy())], axis=1)
    y, weights = seen.label.to_numpy(dtype=float), np.zeros(3)
    scale = np.maximum(np.abs(x).mean(axis=0), 1e-9) if len(x) else np.ones(3)
    x = x / scale
    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float(np.logaddexp(0, z).sum() - y @ z + PULL / 2 * at @ at)

    for _ in range(100):  # Newton's method; a step is halved until it helps
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PULL * np.eye(3), x.T @ (y - p) - PULL * weights)
        while loss(weights + step) > loss(weights) and np.abs(step).max() > 1e-9:
            step = step / 2
        weights = weights + step
        if np.abs(step).max() < 1e-7:
            break
    model.curve = tuple(float(a) for a in weights / scale)
    return model


def score(text: Column, model: Model, docs: DataFrame) -> Column:
    """Score from 0 to 1 of a text column; null and empty texts get the curve's value for no evidence."""
    bounded_arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return F.pandas_udf(lambda texts: pd.Series([shared.value.score(x) for x in texts], dtype="float64"), "double")(text)


def ordinary(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``; all columns stay as they are."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    return docs.where(score(docs[text_col], model, docs) < threshold)
