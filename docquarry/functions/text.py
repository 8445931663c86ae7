"""Column functions over text: lines, sentences, tokens, n-grams and counts.

All of them are built-in Spark expressions. A null text gives a null result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates tokens, and what ends a sentence.
TOKEN_BREAK = r"[^\p{L}\p{N}]+"
SENTENCE_END = r"[.!?]+(?:[ \t\n\f\r]+|\z)"


def lines(text: Column) -> Column:
    """Physical lines, empty ones included."""
    return F.split(text, "\n")


def sentences(text: Column) -> Column:
    """Sentences without their final punctuation; blank ones are dropped."""
    return F.filter(F.split(text, SENTENCE_END), lambda x: F.trim(x, F.lit(" \t\n\f\r")) != "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda x: x != "")


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda inside would else compute it for each element."""
    return F.transform(F.array(value), body)[0]


def ngrams(words: Column, n: int) -> Column:
    """Contiguous n-grams of an array of tokens, joined by spaces; empty if there are fewer than ``n``."""

    def made(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>"))

    return bound(words, made)


def windows(length: Column, size: int, stride: int) -> Column:
    """Numbers of the windows of ``size`` that cover ``length`` items at steps of ``stride``; one at least."""
    last = F.greatest(F.ceil((length - size) / F.lit(float(stride))).cast("int"), F.lit(0))
    return F.sequence(F.lit(0), last)


def mean_word_length(words: Column) -> Column:
    """Mean number of characters of the tokens; null without tokens."""
    total = F.aggregate(words, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    return F.when(F.size(words) > 0, total / F.size(words))


def type_token_ratio(words: Column) -> Column:
    """Share of different tokens; null without tokens."""
    return F.when(F.size(words) > 0, F.size(F.array_distinct(words)) / F.size(words))


def content_hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def folded(text: Column) -> Column:
    """Under a collation that ignores case and accents, for comparisons."""
    return F.collate(text, "UNICODE_CI_AI")
