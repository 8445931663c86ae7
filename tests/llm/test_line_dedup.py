"""Line dedup against a naive search over all runs of all texts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import linededup


def naive(rows: list[tuple], min_words: int, min_line_words: int) -> dict:
    """Text of each (id, text) after every later copy of a run is cut, by looking at every run."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    texts, first = [], {}
    for key in order:
        whole = (key[1] or "").encode()
        starts, ends, physical, words = linededup.soft_lines(whole)
        own = [(whole[a:b].strip(), p, w) for a, b, p, w in zip(starts, ends, physical, words, strict=True) if w]
        runs = [(i, j, tuple(x[0] for x in own[i:j])) for i in range(len(own)) for j in range(i + 1, len(own) + 1) if sum(x[2] for x in own[i:j]) >= min_words]
        for k, line in enumerate(whole.split(b"\n")):
            at = [i for i, x in enumerate(own) if x[1] == k]
            if at and min_line_words <= len(line.split()) < min_words:
                runs.append((at[0], at[-1] + 1, ("line", line.strip())))
        texts.append((key, own, runs))
        for i, _, run in runs:
            place = (len(texts), i)
            first[run] = min(first.get(run, place), place)
    out = {}
    for k, (key, own, runs) in enumerate(texts, 1):
        gone = np.zeros(len(own), np.uint8)
        for i, j, run in runs:
            if first[run] != (k, i):
                gone[i:j] = 1
        out[key] = key[1] if not gone.any() else linededup.deleted(key[1], gone.tobytes())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_naive_search(spark, seed, monkeypatch):
    monkeypatch.setattr(linededup, "CHUNK", 64)
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(30)) for _ in range(rng.choice([1, 3, 6, 9, 30, 70]))) for _ in range(14)]
    rows = [(None, pool[0]), (5, None), (6, ""), (7, " \n\n "), (8, "  " + pool[4] + "  \n" + pool[4])]
    for k in range(10, 40):
        parts = [rng.choice(pool) if rng.random() < 0.5 else f"own{k} " * rng.randrange(1, 30) + str(rng.random()) for _ in range(rng.randrange(1, 6))]
        rows.append((k, rng.choice(["\n", " ", "\n"]).join(parts)))
    rows += [rows[8], rows[9]]
    want = naive(rows, 8, 3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(c) for c in ("_digest", "_gone", "_id", "_row", "_n", "key", "kept", "mark", "rest", "n")})
    got = linededup.remove_repeats(docs, min_words=8, min_line_words=3, count_col="n").collect()
    assert len(got) == len(rows)
    of = {r[0]: r for r in rows}
    for r in got:
        assert r["text"] == want[of[r["doc_id"]]], r["doc_id"]
        assert (r["n"] > 0) == (r["text"] != of[r["doc_id"]][1])
        assert all(r[c] == c for c in ("_digest", "_gone", "_id", "_row", "_n", "key", "kept", "mark", "rest"))


def test_digests_depend_on_the_word_alone(monkeypatch):
    monkeypatch.setattr(linededup, "SLICE", 16)
    data = b"one two a-very-long-word-beyond-a-slice one " + b"y" * 50 + b" two  one"
    ends = np.array([k for k, x in enumerate(data) if x == 32] + [len(data)])
    starts = np.append(0, ends[:-1] + 1)
    found = linededup._digests(np.frombuffer(data, np.uint8), starts, ends)
    words = data.split(b" ")
    assert len(set(found.tolist())) == len(set(words))
    assert all((found[i] == found[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))


def test_a_repeated_short_line_goes_and_splits_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BUCKET", 2)
    monkeypatch.setattr(linededup, "RANGES", 3)
    line = "All rights reserved by the owner"
    rows = [(k, f"text number{k} of many others\n{line}\nend{k}") for k in range(30)]
    got = {r["doc_id"]: r["text"] for r in linededup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0] == rows[0][1] and all(got[k] == f"text number{k} of many others\nend{k}" for k in range(1, 30))
