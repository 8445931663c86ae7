"""Each stage of the pipeline on what its predecessor kept, against a plain version of the same."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_line_dedup import naive
from test_llm import ODD, plain_ids, prose

from docquarry.llm import linededup, toxicity

SHARED, LEAK = prose(70, 80), prose(999, 30)
INSULTS = "blockhead dimwit nitwit numbskull".split()


def corpus() -> tuple[list[tuple], list[tuple], list[tuple]]:
    rng, docs, labels = random.Random(1), [r for r in ODD if r[0] not in (None, 5)], []
    for k in range(100, 400):
        body = prose(k, rng.randrange(30, 90)).split()
        if k % 4 == 0:
            for _ in range(6):
                body.insert(rng.randrange(len(body)), rng.choice(INSULTS))
        labels.append((k, int(k % 4 == 0)))
        docs.append((k, " ".join(body)))
    labels += [(100, 1), (102, None), (9999, 1), (None, 1)]
    docs += [(500, prose(101, 90)), (501, "head of it " + SHARED), (502, prose(50, 40) + " " + SHARED + " " + prose(51, 40)), (503, prose(52, 40) + " " + LEAK)]
    changed = prose(600, 70).split()
    docs += [(600, " ".join(changed)), (601, " ".join(changed[:35] + ["other"] + changed[36:])), (602, prose(600, 70)), (603, "a line of its own here\n" + prose(603, 60)), (604, "a line of its own here\n" + prose(604, 60))]
    return docs, labels, [(1, LEAK), (2, prose(888, 30)), (3, None), (4, "")]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """[(name, rows before, rows after)] by the stages' own functions, and the labels and items."""
    import corpus_pipeline

    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs, labels, items = corpus()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in docs], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, x) for k, x in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    found, now = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, path = now.collect(), f"{folder}/{name}"
        made = stage(spark, now, folder)
        assert name == "packing" or made.columns == now.columns
        made.write.parquet(path)
        now = spark.read.parquet(path)
        found[name] = (before, now.collect())
    whole = sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect()))
    assert whole == sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in found["packing"][1])
    return found, labels, items


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def plain_evidence(docs: list[tuple], labels: list[tuple]):
    """A function of a text, (sum of log ratios, words), and the calibration rows, counted with plain dictionaries."""
    label = {}
    for k, x in labels:
        if k is not None and x is not None and zlib.crc32(str(k).encode()) % 5:
            label[k] = max(label.get(k, 0), x)
    least = {}
    for k, t in sorted((k, t) for k, t in docs if k in label):
        least.setdefault(t, k)
    rows = [(zlib.crc32(str(k).encode()) % 5, t, label[k]) for t, k in least.items()]
    counted = [(t, y) for f, t, y in rows if f < 4]
    size = [sum(y == c for _, y in counted) for c in (0, 1)]

    def told(n0: int, n1: int) -> bool:
        both = (n0 + n1) / sum(size)
        if both >= 1:
            return False
        part = lambda k, n: (k * math.log(k / (n * both)) if k else 0) + ((n - k) * math.log((n - k) / (n * (1 - both))) if k < n else 0)
        return 2 * (part(n0, size[0]) + part(n1, size[1])) >= 16

    floor = 16 / (2 * math.log(sum(size) / min(size)))
    n = [Counter(), Counter()]
    for t, y in counted:
        n[y].update(set(words(t)))
    total = [sum(c.values()) for c in n]
    known = {w for w in n[0].keys() | n[1].keys() if n[0][w] + n[1][w] >= floor}
    pairs = [Counter(), Counter()]
    for t, y in counted:
        own = [w if w in known else None for w in words(t)]
        pairs[y].update(set(zip(own, own[1:])))
    s, types = [Counter(), Counter()], [Counter(), Counter()]
    for c in (0, 1):
        for (v, _), m in pairs[c].items():
            s[c][v] += m
            types[c][v] += 1
    kept = [p for p in pairs[0].keys() | pairs[1].keys() if None not in p and pairs[0][p] + pairs[1][p] >= floor and told(pairs[0][p], pairs[1][p])]
    speaking = {w for w in known if told(n[0][w], n[1][w])}
    vocabulary = speaking | {w for _, w in kept}
    before = defaultdict(set)
    for _, t in docs:
        own = words(t)
        for v, w in zip(own, own[1:]):
            before[w if w in vocabulary else None].add(v)
    counts = [{w: n[c][w] for w in vocabulary} | {None: total[c] - sum(n[c][w] for w in vocabulary)} for c in (0, 1)]
    mass = sum(len(before[w]) + 0.5 for w in counts[0])
    p = []
    for c in (0, 1):
        freed = sum(min(x, 0.75) for x in counts[c].values())
        p.append({w: (x - min(x, 0.75) + freed * (len(before[w]) + 0.5) / mass) / total[c] for w, x in counts[c].items()})
    for w in counts[0]:
        if w not in speaking:
            p[0][w] = p[1][w] = (p[0][w] + p[1][w]) / 2
    behind = lambda c, v, w: (max(pairs[c][v, w] - 0.75, 0) + 0.75 * types[c][v] * p[c][w]) / s[c][v] if s[c][v] else p[c][w]
    word = {w: math.log(p[1][w] / p[0][w]) for w in vocabulary}
    bigram = {(v, w): math.log(behind(1, v, w) / behind(0, v, w)) - word[w] for v, w in kept}

    def evidence(text: str | None) -> tuple[float, int]:
        own = words(text)
        return sum(word.get(w, 0.0) for w in own) + sum(bigram.get(x, 0.0) for x in zip(own, own[1:])), len(own)

    return evidence, [(t, y) for f, t, y in rows if f == 4]


def test_toxicity_stage(spark, stages):
    found, labels, _ = stages
    before, after = found["toxicity"]
    docs = [(r["doc_id"], r["text"]) for r in before]
    evidence, last = plain_evidence(docs, labels)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    for _, t in docs:
        assert np.allclose(model.evidence(t), evidence(t)), t
    # The curve is where the loss over the calibration rows has no slope.
    seen = [(*evidence(t), y) for t, y in last if words(t)]
    x = np.array([(1.0, a / n, a / n * math.sqrt(n)) for a, n, _ in seen])
    y, scale = np.array([r[2] for r in seen], float), np.maximum(np.abs(x).mean(axis=0), 1e-9)
    chance = 1 / (1 + np.exp(-(x @ np.array(model.curve))))
    assert np.abs((x / scale).T @ (chance - y) + toxicity.PULL * np.array(model.curve) * scale).max() < 1e-4

    def score(text: str | None) -> float:
        a, n = evidence(text)
        mean = a / n if n else 0.0
        return 1 / (1 + math.exp(-(np.array(model.curve) @ (1.0, mean, mean * math.sqrt(n)))))

    assert sorted(r["doc_id"] for r in after) == sorted(k for k, t in docs if score(t) < 0.5)
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {k for k in range(100, 400) if k % 4 == 0}


def test_line_dedup_stage(stages):
    before, after = stages[0]["line_dedup"]
    want = naive([(r["doc_id"], r["text"]) for r in before], linededup.MIN_WORDS, linededup.MIN_LINE_WORDS)
    assert {(r["doc_id"], r["text"]) for r in after} == {(k, t) for (k, _), t in want.items()}
    assert len(after) == len(before) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after)
    text = {r["doc_id"]: r["text"] for r in after}
    assert "own here" in text[603] and "own here" not in text[604] and len(text[502]) < 0.75 * len(dict(corpus()[0])[502])


def test_near_duplicates_stage(stages):
    before, after = stages[0]["near_duplicates"]
    sets = {}
    for r in before:
        w = [x.lower() for x in (r["text"] or "").split()]
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {k: k for k in sets}
    for a in sorted(sets):  # groups are merged by naming all their members anew
        for b in sorted(sets):
            x, y = sets[a], sets[b]
            if group[a] != group[b] and (x == y or 10 * len(x & y) >= 8 * len(x | y)):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if g == old else g for k, g in group.items()}
    assert sorted(r["doc_id"] for r in after) == sorted(set(group.values()))
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(texts[r["doc_id"]] == r["text"] for r in after)


def test_decontamination_stage(stages):
    found, _, items = stages
    before, after = found["decontamination"]
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [words(t)] if w for i in range(max(1, len(w) - 9))}
    holds = lambda w: any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if not holds(words(r["text"])))
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {503}


def test_packing_stage(stages):
    before, after = stages[0]["packing"]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in after:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == {r["doc_id"] for r in before}
    for r in before:
        ids, at = np.array(plain_ids("word_bpe_49k.json", r["text"]) + [2], "<u4"), 0
        for p in sorted(pieces[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in sequences.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == np.cumsum([0] + [p["length"] for p in own])[:-1].tolist() and sum(p["length"] for p in own) <= 4096
