"""Tokenizer alignment against plain loops over both libraries' own output."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docquarry.llm import alignment
from docquarry.llm.tokens import public

A, B = public(alignment.A_FILE), public(alignment.B_FILE)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    # The byte alphabet as the library's own pre-tokenizer shows it.
    letters = {}
    for i in range(0x800):
        if i < 0x80 or chr(i).isprintable():
            shown = "".join(x[0] for x in a.pre_tokenizer.pre_tokenize_str(chr(i)))
            letters |= dict(zip(shown, chr(i).encode(), strict=False))
    return a, b, letters


def tokens(libraries, text):
    a, b, letters = libraries
    if not text:
        return None
    ids = a.encode(" " + text, add_special_tokens=False).ids
    ta = [(i, bytes(letters[c] if c in letters else alignment._byte_letters()[c] for c in a.id_to_token(i))) for i in ids]
    tb = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    raw = (" " + text).encode()
    if b"".join(x[1] for x in ta) != raw or b"".join(x[1] for x in tb) != raw:
        return None
    return ta, tb


def spans(found):
    out, at = [], 0
    for i, raw in found:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def plainly(libraries, rows):
    linked, parts = [], []
    for _, text in rows:
        found = tokens(libraries, text)
        if found is None:
            linked.append([])
            parts.append(None)
            continue
        a, b = map(spans, found)
        start = 0
        pairs = []
        for i, s, e in a:
            while b[start][2] <= s:
                start += 1
            j = start
            while j < len(b) and b[j][1] < e:
                pairs.append((i, b[j][0]))
                j += 1
        linked.append(pairs)
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, last = [], 0
        ia = ib = 0
        for c in cuts:
            ga, gb = [], []
            while ia < len(a) and a[ia][2] <= c:
                ga.append(str(a[ia][0]))
                ia += 1
            while ib < len(b) and b[ib][2] <= c:
                gb.append(str(b[ib][0]))
                ib += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
            last = c
        assert last == a[-1][2]
        parts.append((len(a), len(b), groups))
    count = Counter(p for pairs in linked for p in set(pairs))
    top: dict[int, int] = {}
    for (i, _), n in count.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for (doc, _), pairs, part in zip(rows, linked, parts, strict=True):
        if part is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            best = sum(count[p] == top[p[0]] for p in pairs)
            out.append((doc, part[0], part[1], len(part[2]), len(pairs), best, sum(count[p] for p in pairs), hashlib.sha256(";".join(part[2]).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(df, **options):
    return sorted((tuple(x) for x in alignment.align(df, **options).collect()), key=repr)


ODD = [
    None,
    "",
    " ",
    "\n",
    "a",
    " a  b ",
    "line one\nline two\n\nline four \n five",
    "tab\there\r\nand\x00nul ​ zero",
    "a▁b",
    "<|endoftext|> <s> x</s> <unk> <0x41>",
    "Zwei Wörter, ﬁ ½ 😀😀 漢字かな",
    "don't we'll 12345 3.14 é ",
    "naïve space line",
    "word " * 3000,
    "xyzzy" * 2000,
    "a",
]


def test_odd_texts_equal_plain_loops(spark, libraries):
    rows = [*enumerate(ODD), (4, "a"), (None, "no id")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, key int, pairs int").repartition(3)
    assert made(df) == plainly(libraries, rows)


def test_whole_table_equals_plain_loops(spark, libraries):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert made(df) == plainly(libraries, [tuple(x) for x in df.select("doc_id", "text").collect()])


def test_state_is_kept_between_batches(spark, libraries, monkeypatch):
    """Runs of three tokens and batches of two rows: every document spans many batches."""
    monkeypatch.setattr(alignment, "CHUNK_PAIRS", 50)
    rows = [(i, t) for i, t in enumerate(ODD) if t is None or len(t) < 200]
    pair = alignment.loaded(A, B)
    listed = []
    for doc, text in rows:
        listed.append((doc, -1, 0, doc, b"", b""))
        for side, ids in enumerate(pair.encode(text) or ()):
            sizes = (pair.a_sizes, pair.b_sizes)[side][ids]
            ends = sizes.cumsum(dtype=np.int64)
            listed += [(doc, side, int(ends[x - 1]) if x else 0, None, ids[x : x + 3].tobytes(), sizes[x : x + 3].tobytes()) for x in range(0, len(ids), 3)]
    listed.sort(key=lambda x: (x[0], x[2], x[1]))
    machine = alignment._Sweep(pair)
    found = []
    for i in range(0, len(listed), 2):
        part = listed[i : i + 2]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        columns = [[x[k] for x in part] for k in (0, 2, 1, 3, 4, 5)]
        found += machine.take(pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=alignment._EVENT))
    found += machine.last()
    want = [(*x[:5], x[7]) for x in plainly(libraries, rows)]
    assert sorted(((*x[:6],) for x in found), key=repr) == sorted(want, key=repr)


def test_encoder_equals_the_libraries(libraries):
    """Strings of awkward parts in every order: ids are the libraries' whenever the bytes are the text's."""
    rng = np.random.default_rng(5)
    parts = ["a", "Word", " ", "  ", "\n", "\t", ".", "'s", "12", "ß", "é", "😀", "▁", " ", "-", "the ", " and", "</s>", "_"]
    pair = alignment.loaded(A, B)
    for _ in range(3000):
        text = "".join(rng.choice(parts, size=rng.integers(1, 9)))
        want, got = tokens(libraries, text), pair.encode(text)
        assert (want is None) == (got is None), text
        if want:
            assert [[i for i, _ in side] for side in want] == [x.tolist() for x in got], text


def test_empty_table_and_another_id(spark):
    assert made(spark.createDataFrame([], "doc_id bigint, text string")) == []
    df = spark.createDataFrame([("x", "a b")], "pair string, text string")
    assert made(df, id_col="pair")[0][:3] == ("x", 2, 2)


def joined(plan):
    """Rows that each join of a plan that has run has made."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return joined(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return joined(plan.plan())
    children = plan.children()
    made = [plan.metrics().apply("numOutputRows").value()] if "Join" in name else []
    return made + [x for i in range(children.size()) for x in joined(children.apply(i))]


def overlaps(libraries, rows):
    for _, text in rows:
        a, b = map(spans, tokens(libraries, text))
        yield from ((i, j) for i, s, e in a for j, t, f in b if s < f and t < e)


@pytest.mark.parametrize("copies", [5, 40])
def test_joins_make_a_row_for_each_pair_however_many_chunks_hold_it(spark, libraries, monkeypatch, copies):
    """A chunk for each document, and every chunk holds the same pairs."""
    monkeypatch.setattr(alignment, "CHUNK_PAIRS", 1)
    rows = [(i, "Tokenization of uncommon words, 3.14 and naïve spelling.") for i in range(copies)] + [(copies, "a")]
    df = alignment.align(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = sorted((tuple(x) for x in df.collect()), key=repr)
    assert found == plainly(libraries, rows)
    pairs = len(set(overlaps(libraries, rows)))
    assert sorted(joined(df._jdf.queryExecution().executedPlan())) == sorted([pairs, copies + 1])
