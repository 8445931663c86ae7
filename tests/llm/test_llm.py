"""The ten operators against brute force, exact round trips and held-out cases, on small hand-built tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import decontaminate, linededup, media, packing, pii, secrets, simhash, tokenfile, tokens, toxicity, warc

WORDS = "river stone cloud amber falcon meadow winter copper lantern harbor velvet thunder orchid saddle timber garden marble pepper canyon silver".split()
ODD = [(1, None), (2, ""), (3, "  \t\n"), (4, "one"), (5, "Zwei Wörter 😀"), (5, "Zwei Wörter 😀"), (None, "no id here"), (6, "x" * 50_000)]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(400)}" for _ in range(n))


def frame(spark, rows, extra: bool = True):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    # Names that the operators use inside.
    return df.withColumns({"row": F.lit(1), "label": F.lit("x"), "spans": F.lit(2)}) if extra else df


def plain_ids(name: str, text: str | None) -> list[int]:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.public(name)).encode(text or "", add_special_tokens=False).ids


def test_tokens_equal_the_whole_text():
    cases = ["", "Hello, world", " lead", "a  b\n\nc\td ", "it's 3.14 o'clock", "ÄÖ é x", "<|endoftext|> a", "a <|endoftext|> b", "x<|startoftext|>y z", "<|endoftext", "😀 b c", "İstanbul ẞ", prose(1, 200)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        for text in cases:
            assert np.frombuffer(tokens.Encoder(tokens.public(name)).encode(text), "<u4").tolist() == plain_ids(name, text), (name, text)


def test_packing_loses_nothing(spark):
    rows = [(k, prose(k, 10 + 37 * k)) for k in range(60)] + [r for r in ODD if r[0] is not None and r[0] != 5]
    rows = [(100 + k, t) for k, (_, t) in enumerate(rows)]
    pieces = packing.pack(frame(spark, rows), window=1024).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for doc, text in rows:
        own = sorted(by_doc[doc], key=lambda p: p["start"])
        ids = [i for p in own for i in p["ids"]]
        assert ids == plain_ids("word_bpe_49k.json", text) + [2]
        assert [p["start"] for p in own] == np.cumsum([0] + [p["length"] for p in own])[:-1].tolist()
        assert {p["doc_tokens"] for p in own} == {len(ids)}
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        total = sum(p["length"] for p in own)
        assert [p["offset"] for p in own] == np.cumsum([0] + [p["length"] for p in own])[:-1].tolist()
        assert total <= 1024 and total & (total - 1) == 0  # no sequence needs padding


def test_packing_level_is_the_least_sum_of_squares():
    rng = random.Random(3)
    for _ in range(300):
        p = packing.Packer(64)
        p.counts[1:64] = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(63)]
        length = rng.randrange(1, 64)

        def cost(level: int) -> int:
            after = p.counts.copy()
            after[level] -= level > 0
            if level + length < 64:
                after[level + length] += 1
            return int((after[1:64] ** 2).sum())

        options = [0] + [h for h in range(1, 65 - length) if p.counts[h]]
        assert cost(p.level(length)) == min(map(cost, options))


def brute_fingerprint(text: str | None) -> int:
    import xxhash

    found = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [b" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components_by_brute_force(spark):
    base = prose(9, 400).split()
    rows = [(k, prose(k, 50)) for k in range(10, 40)] + [r for r in ODD if r[0] is not None]
    for k in range(20):  # near copies
        other = list(base)
        other[17 * k] = "changed"
        rows.append((100 + k, " ".join(other)))
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(rows))]
    want = sorted((rows[i][0], fps[i], min(rows[j][0] for j in range(len(rows)) if root[j] == root[i])) for i in range(len(rows)))
    assert sorted((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == want
    kept = {r["doc_id"] for r in simhash.keep_one(frame(spark, rows)).collect()}
    assert kept == {c for _, _, c in want}


def test_chains_beyond_a_block_are_linked(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(5)
    values = {0}
    at = 0
    for _ in range(60):
        at ^= 1 << rng.randrange(12)
        values.add(at)
    values |= {rng.getrandbits(63) for _ in range(100)}
    nodes = spark.createDataFrame([(v,) for v in values], "fp bigint")
    pairs = {tuple(sorted(r)) for r in simhash.links(nodes).collect()}
    ordered = sorted(values)
    root = {v: v for v in ordered}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in ordered:
        for b in ordered:
            if a < b and (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    want = {frozenset(v for v in ordered if find(v) == r) for r in map(find, ordered)}
    root = {v: v for v in ordered}
    for a, b in pairs:
        root[find(b)] = find(a)
    assert {frozenset(v for v in ordered if find(v) == r) for r in map(find, ordered)} == want


def test_line_dedup_cuts_later_passages_only(spark):
    passage = prose(77, 70)
    rows = [(1, prose(1, 100) + " " + passage + " " + prose(2, 60)), (2, prose(3, 90) + "\n" + passage + "\n" + prose(4, 50)), (3, prose(5, 120)), (4, None), (5, ""), (6, prose(6, 300)), (6, prose(6, 300))]
    got = {(r["doc_id"], r["text"]) for r in linededup.remove_repeats(frame(spark, rows)).collect()}
    texts = dict(rows)
    out = dict(got)
    assert all(out[k] == texts[k] for k in (1, 3, 4, 5, 6))
    left = set(out[2].split())
    assert len(left & set(passage.split())) <= 40 and set(rows[1][1].split("\n")[2].split()[10:]) <= left


def test_pii_base_spans_equal_plain_patterns(spark):
    def luhn(d):
        return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    plain = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    rng = random.Random(1)
    pool = ["a.b@c.de", "@", ".", "x@y", "_d@e.f", "1.2.3.4", "256.1.1.1", "001.002.3.04", "4111 1111 1111 1111", "4111111111111111", "-", " ", "+1 (555) 010-2030", "+", "😀", "12", "é", "7"]
    rows = [(k, "".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for k in range(400)] + ODD + [(900, "1" * 3_000), (901, "a@b." * 300)]
    got = pii.detect(frame(spark, rows)).collect()
    want = sorted((str(i), [(kind, m.start(), m.end()) for kind, p, ok in plain for m in re.finditer(p, t or "", re.A) if ok(m[0])]) for i, t in rows)
    assert sorted((str(r["doc_id"]), [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "term"]) for r in got) == want


def test_pii_terms_that_disclose(spark):
    rows = [(k, f"{prose(k, 20)} contact zyxel person{k}@mail.org now {prose(k + 500, 20)}") for k in range(30)] + [(k, prose(k, 40)) for k in range(100, 400)]
    got = {r["doc_id"]: r for r in pii.detect(frame(spark, rows)).collect()}
    assert any(s["kind"] == "term" and s["match"] == "zyxel" for s in got[3]["spans"])
    assert not got[200]["spans"]


def test_pii_terms_count_copies_alike(spark):
    held = [(k, f"{prose(k, 20)} contact zyxel person{k}@mail.org now {prose(k + 500, 20)}") for k in range(6)]
    rows = held + [(1000 + k, held[0][1]) for k in range(80)] + [(k, prose(k, 40)) for k in range(100, 400)]
    got = {r["doc_id"]: r for r in pii.detect(frame(spark, rows)).collect()}
    assert all(any(s["kind"] == "term" and s["match"] == "zyxel" for s in got[k]["spans"]) for k in (0, 5, 1000, 1079))
    assert not got[200]["spans"]


def test_many_matches_of_one_text_are_placed(spark):
    text = "".join(f"😀 x{k}@host.org" + "," * (k % 7) for k in range(3 * pii.BLOCK + 5))
    got = spark.createDataFrame([(text,), ("a@b.cd",), ("",), (None,)], "text string").select(pii.base_spans(F.col("text")).alias("s")).collect()
    want = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert [(x["start"], x["end"], x["match"]) for x in got[0]["s"]] == want and len(want) == 3 * pii.BLOCK + 5
    assert [(x["start"], x["end"]) for x in got[1]["s"]] == [(0, 6)] and got[2]["s"] == got[3]["s"] == []


def test_secrets_base_and_novel():
    key = "q7Zk2Vb9Xw4LtR8mPd3NcF6h"
    found = secrets.spans(f'😀 password = "hunter22x" and AKIA{"B" * 12} {"0f" * 16} bearer {key} bearer configuration_parameter_value')
    assert [secrets.KINDS[k] for _, k, _ in found] == ["assign", "access", "hex", "novel"]
    assert found[0][0] == 2
    assert secrets.spans(None) == secrets.spans("") == []
    assert secrets.spans("token " * 50_000) == []  # linear


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(1500):
        bad = k % 4 == 0
        words = prose(k, 60).split() + (rng.sample(["vilest", "scum", "wretch", "filth"], 3) * 2 if bad else [])
        rng.shuffle(words)
        rows.append((k, re.sub(r"\d+", "", " ".join(words))))
        labels.append((k, 1, int(bad)))
    docs = frame(spark, rows + [(9001, None), (9002, "")])
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, table)
    got = docs.select("doc_id", toxicity.score(F.col("text"), model, docs).alias("score")).collect()
    held = [r for r in got if r["doc_id"] < 1500 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_token_files_round_trip(spark, tmp_path):
    rows = [(k, prose(k, 20 + k)) for k in range(50)] + [(100, None), (101, ""), (102, "😀 x")]
    tokenfile.write(frame(spark, rows), f"file://{tmp_path}/t")
    got = {r["doc_id"]: r for r in tokenfile.digests(tokenfile.read(spark, f"file://{tmp_path}/t"), keep=["doc_id", "start"]).collect()}
    start = 0
    for doc, text in sorted(rows):
        ids = plain_ids("byte_bpe_50k.json", text) + [2]
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_decontamination_by_brute_force(spark):
    items = [(k, prose(k, n)) for k, n in enumerate([30, 12, 10, 5, 1, 2])] + [(50, None), (51, "...")]
    rows = [(k, f"{prose(k + 90, 25)}, {items[k % 6][1].upper() if k % 2 else ' '.join(items[k % 6][1].split()[1:12])}; {prose(k, 9)}") for k in range(24)] + ODD
    word = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))

    def brute(text):
        w, hit, found = word(text), set(), set()
        for item, t in items:
            own = word(t)
            n = min(10, len(own))
            grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)

    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for size in (decontaminate.BLOCK_BYTES, 200):  # one block, and several
        docs = frame(spark, rows).withColumns({"h": F.lit(1), "hits": F.lit(2), "kept": F.lit(3)})
        found = decontaminate.report(docs, benchmark, block_bytes=size)
        assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, ((i, *brute(t)) for i, t in rows)))
        clean = decontaminate.decontaminate(docs, benchmark, block_bytes=size)
        assert clean.columns == docs.columns
        assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, t in rows if not brute(t)[4])
    assert decontaminate.report(frame(spark, []), benchmark).count() == 0
    assert not decontaminate.report(frame(spark, rows), benchmark.limit(0)).where("contaminated").count()


def test_warc_records_link(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "<html><head><title>T</title></head><body><p>One <b>two</b></p><script>no()</script><a href='/q'>go</a></body></html>"), (2, None, None), (3, "", "")], "page_id bigint, url string, html string")
    found = warc.responses(pages)
    sources = {r["page_id"]: r for r in found.collect()}
    got = warc.derivatives(found, keep=["page_id"]).collect()
    assert len(got) == 6
    for r in got:
        source = sources[r["page_id"]]
        assert r["refers_to"] == source["record_id"] and r["source_digest"] == source["payload_digest"]
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()
        assert f"WARC-Refers-To: {source['record_id']}" in r["head"] and f"Content-Length: {len(r['block'].encode())}" in r["head"]
    text = next(r for r in got if r["page_id"] == 1 and r["record_type"] == "conversion")
    assert text["block"] == "One two\ngo"
    fields = next(r for r in got if r["page_id"] == 1 and r["record_type"] == "metadata")
    assert text["record_id"] in fields["block"] and "title: T" in fields["block"] and "outlinks: 1" in fields["block"]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_files_round_trip(spark, tmp_path, compression):
    rows = [(1, "http://a.org/x\r\nX: y", "<p>It&#39;s &#xE9;t&#233; &amp;#39; &#0;</p>\r\n\r\n<p>next</p>"), (2, None, None), (3, "http://b.org", "x" * 100_000)]
    found = warc.responses(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    warc.write(warc.source_record(found), f"{tmp_path}/s", compression=compression)
    read = warc.read(spark, f"{tmp_path}/s")
    assert read.where("not complete").count() == 0 and read.count() == 3
    want = {r["record_id"]: r for r in found.collect()}
    back = warc.responses_of(read)
    for r in back.collect():
        source = want.pop(r["record_id"])
        assert all(r[c] == source[c] for c in ("target_uri", "headers", "payload", "payload_digest", "date"))
    assert not want
    made = warc.derivatives(back, keep=[])
    assert sorted(map(str, made.collect())) == sorted(map(str, warc.derivatives(found, keep=[]).collect()))
    text = next(r["block"] for r in made.collect() if r["record_type"] == "conversion" and "It" in r["block"])
    assert text == "It's \u00e9t\u00e9 &#39; \ufffd\nnext"
    warc.write(made, f"{tmp_path}/d", compression=compression)
    again = {r["record_id"]: r for r in warc.read(spark, f"{tmp_path}/d").collect()}
    for r in made.collect():
        other = again.pop(r["record_id"])
        assert other["complete"] and bytes(other["block"]) == r["block"].encode() and other["refers_to"] == r["refers_to"] and other["head"] == r["head"]
        assert other["block_digest"] == r["block_digest"]
    assert not again
    # Bytes of a foreign record stay as they are.
    spark.createDataFrame([("WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 4", bytearray(b"\xff\x00\r\n"))], "head string, block binary").transform(lambda d: warc.write(d, f"{tmp_path}/b", compression=compression) or d)
    one = warc.read(spark, f"{tmp_path}/b").collect()
    assert len(one) == 1 and bytes(one[0]["block"]) == b"\xff\x00\r\n" and one[0]["record_type"] == "resource" and one[0]["head"].startswith("WARC/1.0")


def _record(kind: str, block: bytes, length: int | None = None) -> bytes:
    return b"WARC/1.0\r\nWARC-Type: " + kind.encode() + b"\r\nContent-Length: %d\r\n\r\n" % (len(block) if length is None else length) + block + b"\r\n\r\n"


@pytest.mark.parametrize("split", ["128m", "200"])
def test_warc_records_have_their_stated_length(spark, tmp_path, split):
    """Blocks that hold the start of a record are one record, wherever Spark cuts the file."""
    fake = b"before\r\n\r\nWARC/1.0\r\nWARC-Type: fake\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1 after" * 5
    blocks = [b"one", fake, b"", b"\xff\x00" * 50, b"two\r\n\r\n", fake + b"x"]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(b"".join(_record("resource", x) for x in blocks))
    (tmp_path / "w" / "b.warc").write_bytes(_record("resource", b"plain") + _record("resource", b"cut off", 500))
    (tmp_path / "w" / "c.warc").write_bytes(b"".join(_record("resource", b"only %d" % i) for i in range(20)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = warc.read(spark, f"{tmp_path}/w").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["record_type"] for r in found} == {"resource"}
    assert sorted(bytes(r["block"]) for r in found if r["complete"]) == sorted([*blocks, b"plain", *(b"only %d" % i for i in range(20))])
    assert [bytes(r["block"])[:7] for r in found if not r["complete"]] == [b"cut off"]


def test_warc_gzip_has_a_member_for_each_record(spark, tmp_path):
    import gzip
    import zlib

    rows = [(f"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: {n}", b"ab" * (n // 2)) for n in (0, 6, 20 << 20)]
    warc.write(spark.createDataFrame(rows, "head string, block binary").coalesce(1), f"{tmp_path}/g", compression="gzip")
    (file,) = (tmp_path / "g").glob("*.warc.gz")
    raw, members = file.read_bytes(), []
    assert gzip.decompress(raw).count(b"WARC/1.1") == 3
    while raw:
        one = zlib.decompressobj(31)
        members.append(one.decompress(raw))
        raw = one.unused_data
    assert [len(x) for x in members if x] == [len(h) + 4 + len(b) + 4 for h, b in rows]
    assert sorted(len(r["block"]) for r in warc.read(spark, f"{tmp_path}/g").collect()) == [0, 6, 20 << 20]


def test_warc_bodies_are_decoded(spark, tmp_path):
    import gzip

    page = "<p>caf\u00e9 &eacute; &#38;lt; &amp;lt; &nosuch; &#233;</p>"
    want = "caf\u00e9 \u00e9 &lt; &lt; &nosuch; \u00e9"
    latin, utf = page.encode("latin-1"), page.encode()
    chunked = b"".join(b"%x;x=y\r\n%s\r\n" % (len(c), c) for c in (utf[:7], utf[7:])) + b"0\r\n\r\n"
    cases = {
        "header": (b"Content-Type: text/html; charset=ISO-8859-1", latin, want),
        "meta": (b"Content-Type: text/html", b"<meta charset='iso-8859-1'>" + latin, want),
        "gzip": (b"Content-Type: text/html\r\nContent-Encoding: gzip", gzip.compress(utf), want),
        "chunks": (b"Transfer-Encoding: chunked", chunked, want),
        "both": (b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip", b"%x\r\n%s\r\n0\r\n\r\n" % (len(gzip.compress(utf)), gzip.compress(utf)), want),
        "unknown": (b"Content-Type: text/html; charset=nonsense", utf, want),
        "broken": (b"Content-Encoding: gzip", utf, want),
        "plain": (b"Content-Type: text/plain", b"a <b> &amp;", "a <b> &amp;"),
        "image": (b"Content-Type: image/png", b"\x89PNG <p>", ""),
    }
    (tmp_path / "w").mkdir()
    body = b"".join(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <%s>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k.encode(), len(x), x) for k, (h, b, _) in cases.items() for x in [b"HTTP/1.1 200 OK\r\n" + h + b"\r\n\r\n" + b])
    (tmp_path / "w" / "a.warc").write_bytes(body)
    made = warc.derivatives(warc.responses_of(warc.read(spark, f"{tmp_path}/w")), keep=[]).where("record_type = 'conversion'")
    found = {r[0].strip("<>"): r[1] for r in made.select("refers_to", "block").collect()}
    assert found == {k: x for k, (_, _, x) in cases.items()}


def test_media_sequences_stay_aligned(spark, tmp_path):
    texts = [b"", b"abc", b"x" * 64, b"y" * 65, b"abc"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, raw binary").withColumn("payload", media.padded(F.col("raw")))
    media.store(rows, f"file://{tmp_path}/m")
    html = F.format_string("<p>before</p><figure><img src='%s'><figcaption>cap %s</figcaption></figure><p>after</p>", media.address(F.col("payload")), F.col("doc_id"))
    sequences = rows.select("doc_id", media.parse(html).alias("elements"))
    got = {r["doc_id"]: r for r in media.resolve(sequences, media.features(media.load(spark, f"file://{tmp_path}/m")), keys=["doc_id"]).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        size = max(64, -(-len(t) // 64) * 64)
        want = t.ljust(size, b"\0")
        r = got[k]
        assert (r["position"], r["caption"], r["payload_bytes"]) == (1, f"cap {k}", size)
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["tail_crc32"] == zlib.crc32(want[-64:])
    assert [x["kind"] for x in media.elements("<p>a<img src=q>b")] == ["text", "image", "text"]
    assert media.elements(None) == []


def test_media_of_many_references_are_dealt_out(spark, tmp_path, monkeypatch):
    rows = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("x").alias("part"), media.padded(F.when(F.col("id") % 3 == 0, F.col("id").cast("string").cast("binary"))).alias("payload"))
    media.store(rows, f"file://{tmp_path}/m")
    html = F.format_string("<img src='%s'><img src='sha256:unknown'>", media.address(F.col("payload")))
    sequences = rows.select("doc_id", "part", media.parse(html).alias("elements"))
    known = media.features(media.load(spark, f"file://{tmp_path}/m"))
    plain = media.resolve(sequences, known, keys=["doc_id", "part"])
    monkeypatch.setattr(media, "HOT_ROWS", 7)
    dealt = media.resolve(sequences, known, keys=["doc_id", "part"])
    assert dealt.columns == plain.columns
    got = sorted(map(str, dealt.collect()))
    assert len(got) == 120 and got == sorted(map(str, plain.collect()))
    assert dealt.where("payload_bytes is null").count() == 60


@pytest.mark.parametrize("run", [packing.pack, simhash.near_duplicates, linededup.remove_repeats, pii.detect, secrets.scan])
def test_odd_and_empty_tables(spark, run):
    assert run(frame(spark, [])).count() == 0
    found = run(frame(spark, ODD))
    assert len({str(r["doc_id"]) for r in found.collect()}) == 7


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    shared = prose(70, 80)
    rows = [(k, prose(k, 120)) for k in range(40)]
    rows += [(100, prose(3, 120)), (101, prose(50, 60) + " " + shared), (102, prose(51, 60) + " " + shared + " " + prose(52, 60)), (103, prose(53, 40) + " " + prose(999, 30)), (104, None), (105, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(999, 30))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # A copy, a leak and the second of two empty texts go; everything else stays.
    assert out >= set(range(40)) | {101, 102}
    assert not out & {103}


def test_toxicity_without_frequent_words_in_a_class(spark):
    docs = spark.createDataFrame([(k, "alpha beta gamma" if k else "delta") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k == 0)) for k in range(40)], "doc_id long, toxic int")
    assert toxicity.ordinary(docs, labels).count() <= 40
    rare = spark.createDataFrame([(k, f"word{k}") for k in range(40)], "doc_id long, text string")
    halves = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    scores = {round(r[0], 9) for r in rare.select(toxicity.score(rare["text"], toxicity.fit(rare, halves), rare)).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1


def test_toxicity_probabilities_and_contexts_by_brute_force(spark):
    n, contexts = np.array([[40, 0], [3, 9], [0, 0.0], [1, 1]]), np.array([5, 0, 7, 2])
    p = toxicity.word_probabilities(n, contexts)
    assert np.allclose(p.sum(axis=0), 1) and (p > 0).all()
    shared = (contexts + 0.5) / 16
    for c in (0, 1):
        for k in range(4):
            want = (max(n[k, c] - 0.75, 0) + 0.75 * sum(x > 0 for x in n[:, c]) * shared[k]) / n[:, c].sum()
            assert abs(p[k, c] - want) < 1e-12
    # After one context: words 0 and 1 followed it, in 3 and 1 texts; the rest share what the discounts freed.
    behind = toxicity.bigram_probability(np.array([3, 1, 0, 0]), np.full(4, 4), np.full(4, 2), p[:, 0])
    assert abs(behind.sum() - 1) < 1e-12 and (behind > 0).all()
    assert np.allclose(toxicity.bigram_probability(np.zeros(4), np.zeros(4), np.zeros(4), p[:, 1]), p[:, 1])
    texts = ["a b c b", "b c, A b", "c", "", None, "z b b"]
    docs = spark.createDataFrame([(x,) for x in texts * 3], "text string")
    vocabulary = spark.sparkContext.broadcast({b"b": 1, b"c": 2})
    got = {r["w"]: r["contexts"] for r in toxicity._contexts(docs, vocabulary, "text").collect()}
    want = {0: {"c"}, 1: {"a", "c", "z", "b"}, 2: {"b"}}
    assert got == {k: len(v) for k, v in want.items()}


def test_near_duplicate_stage_finds_all_pairs_at_jaccard(spark, monkeypatch):
    import corpus_pipeline
    from docquarry.llm import nearsets

    # Small, so that shingles are dealt out as pairs of blocks.
    monkeypatch.setattr(nearsets, "BLOCK", 4)
    rng, rows = random.Random(8), [(k, t) for k, t in ODD if k is not None] + [(7, prose(3, 4)), (8, prose(3, 4).upper())]
    hot = prose(4, 12)
    for k in range(40):  # one common passage, then copies with words changed
        base = (prose(100 + k, rng.randrange(10, 150)) + " " + hot).split()
        for c in range(5):
            other = list(base)
            for _ in range(c * len(base) // 100 + (c > 0)):
                other[rng.randrange(len(other))] = f"new{rng.random()}"
            rows.append((1000 * c + 100 + k, " ".join(other)))
    sets = []
    for _, t in rows:
        w = [x.lower() for x in (t or "").split()]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = lambda x, y: x == y or 10 * len(x & y) >= 8 * len(x | y)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if near(sets[i], sets[j])]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        root[find(i)] = find(j)
    want = {min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == want
    # Links of all pairs, not only of those that a fingerprint of three bits holds.
    assert len({r["doc_id"] for r in simhash.keep_one(docs).collect()}) > len(want)
    assert nearsets.keep_one(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_words_are_told_apart_without_an_expression():
    """The plain check of ASCII chunks agrees with ``_WORD``, and the ids with the library's."""
    from docquarry.llm import tokens

    chunks = ["a", "Word", "word.", "word,", "word..", ".", ",", "", "x1", "don't", "é", "Été,", "ÿ.", "a\n", "a\n.", "ñ×", "a,b", "ABC.", "I", "w" * 70, "aé" * 20]
    for x in chunks:
        found = tokens._WORD.fullmatch(x)
        assert tokens._Chunks._word(x) == (found[1] if found else "")
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        made = tokens.Encoder(tokens.public(name))
        for x in [*chunks, " ".join(chunks), "supercalifragilistic" * 3 + "."]:
            want = made._tokenizer.encode(x, add_special_tokens=False).ids
            assert made.encode(x) == b"".join(i.to_bytes(4, "little") for i in want)


def test_levels_minimise_the_squares():
    """Against the sum of squares itself: the least change, ties to the fullest level."""
    import random

    from docquarry.llm.packing import Packer

    draw, packer = random.Random(3), Packer(32)
    for _ in range(600):
        length, counts = draw.randint(1, 31), packer.counts.tolist()
        costs = {}
        for level in [0, *(h for h in range(1, 33 - length) if counts[h])]:
            now = [*counts]
            now[level] -= level > 0
            now[level + length] += level + length < 32
            costs[level] = sum(x * x for x in now[1:32]) - sum(x * x for x in counts[1:32])
        assert packer.level(length) == max(h for h in costs if costs[h] == min(costs.values()))
        list(packer.add("d", bytes(4 * length)))
