"""Secrets: base patterns against a plain scan, planted keys found, prose left alone."""

from __future__ import annotations

import random
import re
import string

import pytest

from docquarry.llm import secrets as S


def plain_base(text: str) -> list[tuple[int, int, int]]:
    """The three shapes from their definitions, character by character where that differs from one expression."""
    out = []
    at = 0
    name = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)")
    value = re.compile(r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    while m := name.search(text, at):
        v = value.match(text, m.end())
        if v:
            if len(v[1]) >= 8:
                out.append((m.start(), 0, v.end()))
            at = v.end()
        else:
            at = m.start() + 1
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(out)


def test_base_spans_equal_a_plain_scan():
    rng = random.Random(1)
    parts = ["token", "Token", "api_key", "apikey", "passwd", "=", ": ", "'", '"', " ", "\n", "abc12345", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef" * 2, "f", "é", "secret", ".", "-", "x" * 8]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert [x for x in S.spans(text) if x[1] < 3] == plain_base(text), text


def planted() -> list[tuple[str, str]]:
    """(text, key): prose with a random key beside a sensitive word, before or after it."""
    rng = random.Random(3)
    alphabet = string.ascii_letters + string.digits
    forms = ["Authorization: Bearer {}", "{} # api key", "my private key is {}", "credential of the server, which its owner has to keep alone at all times: {}", 'passphrase "{}"', "the client secret was {} before", "({}) is the signature"]
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    out = []
    for i in range(350):
        key = "".join(rng.choice(alphabet) for _ in range(rng.choice([16, 20, 24, 32, 40])))
        prose = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(2)]
        out.append((f"{prose[0]}. {forms[i % len(forms)].format(key)} {prose[1]}.", key))
    return out


def test_planted_keys_are_found_and_nothing_else():
    found = right = 0
    cases = planted()
    for text, key in cases:
        got = [text[a:z] for a, k, z in S.spans(text) if k in (0, 3)]
        found += any(key in x for x in got)
        right += all(key in x for x in got)
    assert found / len(cases) >= 0.95 and right / len(cases) >= 0.98


@pytest.mark.parametrize(("text", "want"), [("bearer abcdef0123GHIJK9 rest", "abcdef0123GHIJK9"), ("x9Qw7Rt5Yp3Lm1Zk8 # api key", "x9Qw7Rt5Yp3Lm1Zk8"), ("secret " + " " * 53 + "aB3dE5fG7hI9jK1", "aB3dE5fG7hI9jK1"), ("credential aB3.dE5fG.7hI9jK and on", "aB3.dE5fG.7hI9jK"), ("private q8Wz5xT2vN7.", "")])
def test_short_dotted_far_and_leading_candidates(text, want):
    assert [text[a:z] for a, k, z in S.spans(text) if k == 3] == ([want] if want else [])


def test_what_lies_beyond_a_base_span_is_kept():
    text = "token " + "0123456789abcdef" * 2 + "XyZ9kQ2rT7uW4pL6mN1v end"
    found = [(k, text[a:z]) for a, k, z in S.spans(text)]
    assert found == [(2, "0123456789abcdef" * 2), (3, "XyZ9kQ2rT7uW4pL6mN1v")]


def test_mail_and_page_addresses_are_no_candidates():
    text = "the token of jane.doe1999smith@mail99server.example and https://host42.example/path/of/4711abc"
    assert S.spans(text) == []


def test_long_runs_take_linear_time():
    text = "token" * 40_000 + " " + "a1" * 50_000
    assert all(0 <= a < z <= len(text) for a, _, z in S.spans(text))


def test_scan_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "bearer abcdef0123GHIJK9", 7), (3, "bearer abcdef0123GHIJK9", 7)], "doc_id bigint, text string, spans int")
    got = S.scan(df).collect()
    assert [len(r.secrets) for r in got] == [0, 0, 1, 1] and got[2].secrets[0].match == "abcdef0123GHIJK9" and got[0].spans == 5
    assert S.scan(df.limit(0)).count() == 0
