"""Table functions by a running state, and fuzzy lookup against every distance."""

from __future__ import annotations

import numpy as np
import pytest

from docquarry.functions import tables
from docquarry.operators import fuzzy


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    tables.register(spark)


def test_sessions(spark):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:29:59"), ("a", "2024-01-01 00:59:59"), ("a", "2024-01-01 02:00:00"), ("b", None), (None, "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "who string, at string").selectExpr("who", "cast(at AS timestamp) AS at", "1 AS session").createOrReplaceTempView("visits")
    found = spark.sql("SELECT key, session, date_format(started, 'HH:mm:ss') s, date_format(ended, 'HH:mm:ss') e, n FROM dq_sessions(TABLE(visits), key => 'who', ts => 'at', gap_seconds => 1800)").collect()
    want = [("a", 0, "00:00:00", "00:29:59", 3), ("a", 1, "00:59:59", "00:59:59", 1), ("a", 2, "02:00:00", "02:00:00", 1), (None, 0, "00:00:00", "00:00:00", 1)]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize(("call", "said"), [("dq_sessions(TABLE(visits), key => 'nobody')", "no column"), ("dq_sessions(TABLE(visits), key => 'who', ts => 'who')", "not a time"), ("dq_sessions(TABLE(visits), key => 'who', ts => 'at', gap_seconds => 0)", "positive")])
def test_analysis_refuses_wrong_arguments(spark, call, said):
    spark.sql("SELECT 'a' AS who, timestamp '2024-01-01' AS at").createOrReplaceTempView("visits")
    with pytest.raises(Exception, match=said):
        spark.sql(f"SELECT * FROM {call}")


def test_exchanges(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "abc"), (1, 2, "user", None), (1, 3, "assistant", "xy"), (1, 4, "assistant", "z"), (1, 5, "user", "q"), (2, 1, "assistant", "a"), (2, None, "user", "early")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").createOrReplaceTempView("turns")
    found = spark.sql("SELECT * FROM dq_exchanges(TABLE(turns))").collect()
    assert sorted(map(tuple, found)) == [(1, 1, 3, 2, 3, 2), (2, None, 1, 1, 5, 1)]


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize(("reach", "prefix"), [(1, 4), (2, 4), (2, 10)])
def test_lookup_finds_every_near_term(spark, reach, prefix):
    """Terms of three letters, so that most have many near ones; prefixes shorter than terms."""
    rng = np.random.default_rng(reach)
    terms = sorted({"".join(rng.choice(list("abä"), int(rng.integers(0, 9)))) for _ in range(220)}) + ["a" * 5000 + "b", "a" * 5000]
    df = spark.createDataFrame([(t,) for t in terms] + [(None,), ("ab",)], "term string")
    found = fuzzy.lookup(df, fuzzy.index(df, reach, prefix=prefix), reach, prefix=prefix).collect()
    want = {(a, b): d for a in terms for b in terms if abs(len(a) - len(b)) <= reach and len(a) < 100 and (d := distance(a, b)) <= reach}
    want |= {(a, b): int(a != b) for a in terms[-2:] for b in terms[-2:]}
    assert len(found) == len(want) and {(r.wanted, r.term): r.distance for r in found} == want


def test_suggestions_are_near_and_frequent(spark):
    dictionary = spark.createDataFrame([("word", 5), ("ward", 9), ("wor", 1), ("words", 9), ("other", 50)], "term string, df bigint")
    found = fuzzy.suggest(spark.createDataFrame([("wrd",)], "term string"), dictionary, 3).collect()
    assert [(r.term, r.distance, r.rank) for r in sorted(found, key=lambda r: r["rank"])] == [("ward", 1, 1), ("word", 1, 2), ("words", 2, 3)]
