"""Streams beside the same in batch, file formats there and back, and functions in SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docquarry.functions import sql
from docquarry.functions import text as T
from docquarry.sources import tables
from docquarry.streaming import events as stream

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, value double"
START = datetime(2024, 1, 1)
EVENTS = [(k, START + timedelta(minutes=(7 * k) % 600), k % 5, float(k)) for k in range(200)]


def ran(df, mode: str, folder) -> list[tuple]:
    """Rows of the memory sink after all that is there was read."""
    name = f"s{abs(hash(str(folder)))}"
    run = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    assert run.awaitTermination(120) and run.exception() is None
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


@pytest.fixture
def feed(spark, tmp_path):
    """(batch, stream) of the same events."""
    spark.createDataFrame(EVENTS, SCHEMA).orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.read.schema(SCHEMA).parquet(str(tmp_path / "in")), tables.stream(spark, str(tmp_path / "in"), SCHEMA)


def test_complete_mode_equals_batch(feed, tmp_path):
    batch, live = feed
    made = lambda df: stream.windowed(stream.timed(df), "1 hour", slide="30 minutes", by=("user_id",))
    assert sorted(ran(made(live), "complete", tmp_path)) == sorted(map(tuple, made(batch).collect()))


def test_sessions_of_a_stream_are_those_of_the_batch(spark, feed, tmp_path):
    batch, live = feed
    # A last event closes what the watermark would leave open.
    spark.createDataFrame([(9999, START + timedelta(days=9), 77, 0.0)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = ran(stream.sessions(stream.timed(tables.stream(spark, str(tmp_path / "in"), SCHEMA, files_per_trigger=1), late="1 minute"), "20 minutes"), "append", tmp_path)
    want = {tuple(r) for r in stream.sessions(stream.timed(batch), "20 minutes").collect()}
    assert {r for r in got if r[0] != 77} == {r for r in want if r[0] != 77} and len(got) == len(set(got))


def test_running_totals_end_at_the_sums(spark, feed, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = ran(stream.running_totals(feed[1]), "update", tmp_path)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(got) == [(str(u), 40, float(sum(range(u, 200, 5)))) for u in range(5)]


def test_a_stream_meets_a_table(spark, feed, tmp_path):
    static = spark.createDataFrame([(0, "a"), (1, "b")], "user_id bigint, name string")
    got = ran(stream.enriched(feed[1], static, "user_id").select("event_id", "name"), "append", tmp_path)
    assert sorted(got) == [(k, {0: "a", 1: "b"}.get(k % 5)) for k in range(200)]


def test_two_streams_meet_within_a_time(spark, feed, tmp_path):
    left = stream.timed(feed[1].where("event_id % 2 = 0"), late="1 hour")
    right = stream.timed(tables.stream(spark, str(tmp_path / "in"), SCHEMA).where("event_id % 2 = 1"), late="1 hour")
    got = ran(stream.paired(left, right, key="user_id", within="10 minutes").select("left_event_id", "right_event_id"), "append", tmp_path)
    want = {(a[0], b[0]) for a in EVENTS for b in EVENTS if not a[0] % 2 and b[0] % 2 and a[2] == b[2] and timedelta(0) <= b[1] - a[1] <= timedelta(minutes=10)}
    assert set(got) == want and len(got) == len(want) > 0


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv", "xml"])
def test_formats_there_and_back(spark, tmp_path, fmt):
    rows = [(1, "a, \"b\" <c>", 0.5, "x"), (2, "é😀", -1.0, "y"), (3, None, None, "x")]
    df = spark.createDataFrame(rows, "id bigint, name string, value double, part string")
    options = {"rowTag": "row"} if fmt == "xml" else {"escape": '"'} if fmt == "csv" else {}
    tables.write(df, str(tmp_path / "out"), fmt, partition_by=("part",), **options)
    got = tables.read(spark, str(tmp_path / "out"), fmt, schema=df.schema, **options)
    assert sorted(map(tuple, got.select("id", "name", "value", "part").collect())) == rows
    assert [r["id"] for r in got.where("part = 'y'").collect()] == [2]


def test_lines_and_bytes(spark, tmp_path):
    tables.write(spark.createDataFrame([("one",), ("",), ("two",)], "value string").coalesce(1), str(tmp_path / "t"), "text")
    assert [r[0] for r in tables.read(spark, str(tmp_path / "t"), "text").collect()] == ["one", "", "two"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.bin").write_bytes(b"\x00\xff")
    row = tables.read(spark, str(tmp_path / "b"), "binaryFile").first()
    assert bytes(row["content"]) == b"\x00\xff" and row["length"] == 2
    with pytest.raises(ValueError):
        tables.read(spark, str(tmp_path), "nothing")


def test_functions_in_sql(spark):
    sql.register(spark)
    df = spark.createDataFrame([(1, "Ein Satz. Noch einer! "), (2, ""), (3, None)], "id bigint, text string")
    df.createOrReplaceTempView("sql_docs")
    same = df.select("id", T.tokens(F.col("text")), T.sentences(F.col("text")), T.content_hash(F.col("text")))
    got = spark.sql("SELECT id, dq_tokens(text), dq_sentences(text), dq_content_hash(text) FROM sql_docs")
    assert sorted(map(str, got.collect())) and [tuple(r) for r in got.orderBy("id").collect()] == [tuple(r) for r in same.orderBy("id").collect()]
    terms = spark.sql("SELECT id, pos, term FROM sql_docs, LATERAL dq_terms(text)")
    assert sorted(map(tuple, terms.collect())) == [(1, 0, "ein"), (1, 1, "satz"), (1, 2, "noch"), (1, 3, "einer")]
    assert "Join" not in terms._jdf.queryExecution().optimizedPlan().toString()
    means = spark.sql("SELECT k, round(dq_geometric_mean(v), 6) AS m FROM VALUES ('a', 2.0D), ('a', 8.0D), ('a', -1.0D), ('b', 0.0D) AS t(k, v) GROUP BY k").collect()
    assert {r["k"]: r["m"] for r in means}["a"] == 4.0
