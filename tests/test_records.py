"""The Python data source: round trips, filters, commits, aborts, streams."""

from __future__ import annotations

import glob
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull, LessThanOrEqual, StringContains

from docquarry.sources import records

SCHEMA = "doc_id bigint, text string, score double, ok boolean, tags array<string>, sub struct<a:int,b:string>"
ROWS = [(i, f"text {i}\nä 😀" if i % 5 else None, i / 7, i % 2 == 0, ["x", None] if i % 3 else None, (i, "b")) for i in range(400)] + [(None, "", float("inf"), None, [], None)]


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    records.register(spark)


def write(spark, path, rows=ROWS, mode="append", parts=3):
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.format("dq_records").mode(mode).save(path)


def read(spark, path, **options):
    return spark.read.format("dq_records").options(**options).load(path)


def held(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("part_bytes", [1 << 20, 100, 7])
def test_round_trip_whatever_the_parts(spark, tmp_path, part_bytes):
    path = f"{tmp_path}/r"
    rows = ROWS if part_bytes > 7 else ROWS[:20]
    write(spark, path, rows)
    found = read(spark, path, partBytes=part_bytes)
    assert found.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
    assert held(found) == held(spark.createDataFrame(rows, SCHEMA))


def test_appends_add_and_overwrites_replace(spark, tmp_path):
    path = f"{tmp_path}/r"
    write(spark, path, ROWS[:10])
    write(spark, path, ROWS[10:30])
    assert read(spark, path).count() == 30 and len(glob.glob(f"{path}/commits/*.json")) == 2
    write(spark, path, ROWS[30:35], "overwrite")
    assert held(read(spark, path).select("doc_id")) == held(spark.createDataFrame([(i,) for i in range(30, 35)], "doc_id bigint"))
    assert len(glob.glob(f"{path}/data/*")) == 1


def test_filters_pass_the_same_rows(spark, tmp_path):
    path = f"{tmp_path}/r"
    write(spark, path)
    plain = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("doc_id = 17", "doc_id > 390 AND ok", "text IS NULL", "doc_id IN (3, 5, 1000)", "doc_id <= 2 OR doc_id IS NULL", "text = ''", "NOT ok", "score > 50", "text LIKE '%9%'", "sub.a = 4", "doc_id <> 3"):
        assert held(read(spark, path).where(c)) == held(plain.where(c)), c
    assert read(spark, path).where("doc_id > 5000").count() == 0


def test_the_reader_takes_filters_over_and_skips_files(spark, tmp_path):
    path = f"{tmp_path}/r"
    for at in range(0, 400, 100):
        write(spark, path, ROWS[at : at + 100], parts=1)
    schema = read(spark, path).schema

    def asked(*filters):
        reader = records.RecordsReader(path, schema, 1 << 20)
        left = list(reader.pushFilters(list(filters)))
        return left, [p for p in reader.partitions() if p.file], reader

    left, parts, reader = asked(EqualTo(("doc_id",), 250), IsNotNull(("doc_id",)))
    assert left == [] and len(parts) == 1
    assert [r["doc_id"] for p in parts for r in reader.lines.rows(p)] == [250]
    assert len(asked(GreaterThan(("doc_id",), 199))[1]) == 2
    assert len(asked(LessThanOrEqual(("doc_id",), 99))[1]) == 1
    assert len(asked(In(("doc_id",), (5, 350)))[1]) == 2
    assert len(asked(IsNull(("doc_id",)))[1]) == 0
    kept = StringContains(("text",), "9")
    assert asked(kept)[0] == [kept] and len(asked(kept)[1]) == 4
    plan = read(spark, path).where("doc_id = 250")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/r"
    write(spark, path, ROWS[:50])
    before = sorted(glob.glob(f"{path}/**/*", recursive=True))
    bad = spark.createDataFrame(ROWS, SCHEMA).repartition(4).withColumn("score", F.when(F.col("doc_id") == 399, F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("score")))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("dq_records").mode("append").save(path)
    assert sorted(glob.glob(f"{path}/**/*", recursive=True)) == before
    assert read(spark, path).count() == 50


def test_what_json_does_not_hold_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="JSON does not hold"):
        spark.sql("SELECT current_timestamp() AS t").write.format("dq_records").mode("append").save(f"{tmp_path}/r")


def test_empty_tables(spark, tmp_path):
    path = f"{tmp_path}/r"
    write(spark, path, [])
    assert read(spark, path).count() == 0 and json.load(open(glob.glob(f"{path}/commits/*.json")[0]))["files"] == []


def test_stream_reads_each_commit_once_and_writes_each_batch_once(spark, tmp_path):
    source, sink, point = (f"{tmp_path}/{x}" for x in ("source", "sink", "point"))
    write(spark, source, ROWS[:20])

    def run():
        rows = spark.readStream.format("dq_records").load(source).select("doc_id", "text")
        query = rows.writeStream.format("dq_records").option("path", sink).option("checkpointLocation", point).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()

    run()
    assert held(read(spark, sink)) == held(spark.createDataFrame(ROWS[:20], SCHEMA).select("doc_id", "text"))
    write(spark, source, ROWS[20:50])
    run()
    assert held(read(spark, sink)) == held(spark.createDataFrame(ROWS[:50], SCHEMA).select("doc_id", "text"))


def test_a_batch_that_runs_again_is_not_added(tmp_path):
    import pyarrow as pa
    from pyspark.sql import types as st

    schema = st.StructType().add("a", st.LongType())
    for _ in range(2):
        writer = records.RecordsStreamWriter(str(tmp_path), schema)
        message = writer.write(iter([pa.RecordBatch.from_pydict({"a": [1, 2]})]))
        writer.commit([message], 0)
    reader = records.RecordsReader(str(tmp_path), schema, 1 << 20)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2
