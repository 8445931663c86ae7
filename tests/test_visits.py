"""Sessions by list state and timers: those of the batch, late rows apart, nothing left in the state."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from docquarry.streaming import events as stream
from docquarry.streaming import visits

START = datetime(2024, 1, 1)
SCHEMA = "event_id bigint, ts timestamp, user_id bigint, value double"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


def test_sessions_and_late_rows(spark, rocks, tmp_path):
    files = [
        [(1, at(0), 1, 1.0), (2, at(25), 1, 2.0), (3, at(10), 1, 4.0), (4, at(5), 2, 1.0), (5, None, 2, 9.0), (6, at(1), None, 9.0)],
        # The gap exactly goes on, more than it does not. Key 2 goes on out of order.
        [(7, at(55), 1, 8.0), (16, at(85.5), 1, 64.0), (8, at(20), 2, 2.0), (9, at(90), 3, 1.0)],
        [(10, at(200), 3, 1.0)],
        # By now all before is closed: rows of then are late, one of an open session is not.
        [(11, at(2), 1, 16.0), (12, at(190), 3, 2.0), (13, at(210), 1, 32.0)],
        [(14, at(5000), 9, 0.0)],
        [(15, at(5001), 9, 0.0)],
    ]
    source = tmp_path / "in"
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        import time

        time.sleep(1.1)  # files are read in the order of their times
    live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    made = visits.visits(live, 1800, late="1 minute")
    run = made.writeStream.foreachBatch(visits.split(f"{tmp_path}/sessions", f"{tmp_path}/late")).outputMode("append").option("checkpointLocation", f"{tmp_path}/point").trigger(availableNow=True).start()
    assert run.awaitTermination(240) and run.exception() is None
    found = {(r.key, r.started, r.ended): (r.n, r.total, r.open) for r in spark.read.parquet(f"{tmp_path}/sessions").collect()}
    late = [(r.key, r.at, r.value) for r in spark.read.parquet(f"{tmp_path}/late").collect()]
    assert late == [("1", at(2), 16.0)]
    assert {k: v[:2] for k, v in found.items()} == {
        ("1", at(0), at(55)): (4, 15.0),
        ("1", at(85.5), at(85.5)): (1, 64.0),
        ("2", at(5), at(20)): (2, 3.0),
        ("3", at(90), at(90)): (1, 1.0),
        ("3", at(190), at(200)): (2, 3.0),
        ("1", at(210), at(210)): (1, 32.0),
    }
    # The same as the batch's sessions of the rows that were not late.
    kept = [r for rows in files for r in rows if r[1] and r[2] and r[0] != 11 and r[2] != 9]
    batch = stream.sessions(spark.createDataFrame(kept, SCHEMA), "30 minutes").collect()
    assert {(str(r.user_id), r.start): r.n for r in batch} == {k[:2]: v[0] for k, v in found.items()}
    # A key's last session to be closed leaves nothing open, and the state store has the last key alone.
    last = {key: max(e for k, _, e in found if k == key) for key in "123"}
    assert all(found[k][2] == 0 for k in found if k[2] == last[k[0]])
    state = spark.read.format("statestore").option("stateVarName", "open").load(f"{tmp_path}/point")
    assert {r.key.key for r in state.select("key").collect()} == {"9"}
