"""Table functions in Python: sessions of a key's rows and exchanges of a conversation, by a state that runs over ordered rows.

``register`` gives them SQL names. Each says in ``analyze`` how its table argument
is dealt out and ordered, so a caller cannot forget it, and which columns come
back. A row is taken, the state changes, and a row goes out where a session or an
exchange ends: nothing of a group is held but the current state.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as st
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn


def _column(table: AnalyzeArgument, name: str) -> st.DataType:
    if not table.isTable:
        raise ValueError("the first argument is a table")
    found = {f.name: f.dataType for f in table.dataType}
    if name not in found:
        raise ValueError(f"the table has no column {name!r}; it has {', '.join(found)}")
    return found[name]


def _constant(argument: AnalyzeArgument | None, default):
    if argument is None:
        return default
    if not argument.isConstantExpression:
        raise ValueError("names and the gap are constants")
    return argument.value


class Sessions:
    """(key, session, started, ended, n): rows of a key no further apart than the gap, numbered from 0.

    ``dq_sessions(TABLE(t), key => 'user_id', ts => 'ts', gap_seconds => 1800)``. A row
    exactly the gap after the one before starts a new session. Rows without a
    time are left out; rows without a key are one key.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument | None = None, ts: AnalyzeArgument | None = None, gap_seconds: AnalyzeArgument | None = None) -> AnalyzeResult:
        key_name, ts_name, gap = _constant(key, "user_id"), _constant(ts, "ts"), _constant(gap_seconds, 1800)
        kind = _column(table, ts_name)
        if not isinstance(kind, (st.TimestampType, st.TimestampNTZType)):
            raise ValueError(f"{ts_name!r} is not a time")
        if gap <= 0:
            raise ValueError("the gap is positive")
        schema = st.StructType().add("key", _column(table, key_name)).add("session", st.LongType()).add("started", kind).add("ended", kind).add("n", st.LongType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(key_name)], orderBy=[OrderingColumn(ts_name)], select=[SelectedColumn(key_name), SelectedColumn(ts_name)])

    def __init__(self):
        self.key = self.started = self.ended = None
        self.n = self.session = 0

    def _row(self) -> tuple:
        return self.key, self.session, self.started, self.ended, self.n

    def eval(self, table, key: str = "user_id", ts: str = "ts", gap_seconds: int = 1800) -> Iterator[tuple]:
        now: datetime | None = table[ts]
        if now is None:
            return
        if self.n and now - self.ended >= timedelta(seconds=gap_seconds):
            yield self._row()
            self.session, self.n = self.session + 1, 0
        if not self.n:
            self.key, self.started = table[key], now
        self.ended, self.n = now, self.n + 1

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            yield self._row()


class Exchanges:
    """(conv_id, asked, answered, n_asked, question_chars, answer_chars): each answer of the assistant with the user's turns since the answer before.

    ``dq_exchanges(TABLE(conversations))``. ``asked`` and ``answered`` are turn numbers, the first of the
    user's turns and the answer's. Answers without a question before them, and questions
    never answered, give no row; other roles change nothing.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        for name in ("turn", "role", "text"):
            _column(table, name)
        schema = st.StructType().add("conv_id", _column(table, "conv_id"))
        for name in ("asked", "answered", "n_asked", "question_chars", "answer_chars"):
            schema = schema.add(name, st.LongType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("conv_id")], orderBy=[OrderingColumn("turn"), OrderingColumn("role"), OrderingColumn("text")], select=[SelectedColumn(x) for x in ("conv_id", "turn", "role", "text")])

    def __init__(self):
        self.asked, self.n, self.chars = None, 0, 0

    def eval(self, table) -> Iterator[tuple]:
        size = len(table["text"] or "")
        if table["role"] == "user":
            self.asked = table["turn"] if not self.n else self.asked
            self.n, self.chars = self.n + 1, self.chars + size
        elif table["role"] == "assistant" and self.n:
            yield table["conv_id"], self.asked, table["turn"], self.n, self.chars, size
            self.n = self.chars = 0


def register(spark: SparkSession) -> None:
    """``dq_sessions`` and ``dq_exchanges`` for this session's SQL."""
    spark.udtf.register("dq_sessions", F.udtf(Sessions))
    spark.udtf.register("dq_exchanges", F.udtf(Exchanges))
