"""A data source in Python: JSON records in files that count once a commit lists them.

``spark.dataSource.register(Records)``, then ``format("dq_records")`` with the
folder as ``load``/``save`` argument, for batches and for streams.

- A write puts files under ``data/<write>/`` and, when all tasks have succeeded,
  one commit file ``commits/<number>.json`` that lists each file with its size and the
  least and largest value of every plain column. Readers look at commits alone, so
  a failed write is never seen; ``abort`` removes its files.
- A batch read cuts files into parts at line ends. Filters on plain columns are
  taken over: a file whose limits exclude them is not opened, and in the others
  a row is tested before it goes to Spark.
- A stream read uses commit numbers as offsets, a stream write one commit per
  batch, under the batch's number, so a batch that runs again is not added twice.

Folders are reached by pyarrow's file systems (``file:``, ``s3:``, ``hdfs:``); it must be
one that driver and executors share. One writer appends at a time.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import types as st
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of a part of a file, and rows that are handed to Spark at once.
PART_BYTES, BATCH_ROWS = 32 << 20, 5000
#: Types that JSON holds as they are.
PLAIN = (st.StringType, st.LongType, st.IntegerType, st.ShortType, st.ByteType, st.DoubleType, st.FloatType, st.BooleanType)


def _held(kind: st.DataType) -> bool:
    if isinstance(kind, st.ArrayType):
        return _held(kind.elementType)
    if isinstance(kind, st.StructType):
        return all(_held(f.dataType) for f in kind)
    return isinstance(kind, PLAIN)


class _Folder:
    def __init__(self, uri: str):
        self.fs, self.path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")

    def at(self, *parts: str) -> str:
        return "/".join([self.path.rstrip("/"), *parts])

    def names(self, part: str) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(self.at(part), allow_not_found=True))
        return sorted(x.base_name for x in found)

    def commits(self) -> list[int]:
        return sorted(int(x.split(".")[0]) for x in self.names("commits") if x.endswith(".json"))

    def commit(self, number: int) -> dict:
        with self.fs.open_input_stream(self.at("commits", f"{number:020d}.json")) as f:
            return json.loads(f.read())

    def put(self, number: int, content: dict) -> None:
        """Written aside and moved, so that a reader sees all of it or nothing."""
        aside = self.at("commits", f"_{uuid.uuid4().hex}")
        self.fs.create_dir(self.at("commits"), recursive=True)
        with self.fs.open_output_stream(aside) as f:
            f.write(json.dumps(content).encode())
        self.fs.move(aside, self.at("commits", f"{number:020d}.json"))

    def drop(self, write: str) -> None:
        if self.fs.get_file_info(self.at("data", write)).type == pafs.FileType.Directory:
            self.fs.delete_dir(self.at("data", write))


@dataclass
class Part(InputPartition):
    """Lines of a file that begin from ``start`` on and before ``stop``."""

    file: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    file: str
    bytes: int
    rows: int
    limits: dict


_TESTS = {
    EqualTo: lambda x, v: x == v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
}


def _excluded(f: Filter, limits: dict) -> bool:
    """Whether no row within these limits can pass; a column without limits has nulls alone, or is not plain."""
    column = f.attribute[0]
    if column not in limits:
        return False
    low, high, nulls, values = limits[column]
    if isinstance(f, IsNull):
        return not nulls
    if not values:
        return True
    if low is None or isinstance(f, IsNotNull):
        return False
    if isinstance(f, In):
        return all(v is None or v < low or v > high for v in f.value)
    if isinstance(f, EqualTo):
        return f.value < low or f.value > high
    if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
        return not _TESTS[type(f)](high, f.value)
    return not _TESTS[type(f)](low, f.value)


def _passes(f: Filter, row: dict) -> bool:
    x = row.get(f.attribute[0])
    if isinstance(f, IsNull):
        return x is None
    if x is None:
        return False
    if isinstance(f, IsNotNull):
        return True
    if isinstance(f, In):
        return x in f.value
    return _TESTS[type(f)](x, f.value)


class _Lines:
    """Reading of parts, shared by batches and streams."""

    def __init__(self, uri: str, schema: st.StructType, part_bytes: int):
        self.uri, self.schema, self.part_bytes = uri, schema, part_bytes
        self.filters: list[Filter] = []

    def parts(self, commits: Iterable[int]) -> list[Part]:
        folder, out = _Folder(self.uri), []
        for number in commits:
            for x in folder.commit(number)["files"]:
                if not any(_excluded(f, x["limits"]) for f in self.filters):
                    out += [Part(x["file"], at, min(at + self.part_bytes, x["bytes"])) for at in range(0, x["bytes"], self.part_bytes)]
        return out

    def rows(self, part: Part) -> Iterator[dict]:
        folder = _Folder(self.uri)
        with folder.fs.open_input_file(folder.at(part.file)) as f:
            # A part begins after the first line end at or after the byte before it.
            at = part.start
            if at:
                f.seek(at - 1)
                at += len(_line(f)) - 1
            f.seek(at)
            while at < part.stop:
                line = _line(f)
                if not line:
                    return
                at += len(line)
                row = json.loads(line)
                if all(_passes(x, row) for x in self.filters):
                    yield row

    def batches(self, part: Part) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(self.schema)
        held: list[dict] = []
        for row in self.rows(part):
            held.append(row)
            if len(held) == BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(held, schema=kinds)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kinds)


def _line(f: pa.NativeFile) -> bytes:
    """Up to and with the next line end; what was read beyond it is given back."""
    out, start = [], f.tell()
    while chunk := f.read(1 << 16):
        end = chunk.find(b"\n")
        if end >= 0:
            out.append(chunk[: end + 1])
            f.seek(start + sum(map(len, out)))
            break
        out.append(chunk)
    return b"".join(out)


class RecordsReader(DataSourceReader):
    def __init__(self, uri: str, schema: st.StructType, part_bytes: int):
        self.lines = _Lines(uri, schema, part_bytes)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        plain = {f.name for f in self.lines.schema if isinstance(f.dataType, PLAIN)}
        for f in filters:
            known = isinstance(f, (*_TESTS, In, IsNull, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in plain
            # A NaN is larger than all else in Spark and unordered here.
            if known and not any(isinstance(v, float) and math.isnan(v) for v in (f.value if isinstance(f, In) else [getattr(f, "value", None)])) and not self._float(f):
                self.lines.filters.append(f)
            else:
                yield f

    def _float(self, f: Filter) -> bool:
        return isinstance(self.lines.schema[f.attribute[0]].dataType, (st.DoubleType, st.FloatType)) and not isinstance(f, (IsNull, IsNotNull))

    def partitions(self) -> list[Part]:
        return self.lines.parts(_Folder(self.lines.uri).commits()) or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.lines.batches(partition) if partition.file else iter(())


class RecordsStreamReader(DataSourceStreamReader):
    """Offsets are commit numbers; a batch has the commits after its start up to its end."""

    def __init__(self, uri: str, schema: st.StructType, part_bytes: int):
        self.lines = _Lines(uri, schema, part_bytes)

    def initialOffset(self) -> dict:
        return {"commit": -1}

    def latestOffset(self) -> dict:
        return {"commit": max(_Folder(self.lines.uri).commits(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.lines.parts(x for x in _Folder(self.lines.uri).commits() if start["commit"] < x <= end["commit"])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.lines.batches(partition)

    def commit(self, end: dict) -> None:
        pass  # commits stay: other readers have offsets of their own


class _Files:
    """Writing of files, shared by batches and streams."""

    def __init__(self, uri: str, schema: st.StructType):
        wrong = [f.name for f in schema if not _held(f.dataType)]
        if wrong:
            raise ValueError(f"columns that JSON does not hold as they are: {', '.join(wrong)}")
        self.uri, self.schema, self.name = uri, schema, uuid.uuid4().hex

    def written(self, batches: Iterator[pa.RecordBatch]) -> Written:
        folder = _Folder(self.uri)
        file = f"data/{self.name}/{uuid.uuid4().hex}.jsonl"
        plain = [f.name for f in self.schema if isinstance(f.dataType, PLAIN)]
        limits: dict = {c: [None, None, 0, 0] for c in plain}
        size = rows = 0
        folder.fs.create_dir(folder.at("data", self.name), recursive=True)
        with folder.fs.open_output_stream(folder.at(file)) as f:
            for b in batches:
                for row in b.to_pylist():
                    for c in plain:
                        x, known = row[c], limits[c]
                        if x is None:
                            known[2] += 1
                        else:
                            known[3] += 1
                            known[0] = x if known[0] is None or x < known[0] else known[0]
                            known[1] = x if known[1] is None or x > known[1] else known[1]
                    line = json.dumps(row, ensure_ascii=False).encode("utf-8", "surrogatepass") + b"\n"
                    f.write(line)
                    size, rows = size + len(line), rows + 1
        return Written(file, size, rows, limits)

    def committed(self, messages: list[Written | None], number: int | None, overwrite: bool = False) -> None:
        folder = _Folder(self.uri)
        before = folder.commits()
        kept = [m for m in messages if m is not None and m.rows]
        # Files of attempts that another attempt replaced are not listed and go.
        listed = {m.file for m in kept}
        for name in folder.names(f"data/{self.name}"):
            if f"data/{self.name}/{name}" not in listed:
                folder.fs.delete_file(folder.at("data", self.name, name))
        files = [{"file": m.file, "bytes": m.bytes, "rows": m.rows, "limits": m.limits} for m in kept]
        folder.put(max(before, default=-1) + 1 if number is None else number, {"schema": self.schema.json(), "files": files})
        if overwrite:
            gone = {x["file"].split("/")[1] for c in before for x in folder.commit(c)["files"]}
            for c in before:
                folder.fs.delete_file(folder.at("commits", f"{c:020d}.json"))
            for write in gone:
                folder.drop(write)

    def dropped(self) -> None:
        _Folder(self.uri).drop(self.name)


class RecordsWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, schema: st.StructType, overwrite: bool):
        self.files, self.overwrite = _Files(uri, schema), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.files.written(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        self.files.committed(messages, None, self.overwrite)

    def abort(self, messages: list[Written | None]) -> None:
        self.files.dropped()


class RecordsStreamWriter(DataSourceStreamArrowWriter):
    """A batch's number names its commit: running it again replaces the same commit."""

    def __init__(self, uri: str, schema: st.StructType):
        self.files = _Files(uri, schema)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.files.written(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        if batchId in _Folder(self.files.uri).commits():
            # The batch was committed before a failure: its files stay, these go.
            for m in messages:
                if m is not None:
                    folder = _Folder(self.files.uri)
                    folder.fs.delete_file(folder.at(m.file))
            return
        folder = _Folder(self.files.uri)
        files = [{"file": m.file, "bytes": m.bytes, "rows": m.rows, "limits": m.limits} for m in messages if m is not None and m.rows]
        folder.put(batchId, {"schema": self.files.schema.json(), "files": files})

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        folder = _Folder(self.files.uri)
        for m in messages:
            if m is not None:
                folder.fs.delete_file(folder.at(m.file))


class Records(DataSource):
    """``dq_records``. Option ``partBytes``: bytes of a part of a file."""

    @classmethod
    def name(cls) -> str:
        return "dq_records"

    def _uri(self) -> str:
        return self.options["path"]

    def schema(self) -> st.StructType:
        """That of the latest commit."""
        folder = _Folder(self._uri())
        found = folder.commits()
        if not found:
            raise ValueError(f"no commit in {self._uri()}: give a schema")
        return st.StructType.fromJson(json.loads(folder.commit(found[-1])["schema"]))

    def _part(self) -> int:
        return int(self.options.get("partBytes", PART_BYTES))

    def reader(self, schema: st.StructType) -> RecordsReader:
        return RecordsReader(self._uri(), schema, self._part())

    def streamReader(self, schema: st.StructType) -> RecordsStreamReader:
        return RecordsStreamReader(self._uri(), schema, self._part())

    def writer(self, schema: st.StructType, overwrite: bool) -> RecordsWriter:
        return RecordsWriter(self._uri(), schema, overwrite)

    def streamWriter(self, schema: st.StructType, overwrite: bool) -> RecordsStreamWriter:
        return RecordsStreamWriter(self._uri(), schema)


def register(spark) -> None:
    """Make the format known and let Spark hand its filters over."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Records)
