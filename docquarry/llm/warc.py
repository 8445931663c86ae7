"""WARC derivatives: linked metadata and plain-text conversion records of responses.

Derivatives are expressed in Spark functions, one row in and two rows out, with
no shuffle. Identifiers are UUIDs made from digests, so building twice gives
the same records and links hold without a lookup. ``read`` splits WARC files where
records begin, so that large files are read in parallel and no file is ever
whole in memory; a file in which a record is longer than what stands before the next
such place is put together again by the stated lengths. ``responses_of`` takes URL, date,
headers and digests from the records read and undoes transfer and content
encodings and character sets, while ``responses`` makes them for pages stored without.
"""

from __future__ import annotations

import gzip
import html.entities
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_arrow, released

#: Line end of WARC headers.
END = "\r\n"
#: Stated where a source has no date, not taken from a clock, so that results repeat.
DATE = "2024-01-01T00:00:00Z"
#: Named entities that are written out in plain text: HTML 4's, from the standard library, and the apostrophe. A hard space is a space.
ENTITIES = {name: chr(code) for name, code in html.entities.name2codepoint.items()} | {"apos": "'", "nbsp": " "}
#: What begins a record after the end of the one before.
BREAK = f"{END}{END}WARC/1."


def urn(*parts: Column) -> Column:
    """``<urn:uuid:...>`` from the digest of the parts, joined by line feeds."""
    h = F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256)
    cut = lambda at, n: F.substring(h, at, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-8"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def unescaped(text: Column) -> Column:
    """Character references written out in one pass, so what a reference yields is not read again; what is no character becomes U+FFFD, an unknown name stays."""
    names = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))

    def numeric(code: Column) -> Column:
        digits = F.substring(code, 2, 7)
        n = F.when(F.lower(F.substring(digits, 1, 1)) == "x", F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(digits).try_cast("int")
        there = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.when(there, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))

    def begun(part: Column) -> Column:
        """What follows an ampersand, with the reference that it begins, if any, written out."""
        end = F.instr(part, ";")
        code, rest, plain = F.substring(part, F.lit(1), end - 1), F.substring(part, end + 1, F.length(part)), F.concat(F.lit("&"), part)
        number = F.when(code.rlike(r"^#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7})$"), F.concat(numeric(code), rest)).otherwise(plain)
        name = F.coalesce(F.concat(F.try_element_at(names, code), rest), plain)
        return F.when(~end.between(2, 17), plain).when(F.startswith(part, F.lit("#")), number).otherwise(name)

    parts = F.transform(F.split(text, "&", -1), lambda part, i: F.when(i == 0, part).otherwise(begun(part)))
    return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)


def _one_line(value: Column) -> Column:
    """A header's value: line ends, which would begin another header, are written as in a URL."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def plain_text(html: Column) -> Column:
    """Visible text of HTML: no scripts, styles, comments or tags, one line per block, single spaces."""
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head|template)\b[^>]*>.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"\s+", " ")
    text = F.regexp_replace(text, r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|footer|header|br|body|blockquote|pre)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    text = unescaped(text)
    return F.trim(F.regexp_replace(text, r" *\n[ \n]*", "\n"), F.lit(" \n"))


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of stored pages: id, record_id, target_uri, headers, block, payload and its digest.

    A page without URL has an empty target; without HTML, an empty payload.
    Pages that agree in id, URL and HTML have the same record id.
    """
    url, html = _one_line(F.coalesce(F.col(url_col), F.lit(""))), F.coalesce(F.col(html_col), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length(html).cast("string"), F.lit(END))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return pages.select(F.col(id_col), urn(F.lit("response"), key, url, html).alias("record_id"), url.alias("target_uri"), http.alias("headers"), html.alias("payload"), digest(html).alias("payload_digest"), F.lit(DATE).alias("date"))


def _record(kind: str, block: Column, content: str) -> Column:
    made = urn(F.lit(kind), F.col("record_id"))
    head = F.concat_ws(
        END,
        F.lit("WARC/1.1"),
        F.lit(f"WARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: "), made),
        F.concat(F.lit("WARC-Refers-To: "), F.col("record_id")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("target_uri")),
        F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Block-Digest: "), digest(block)),
        F.lit(f"Content-Type: {content}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.struct(F.lit(kind).alias("record_type"), made.alias("record_id"), F.col("record_id").alias("refers_to"), F.col("target_uri"), digest(block).alias("block_digest"), F.col("payload_digest").alias("source_digest"), head.alias("head"), block.alias("block"))


def derivatives(found: DataFrame, *, keep: list[str]) -> DataFrame:
    """For each response its metadata and its conversion record, after the ``keep`` columns.

    The metadata block lists title, number of links, source digest and the
    source's HTTP headers; the conversion block is the plain text. Both refer
    to the response, and the metadata names the conversion. No row is dropped:
    an empty payload gives an empty conversion. A payload that its header calls
    text but not HTML is its own conversion, and one that it calls neither has an empty one
    and no title or links; without such a header it is HTML.
    """
    stated = F.lower(F.regexp_extract("headers", r"(?im)^content-type:[ \t]*([^;\r\n ]*)", 1))
    is_html = (stated == "") | F.contains(stated, F.lit("html"))
    # Everything is made of these two in any case, so that what parts have in common is made once.
    as_html, as_text = F.when(is_html, F.col("payload")).otherwise(""), ~is_html & F.startswith(stated, F.lit("text/"))
    title = F.regexp_replace(F.regexp_extract(as_html, r"(?is)<title[^>]*>(.*?)</title", 1), r"\s+", " ")
    links = F.regexp_count(as_html, F.lit(r"(?i)<a\s[^>]*href"))
    text = F.concat(plain_text(as_html), F.when(as_text, F.col("payload")).otherwise(""))
    fields = F.concat_ws(
        END,
        F.concat(F.lit("title: "), F.trim(title)),
        F.concat(F.lit("outlinks: "), links.cast("string")),
        F.concat(F.lit("source-digest: "), F.col("payload_digest")),
        F.concat(F.lit("derived: "), urn(F.lit("conversion"), F.col("record_id"))),
        F.concat(F.lit("http-header: "), F.regexp_replace(F.rtrim("headers", F.lit(END)), r"\r\n", f"{END}http-header: ")),
        F.lit(""),
    )
    with_text = found.withColumns({"_fields": fields, "_text": text})
    both = F.array(_record("metadata", F.col("_fields"), "application/warc-fields"), _record("conversion", F.col("_text"), "text/plain; charset=utf-8"))
    return with_text.select(*keep, F.inline(both))


def serialise(records: DataFrame) -> Column:
    """A record as it stands in a WARC file."""
    return F.concat(F.col("head"), F.lit(END + END), F.col("block"), F.lit(END + END)).cast("binary")


def write(records: DataFrame, path: str, *, compression: str = "none") -> None:
    """WARC files under ``path``, one per task, from rows with ``head`` and ``block`` (a string or binary).

    A record never spans files. With ``gzip`` each record is a member of its own,
    so that readers may seek to it, and files end in ``.warc.gz``. Null heads
    are left out, null blocks are empty, and the bytes of a block are kept as they
    are. An empty table writes no record.
    """
    whole = F.concat(F.col("head").cast("binary"), F.lit(END + END).cast("binary"), F.coalesce(F.col("block").cast("binary"), F.lit(b"")))
    rows = records.where(F.col("head").isNotNull()).select(whole.alias("value"))
    if compression == "none":
        rows.select(F.col("value").cast("string")).write.option("lineSep", END + END).text(path)
        return
    if compression != "gzip":
        raise ValueError(f"unknown compression {compression!r}")
    bounded_arrow(records.sparkSession)

    def members(values: pd.Series) -> pd.Series:
        return pd.Series([_member(x) for x in values], dtype=object)

    made = rows.select(F.pandas_udf(members, "binary")("value").alias("value"))
    # A member's last byte is the sink's line end: zero, the highest byte of its length.
    made.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)
    _renamed(records.sparkSession, path)


def _member(record: bytes) -> bytes:
    """A record and its end as gzip, without the last byte, which is zero; a record of 16 MB and more is followed by an empty member for that."""
    out = gzip.compress(record + (END + END).encode(), 6, mtime=0)
    if out[-1]:
        out += gzip.compress(b"", mtime=0)
    return out[:-1]


def _renamed(spark: SparkSession, path: str) -> None:
    """The sink's files get the ending by which readers know the compression."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for x in fs.listStatus(root):
        name = x.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(x.getPath(), jvm.org.apache.hadoop.fs.Path(root, name.removesuffix(".txt") + ".warc.gz"))


def source_record(found: DataFrame) -> DataFrame:
    """``responses`` as records to ``write``: head, and the HTTP headers and payload as block."""
    block = F.concat(F.col("headers"), F.lit(END), F.col("payload"))
    head = F.concat_ws(
        END,
        F.lit("WARC/1.1"),
        F.lit("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), F.col("record_id")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("target_uri")),
        F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Payload-Digest: "), F.col("payload_digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return found.select(head.alias("head"), block.alias("block"))


NAMES = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest", "WARC-Block-Digest", "Content-Length")
COLUMNS = ["type", "record_id", "refers_to", "target_uri", "date", "payload_digest", "block_digest", "content_length", "head"]


def _stated(raw: Column) -> list[Column]:
    """The main headers of a record's head; absent ones are null."""
    header = lambda name: F.nullif(F.regexp_extract(raw, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit("")).alias(name.replace("WARC-", "").replace("-", "_").lower())
    return [header(x) for x in NAMES]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path``: their main headers, ``head``, ``block`` (binary) and ``complete``.

    A block has the stated length; ``complete`` is false where the file ends before
    that. Files are cut where a record may begin. A file in which fewer bytes than a
    record states stand before the next such place, because its block holds the line ends and version
    that begin a record, is put together in order by one task, which holds one record at a time.
    Absent headers are null, and a record without a length has an empty block. Plain and gzip files (by their ending) are read.
    """
    bounded_arrow(spark)
    rows = spark.read.option("lineSep", BREAK).text(path).select("value", F.substring_index("value", END + END, 1).alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = rows.where(F.octet_length("value") > 0)
    parts = rows.select("file", "start", *_stated(F.col("raw")), F.regexp_replace("raw", r"^(?:WARC/1\.)?", "WARC/1.").alias("head"), F.octet_length("raw").alias("at"), F.col("value").cast("binary").alias("bytes"))
    size = F.coalesce(F.col("content_length").try_cast("int"), F.lit(0))
    parts = parts.withColumn("block", F.substring(F.col("bytes"), F.col("at") + 5, size)).withColumn("complete", F.octet_length("block") == size)
    torn = parts.where("not complete").select("file").distinct()
    pieces = rows.select("file", "start", F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("bytes")).join(torn, "file", "left_semi")
    whole = pieces.repartition("file").sortWithinPartitions("file", "start", "place").mapInArrow(released(_joined), "head string, block binary, complete boolean")
    mended = whole.select(*_stated(F.col("head")), "head", "block", "complete")
    found = parts.join(torn, "file", "left_anti").select(*COLUMNS, "block", "complete").unionByName(mended.select(*COLUMNS, "block", "complete"))
    return found.withColumnsRenamed({"type": "record_type"}).withColumn("content_length", F.col("content_length").try_cast("bigint"))


_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records by their stated lengths from the pieces of files in order."""
    between, file, held, least = BREAK.encode(), None, [], 0

    def record() -> dict:
        raw = between.join(held)
        raw = raw if raw.startswith(b"WARC/1.") else b"WARC/1." + raw
        head, _, rest = raw.partition((END + END).encode())
        size = int(m[1]) if (m := _LENGTH.search(head)) else 0
        return {"head": head.decode("utf-8", "replace"), "block": rest[:size], "complete": len(rest) >= size}

    def needed(first: bytes) -> int:
        """Bytes of pieces and what stands between them until a record that begins so is whole."""
        head, mark, _ = first.partition((END + END).encode())
        return len(head) + len(mark) + (int(m[1]) if (m := _LENGTH.search(head)) else 0)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r["head"] for r in rows], pa.string()), pa.array([r["block"] for r in rows], pa.binary()), pa.array([r["complete"] for r in rows], pa.bool_())], names=["head", "block", "complete"])

    have = 0
    for b in batches:
        for name, piece in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
            if held and (name != file or have >= least):
                yield batch([record()])
                held, have = [], 0
            if not held:
                least = needed(piece)
            file = name
            have += len(piece) + (len(between) if held else 0)
            held.append(piece)
    if held:
        yield batch([record()])


_CHARSET = re.compile(rb"(?i)<meta[^>]{0,200}?charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)")


def _header(http: str, name: str) -> str:
    found = re.search(rf"(?im)^{name}:[ \t]*([^\r\n]*)", http)
    return found[1].strip().lower() if found else ""


def _unchunked(raw: bytes) -> bytes:
    """The body of chunks; what is no chunk ends it."""
    out, at = [], 0
    while found := re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n").match(raw, at):
        size = int(found[1], 16)
        out.append(raw[found.end() : found.end() + size])
        at = found.end() + size + 2
        if not size:
            break
    return b"".join(out)


def _inflated(raw: bytes, coding: str) -> bytes:
    """Without gzip or deflate; as it is if it cannot be undone."""
    try:
        if coding in ("gzip", "x-gzip"):
            return gzip.decompress(raw)
        if coding == "deflate":
            return zlib.decompress(raw) if raw[:1] == b"\x78" else zlib.decompress(raw, -15)
    except (OSError, EOFError, zlib.error):
        pass
    return raw


def decoded(http: str | None, raw: bytes | None) -> str:
    """A response's body as text: chunks joined, content codings undone, by the character set of its header, else of its ``meta``, else UTF-8."""
    http, raw = http or "", raw or b""
    if "chunked" in _header(http, "transfer-encoding"):
        raw = _unchunked(raw)
    for coding in reversed([x.strip() for x in _header(http, "content-encoding").split(",")]):
        raw = _inflated(raw, coding)
    stated = re.search(r"charset=[\"']?([\w.:-]+)", _header(http, "content-type"))
    meta = None if stated else _CHARSET.search(raw[:4096])
    name = stated[1] if stated else meta[1].decode("ascii") if meta else "utf-8"
    try:
        return raw.decode(name, "replace")
    except (LookupError, ValueError):  # a name that is no character set of texts
        return raw.decode("utf-8", "replace")


def responses_of(records: DataFrame) -> DataFrame:
    """The response records of ``read`` as ``derivatives`` takes them: the source's URL, date, HTTP headers and payload digest.

    Payloads are texts by ``decoded``; bytes that the character set does not have become U+FFFD. A missing digest
    is taken from the payload's bytes as they stand in the record.
    """
    bounded_arrow(records.sparkSession)
    found = records.where("lower(record_type) = 'response'").withColumn("http", F.substring_index(F.col("block").cast("string"), END + END, 1))
    raw = F.substring(F.col("block"), F.octet_length("http") + 5, F.octet_length("block"))
    # Plain UTF-8, as most responses are, needs no Python.
    other = F.col("http").rlike(r"(?im)^(?:transfer-encoding|content-encoding):") | ~F.is_valid_utf8(raw.cast("string")) | (F.col("http").rlike(r"(?im)^content-type:[^\r\n]*charset=") & ~F.col("http").rlike(r"(?im)^content-type:[^\r\n]*charset=[\"']?utf-?8"))
    texts = F.pandas_udf(lambda http, body: pd.Series([decoded(h, x) for h, x in zip(http, body, strict=True)], dtype=object), "string")
    undone = texts(F.make_valid_utf8(F.col("http")), F.when(other, raw))
    return found.select("record_id", F.coalesce("target_uri", F.lit("")).alias("target_uri"), F.concat("http", F.lit(END)).alias("headers"), F.when(other, undone).otherwise(raw.cast("string")).alias("payload"), F.coalesce("payload_digest", F.concat(F.lit("sha256:"), F.sha2(raw, 256))).alias("payload_digest"), F.coalesce("date", F.lit(DATE)).alias("date"))
