"""Interleaved document sequences: ordered text and media references with their payloads.

``parse`` turns HTML into an ordered array of elements, each a text or a
reference to a medium by the digest of its bytes, with its caption. ``store``
keeps payloads as grey images of one byte a sample (binary PGM) in Parquet,
addressed by digest, and ``resolve`` joins references and media on the digest,
so position and caption stay with the payload.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_arrow, materialise

#: Samples of an image row; payloads are padded to a multiple of it.
WIDTH = 64
#: What the width, height and 255 of an image stand between in its header.
HEADER = "P5\n%d %d\n255\n"
#: References to one medium, and the inverse of their share of all, above which they are dealt to several tasks.
HOT_ROWS, HOT_MEDIA = 256, 10_000
_HIDDEN, _BREAKS = {"script", "style", "template", "head"}, {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "article", "section", "nav", "footer", "header", "br", "figure", "figcaption", "body", "blockquote", "pre"}
_MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source", "embed": "embed"}


class _Elements(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.words: list[str] = []
        self.hidden, self.figure, self.caption = 0, -1, None

    def _flush(self) -> None:
        text, self.words = " ".join("".join(self.words).split()), []
        if text and self.caption is not None:
            self.caption.append(text)
        elif text:
            self.out.append({"kind": "text", "text": text, "media": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _HIDDEN:
            self._flush()
            self.hidden += 1
        elif tag in _BREAKS:
            self._flush()
            if tag == "figure":
                self.figure = len(self.out)
            elif tag == "figcaption":
                self.caption = []
        elif tag in _MEDIA and not self.hidden:
            self._flush()
            own = dict(attrs)
            self.out.append({"kind": _MEDIA[tag], "text": None, "media": own.get("src"), "caption": own.get("alt") or None})

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
            self.words = []
        elif tag in _BREAKS:
            self._flush()
            if tag == "figcaption" and self.caption is not None:
                text, self.caption = " ".join(self.caption), None
                for x in self.out[max(0, self.figure) :] if text and self.figure >= 0 else ():
                    if x["media"] is not None:
                        x["caption"] = text
            elif tag == "figure":
                self.figure = -1

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.words.append(data)


def elements(html: str | None) -> list[dict]:
    """Texts and media of a page in reading order, with their position from 0; none for null."""
    parser = _Elements()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    if parser.caption:
        parser.out.append({"kind": "text", "text": " ".join(parser.caption), "media": None, "caption": None})
    return [{"position": k, **x} for k, x in enumerate(parser.out)]


def parse(html: Column) -> Column:
    """array<struct<position, kind, text, media, caption>> of a column of HTML; empty for null or empty HTML."""
    return F.pandas_udf(lambda pages: pd.Series([elements(x) for x in pages], dtype=object), "array<struct<position:int,kind:string,text:string,media:string,caption:string>>")(html)


def padded(raw: Column) -> Column:
    """Binary with zero bytes appended up to a positive multiple of ``WIDTH``; null counts as empty."""
    raw = F.coalesce(raw, F.lit(b""))
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / WIDTH)) * WIDTH
    return F.rpad(raw, size.cast("int"), F.lit(b"\0"))


def address(payload: Column) -> Column:
    """Name of a payload in the store: the SHA-256 of its bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(payload, 256))


def store(payloads: DataFrame, path: str, *, payload_col: str = "payload") -> None:
    """Write each payload of ``payloads`` as an image: (media, image) rows in Parquet under ``path``.

    Payloads must be padded. Equal payloads give equal rows; they are not
    brought together here, which would move every payload through a shuffle.
    """
    height = F.octet_length(payload_col) / WIDTH
    image = F.concat(F.format_string(HEADER, F.lit(WIDTH), height.cast("int")).cast("binary"), F.col(payload_col))
    payloads.select(address(F.col(payload_col)).alias("media"), image.alias("image")).write.option("compression", "zstd").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """media, image and the payload read back from each image's samples."""
    rows = spark.read.schema("media string, image binary").parquet(path)
    # The header ends with the third line feed.
    size = F.length(F.substring_index(F.decode(F.substring("image", 1, 40), "ISO-8859-1"), "\n", 3)) + 1
    return rows.withColumn("payload", F.substring("image", size + 1, F.octet_length("image") - size))


def features(media: DataFrame) -> DataFrame:
    """One row per medium: sizes, digests and a 16-digit feature of its samples.

    The feature has a hexadecimal digit for the mean of each sixteenth of the
    image's columns, scaled by 16. Copies of a medium are merged after each
    task has reduced its own.
    """
    bounded_arrow(media.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for raw in b.column(0).to_pylist():
                means = np.frombuffer(raw, dtype=np.uint8).reshape(-1, WIDTH).mean(axis=0).reshape(16, -1).mean(axis=1)
                found.append("".join(f"{int(x) >> 4:x}" for x in means))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found, pa.string())], names=[*b.schema.names[1:], "feature"])

    seen = media.select(
        "payload",
        "media",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -WIDTH, WIDTH)).alias("tail_crc32"),
        F.octet_length("image").cast("long").alias("media_bytes"),
        F.sha2("image", 256).alias("media_sha256"),
    )
    schema = "media string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    made = seen.mapInArrow(rows, schema)
    return made.groupBy("media").agg(*(F.min(x).alias(x) for x in made.columns[1:]))


def _free(name: str, taken: set[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name in taken:
        name += "_"
    return name


def resolve(sequences: DataFrame, media: DataFrame, *, keys: list[str], elements_col: str = "elements", texts: bool = False) -> DataFrame:
    """One row per media reference: ``keys``, position, kind, media, caption and the columns of ``media``; with ``texts`` one per element of the sequences, with its ``text``.

    A text element keeps its place in the sequence, with nulls for the media columns; it joins nothing.
    ``media`` has one row per medium. References that it lacks keep their row,
    with nulls. References are written once and counted by medium; a medium
    with more than ``HOT_ROWS`` of them, and more than one in ``HOT_MEDIA`` of
    all, is dealt out: its row is repeated and its references take the
    repetitions in turn. Hence at most ``HOT_MEDIA`` counts are broadcast.
    """
    refs = materialise(sequences.select(*keys, F.inline(elements_col)).where("media is not null").drop("text"), "references")
    taken = {x.lower() for x in [*refs.columns, *media.columns]}
    part, parts = _free("part", taken), _free("parts", taken)
    most = max(HOT_ROWS, refs.count() // HOT_MEDIA)
    counts = refs.groupBy("media").agg(F.ceil(F.count(F.lit(1)) / most).alias(parts))
    hot = F.broadcast(counts.where(F.col(parts) > 1))
    dealt = F.coalesce(F.col(parts), F.lit(1))
    refs = refs.join(hot, "media", "left").withColumn(part, F.pmod(F.monotonically_increasing_id(), dealt)).drop(parts)
    media = media.join(hot, "media", "left").withColumn(part, F.explode(F.sequence(F.lit(0), dealt - 1))).drop(parts)
    found = refs.join(media, ["media", part], "left").drop(part)
    if not texts:
        return found
    written = sequences.select(*keys, F.inline(elements_col)).where("media is null")
    columns = [*keys, "position", "kind", "text", "media", "caption"]
    found = found.withColumn("text", F.lit(None).cast("string")).select(*columns, *(c for c in found.columns if c not in columns))
    return found.unionByName(written.select(*columns), allowMissingColumns=True)
