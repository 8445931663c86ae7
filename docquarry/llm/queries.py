"""One query for each operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, blocknames, conversations, decontaminate, linededup, media, packing, pii, secrets, simhash, tokenfile, toxicity, warc
from .common import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return tokenfile.digests(pieces, keep=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]).drop("n_tokens")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.remove_repeats(docs, count_col="n_deleted")


def _digest(spans: str, kinds: tuple[str, ...]) -> tuple:
    """Base digest and listing of a span array; kinds beyond ``kinds`` are left out of the digest."""
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter(F.col(spans), lambda x: x["kind"].isin(*kinds))
    joined = lambda a: F.array_join(F.transform(a, text), ",")
    return F.sha2(joined(base).cast("binary"), 256), joined(F.col(spans))


def _counts(spans: str, kinds: tuple[str, ...]) -> list:
    of = lambda kind: F.size(F.filter(F.col(spans), lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return [of(x) for x in kinds]


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(_table(spark, sf_dir, "documents"))
    base, listed = _digest("spans", pii.KINDS)
    return found.select("doc_id", *_counts("spans", (*pii.KINDS, "term")), base.alias("base_sha256"), listed.alias("spans"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, listed = _digest("secrets", secrets.KINDS[:3])
    return found.select("doc_id", *_counts("secrets", secrets.KINDS), base.alias("base_sha256"), listed.alias("spans"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), toxicity.score(F.col("text"), model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens-orc")
    tokenfile.write(_table(spark, sf_dir, "documents"), path)
    return tokenfile.digests(tokenfile.read(spark, path), keep=["doc_id", "start"])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derivatives(warc.responses(_table(spark, sf_dir, "pages")), keep=["page_id"])
    size, head = F.octet_length("block").cast("long").alias("content_length"), F.sha2(F.col("head").cast("binary"), 256).alias("head_sha256")
    return records.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", size, head)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    docs = docs.withColumn("payload", media.padded(F.col("raw")))
    path = scratch_path(spark, "media")
    media.store(docs, path)
    # Each document as a page: its number, then its payload as a figure with the number as caption.
    number, at = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), media.address(F.col("payload"))
    page = F.format_string("<article><p>%s</p><figure><img src='%s'><figcaption>%s</figcaption></figure></article>", number, at, number)
    pages = docs.select("doc_id", F.coalesce(F.octet_length("raw"), F.lit(0)).cast("long").alias("n_bytes"), page.alias("html"))
    sequences = pages.select("doc_id", "n_bytes", media.parse(F.col("html")).alias("elements"))
    found = media.resolve(sequences, media.features(media.load(spark, path)), keys=["doc_id", "n_bytes"])
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, absent = conversations.damaged(_table(spark, sf_dir, "conversations"))
    return conversations.audits(turns, conv_col="conv", absent=absent).withColumnRenamed("conv", "conv_id")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocknames.report(_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


QUERIES = {f.__name__: f for f in (op1_packing, op2_simhash, op3_line_dedup, op4_pii, op5_secrets, op6_toxicity, op7_token_orc, op8_decontaminate, op9_warc, op10_media, op11_conversations, op12_exact_dedup, op13_alignment)}
ORACLE_SQL: dict[str, str] = {
    "op12_exact_dedup": r"""
WITH t AS (SELECT doc_id, coalesce(length(text), 0) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY plain ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY plain) AS group_size,
       row_number() OVER (PARTITION BY plain ORDER BY chars DESC, doc_id) = 1 AS kept,
       sha256(plain) AS text_sha256
FROM t""",
}
