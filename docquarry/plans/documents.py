"""Queries of structure, metadata, relationships, evidence and access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import html as H
from docquarry.functions import text as T
from docquarry.operators import access, colinks, evidence, graphs, metadata, relations, sampling, structure
from docquarry.plans.registry import query
from docquarry.sources.tables import table

WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
SQUEEZE = r"trim(regexp_replace({}, '[ \t\n\f\r]+', ' ', 'g'))"
UNTAG = SQUEEZE.format("regexp_replace({}, '<[^>]*>', ' ', 'g')")
SHOWN = r"regexp_replace(regexp_replace({}, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g')"
TEXT = UNTAG.replace("{}", SHOWN)
BLOCK = r"(?i)<(p|li|h1)\b[^>]*>((?:[^<]+|</?(?:b|a|i|em|strong|span)\b[^>]*>)*)"
HREF = r"""(?i)<a\b[^>]*?\bhref="([^"]*)\""""
URL = r"regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)"


def _long(*columns) -> list:
    return [F.col(c).cast("bigint").alias(c) for c in columns]


@query("SELECT doc_id, unnest(range(len(l)))::BIGINT AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def structure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.lines(table(spark, sf_dir, "documents"))


@query(r"SELECT doc_id, unnest(range(len(l)))::BIGINT AS pos, unnest(l) AS sentence FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[.!?]+(?:[ \t\n\f\r]+|\z)'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(12) || chr(13)) <> '') AS l FROM documents)")
def structure_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.sentences(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, unnest(range(len(w)))::BIGINT AS pos, unnest(w) AS term FROM (SELECT doc_id, {WORDS} AS w FROM documents)")
def structure_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.tokens(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, (i - 1)::BIGINT AS pos, array_to_string(w[i:i+4], ' ') AS ngram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents))")
def structure_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.ngrams(table(spark, sf_dir, "documents"), 5)


@query(
    f"SELECT page_id, {TEXT.format('html')} AS text, {SQUEEZE.format(chr(10).join(['''regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)''']))} AS title, "
    + UNTAG.format(r"regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1)")
    + " AS h1, "
    + TEXT.format(r"regexp_extract(html, '(?is)<article\b[^>]*>(.*)</article>', 1)")
    + " AS main FROM pages"
)
def structure_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", H.html_text(html).alias("text"), H.html_title(html).alias("title"), H.html_h1(html).alias("h1"), H.main_content(html).alias("main"))


@query(f"SELECT page_id, unnest(range(len(k)))::BIGINT AS pos, lower(unnest(k)) AS kind, {UNTAG.format('unnest(t)')} AS text FROM (SELECT page_id, regexp_extract_all(html, '{BLOCK}', 1) AS k, regexp_extract_all(html, '{BLOCK}', 2) AS t FROM pages)")
def structure_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.blocks(table(spark, sf_dir, "pages"))


@query(f"SELECT page_id, unnest(range(len(l)))::BIGINT AS pos, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, '{HREF}', 1) AS l FROM pages)")
def structure_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.links(table(spark, sf_dir, "pages"))


@query(f"SELECT doc_id, n::BIGINT AS chunk_no, (n * 40)::BIGINT AS start_tok, len(w[n*40+1:n*40+50])::BIGINT AS n_tok, array_to_string(w[n*40+1:n*40+50], ' ') AS text FROM (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w)-50)/40.0)::INT, 0) + 1)) AS n FROM (SELECT doc_id, {WORDS} AS w FROM documents))")
def structure_chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.chunk_tokens(table(spark, sf_dir, "documents"), 50, 40)


@query("SELECT doc_id, n::BIGINT AS chunk_no, (n * 500 + 1)::BIGINT AS start, length(substring(text, n*500+1, 500))::BIGINT AS length, substring(text, n*500+1, 500) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text)-500)/500.0)::INT, 0) + 1)) AS n FROM documents)")
def structure_chunk_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.chunk_chars(table(spark, sf_dir, "documents"), 500)


@query(f"SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&') AS text FROM (SELECT page_id, {TEXT.format('html')} AS t FROM pages)")
def structure_unescaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.unescape(H.html_text(F.col("html"))).alias("text"))


@query("SELECT page_id, 0::BIGINT AS pos, 1::BIGINT AS level, " + UNTAG.format(r"regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1)") + r" AS text, NULL::BIGINT AS parent FROM pages WHERE regexp_matches(html, '(?is)<h1\b[^>]*>(.*?)</h1>')")
def structure_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have first-level headings only; trees are covered by a hand-built test."""
    return structure.outline(table(spark, sf_dir, "pages")).select("page_id", *_long("pos", "level"), "text", *_long("parent"))


@query(f"SELECT doc_id, length(text)::BIGINT AS n_chars, strlen(text)::BIGINT AS n_bytes, len({WORDS})::BIGINT AS n_tokens FROM documents")
def metadata_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.sizes(table(spark, sf_dir, "documents"))


@query(rf"SELECT page_id, {URL.format('url')} AS host, regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query FROM pages")
def metadata_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *(H.url_part(F.col("url"), x).alias(x.lower()) for x in ("HOST", "PATH", "QUERY")))


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS sum_k, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.count("*").alias("n"))


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS sum_k FROM events GROUP BY event_type")
def metadata_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.variant_get(F.parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("sum_k"))


@query("SELECT lang, count(*)::BIGINT AS n, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(stddev_samp(n_chars), 6) AS sd FROM documents GROUP BY lang")
def metadata_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metadata.facet_profile(table(spark, sf_dir, "documents"), ["lang"], "n_chars")
    return found.select("lang", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p90", "sd")))


@query("SELECT lang, source, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars, grouping_id(lang, source)::BIGINT AS level FROM documents GROUP BY CUBE (lang, source)")
def metadata_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("bigint").alias("level"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, 'Apache License') THEN 'Apache' WHEN regexp_matches(text, 'MIT License') THEN 'MIT' WHEN regexp_matches(text, 'GNU General Public License|\bGPL\b') THEN 'GPL' WHEN regexp_matches(text, 'CC BY-NC') THEN 'CC BY-NC' END AS licence FROM documents")
def metadata_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", metadata.licence(F.col("text")).alias("licence"))


@query(f"SELECT doc_id, md5(text) AS content_hash, round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 6) AS mean_word, round(len(list_distinct(w)) / len(w), 6) AS type_token FROM (SELECT doc_id, text, {WORDS} AS w FROM documents)")
def metadata_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", "text", T.tokens(F.col("text")).alias("w"))
    w = F.col("w")
    return words.select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), F.round(T.mean_word_length(w), 6).alias("mean_word"), F.round(T.type_token_ratio(w), 6).alias("type_token"))


@query("SELECT doc_id, lang AS lang_attr, source AS source_attr, 2::BIGINT AS n_attrs FROM documents")
def metadata_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metadata.attributes(table(spark, sf_dir, "documents"), ["lang", "source"])
    return found.select("doc_id", F.col("attrs")["lang"].alias("lang_attr"), F.col("attrs")["source"].alias("source_attr"), F.size("attrs").cast("bigint").alias("n_attrs"))


@query("SELECT lang, quality, toxic, count(*)::BIGINT AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality, toxic")
def metadata_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"))


def _language_sql() -> str:
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    scores = ", ".join(f"len(list_intersect(w, {listed(words)})) AS {code}" for code, words in metadata.STOP_WORDS.items())
    codes = sorted(metadata.STOP_WORDS)
    best = f"greatest({', '.join(codes)})"
    cases = " ".join(f"WHEN {c} = {best} THEN '{c}'" for c in codes)
    return f"SELECT doc_id, CASE WHEN {best} = 0 THEN NULL {cases} END AS told FROM (SELECT doc_id, {scores} FROM (SELECT doc_id, list_distinct({WORDS}) AS w FROM documents))"


@query(_language_sql())
def metadata_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", metadata.language(F.col("text")).alias("told"))


@query("SELECT md5(text) AS content_hash, min(doc_id) AS original, count(*)::BIGINT AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def relations_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.copies(table(spark, sf_dir, "documents"))


@query("SELECT line, count(DISTINCT doc_id)::BIGINT AS n_docs, count(DISTINCT source)::BIGINT AS n_sources FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) > 1")
def relations_shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.shared_lines(table(spark, sf_dir, "documents"))


RESOLVED = r"""CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^([^:/?#]+:)', 1) || href WHEN href LIKE '/%' THEN regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || href WHEN regexp_matches(href, '^([?#]|$)') THEN regexp_extract(url, '^([^:/?#]+://[^/?#]*[^?#]*)', 1) || href ELSE regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || '/' || regexp_extract(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '^/(.*/)', 1) || href END"""
PLACE = r"nullif(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+[^?#]*)', 1), '')"


@query(
    rf"WITH l AS (SELECT src, url, unnest(range(len(h)))::BIGINT AS pos, unnest(h) AS href FROM (SELECT page_id AS src, url, regexp_extract_all(html, '{HREF}', 1) AS h FROM pages)), t AS (SELECT src, pos, href, {RESOLVED} AS target FROM l), "
    rf"p AS (SELECT {PLACE.format('url')} AS place, min(page_id) AS dst FROM pages GROUP BY 1) SELECT src, pos, href, target, dst FROM t LEFT JOIN p ON {PLACE.format('target')} = place"
)
def relations_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.link_edges(table(spark, sf_dir, "pages"))


@query(rf"SELECT {URL.format('url')} AS host, {URL.format('target')} AS href_host, count(*)::BIGINT AS n_links, count(DISTINCT url)::BIGINT AS n_pages FROM (SELECT url, {RESOLVED} AS target FROM (SELECT url, unnest(regexp_extract_all(html, '{HREF}', 1)) AS href FROM pages)) WHERE {URL.format('target')} <> '' GROUP BY 1, 2")
def relations_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.host_links(table(spark, sf_dir, "pages"))


# A letter class in place of a word boundary, which the two engines see differently beside letters beyond ASCII.
@query(
    r"WITH m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+)', 1)) AS v FROM documents) "
    "SELECT a.v AS a, b.v AS b, count(*)::BIGINT AS n_docs FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.v < b.v GROUP BY 1, 2"
)
def relations_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.cooccurrence(relations.mentions(table(spark, sf_dir, "documents")))


QUOTES = "WITH f AS (SELECT doc_id, source, text, item_id, instr(documents.text, q)::BIGINT AS start, length(q)::BIGINT AS length, q FROM documents, (SELECT item_id, text AS q FROM benchmark) WHERE instr(documents.text, q) > 0) "


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    wanted = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return docs, evidence.quotes(docs, wanted)


@query(QUOTES + "SELECT doc_id, item_id, start, length FROM f")
def evidence_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir)[1]


@query(QUOTES + "SELECT DISTINCT md5(md5(text) || ':' || doc_id || ':' || start || ':' || length) AS evidence_id, doc_id, source, start, length, q AS quote, md5(text) AS content_hash FROM f")
def evidence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spans = _spans(spark, sf_dir)
    return evidence.records(docs, spans.drop("item_id").distinct())


@query(QUOTES + "SELECT doc_id, item_id, (substring(text, start, length) = q) AS holds FROM f")
def evidence_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spans = _spans(spark, sf_dir)
    wanted = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    joined = spans.join(docs.select("doc_id", "text"), "doc_id").join(wanted, "item_id")
    return joined.select("doc_id", "item_id", evidence.verified(F.col("text"), F.col("start"), F.col("length"), F.col("quote")).alias("holds"))


@query(QUOTES + "SELECT item_id, count(DISTINCT doc_id)::BIGINT AS n_docs, count(DISTINCT source)::BIGINT AS n_sources FROM f GROUP BY item_id")
def evidence_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spans = _spans(spark, sf_dir)
    return evidence.corroboration(spans, docs)


@query(QUOTES + "SELECT item_id, count(*)::BIGINT AS n_docs, count(DISTINCT source)::BIGINT AS n_sources FROM (SELECT item_id, md5(text) AS h, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM f GROUP BY 1, 2) GROUP BY item_id")
def evidence_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spans = _spans(spark, sf_dir)
    return evidence.corroboration(spans, docs, independent=True)


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'removed' WHEN doc_id % 10 = 1 THEN 'changed' ELSE 'added' END AS change FROM documents WHERE doc_id % 10 IN (0, 1, 2)")
def evidence_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots derived from the table: ids ending in 0 are gone, in 1 changed, in 2 new."""
    docs, last = table(spark, sf_dir, "documents"), F.col("doc_id") % 10
    after = docs.where(last != 0).withColumn("text", F.when(last == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return evidence.version_diff(docs.where(last != 2), after)


@query("SELECT '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\",\"n_chars\":' || n_chars || '}' AS line FROM documents")
def access_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.export_json(table(spark, sf_dir, "documents"), ["doc_id", "lang", "source", "n_chars"])


@query("SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def access_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.transcripts(table(spark, sf_dir, "conversations"))


BUCKET = "(('0x' || substring(md5(doc_id::VARCHAR), 1, 15))::BIGINT)"


@query(f"SELECT doc_id, CASE WHEN {BUCKET} % 10 < 8 THEN 'train' WHEN {BUCKET} % 10 < 9 THEN 'valid' ELSE 'test' END AS split FROM documents")
def access_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.split(table(spark, sf_dir, "documents"), {"train": 8, "valid": 1, "test": 1}).select("doc_id", "split")


@query(f"SELECT doc_id, lang FROM documents WHERE {BUCKET} % 1000000 < CASE lang WHEN 'en' THEN 0.5 WHEN 'de' THEN 1.0 ELSE 0.0 END * 1000000")
def access_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling is the feature here."""
    return access.mixture(table(spark, sf_dir, "documents"), {"en": 0.5, "de": 1.0}).select("doc_id", "lang")


@query(
    "WITH RECURSIVE e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY md5(text)) AS b FROM documents UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY line) FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> ''), "
    "u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), r AS (SELECT DISTINCT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node) SELECT node AS doc_id, min(root) AS cluster FROM r GROUP BY node"
)
def relations_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined by equal texts or by a line that both have, over any number of steps."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.explode(F.array_distinct(T.lines(F.col("text")))).alias("line")).where("line <> ''")
    by_line = lines.select("doc_id", F.xxhash64("line").alias("h"), "line")
    first = by_line.groupBy("h", "line").agg(F.min("doc_id").alias("least")).select("h", F.col("line").alias("own"), "least")
    shared = by_line.join(first, (by_line["h"] == first["h"]) & (by_line["line"] == first["own"])).select("doc_id", "least")
    texts = docs.select("doc_id", T.content_hash(F.col("text")).alias("t"))
    equal = texts.join(texts.groupBy("t").agg(F.min("doc_id").alias("least")), "t").select("doc_id", "least")
    found = graphs.clusters(shared.unionByName(equal), a_col="doc_id", b_col="least")
    return found.select(F.col("node").alias("doc_id"), F.col("root").alias("cluster"))


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY -ln((('0x' || substr(md5('7:' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / n_chars, doc_id) AS r FROM documents) WHERE r <= 25")
def access_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-five documents of each language, drawn in proportion to their length. Sampling is the feature here."""
    return sampling.stratified(table(spark, sf_dir, "documents"), 25, "lang", weight_col="n_chars", seed=7).select("doc_id", "lang")


@query(
    rf"WITH l AS (SELECT DISTINCT {URL.format('url')} AS host, {URL.format('target')} AS target FROM (SELECT url, {RESOLVED} AS target FROM (SELECT url, unnest(regexp_extract_all(html, '{HREF}', 1)) AS href FROM pages)) WHERE {URL.format('target')} <> ''), s AS (SELECT host, list(target ORDER BY target) AS t FROM l GROUP BY host), c AS (SELECT min(host) AS class, t FROM s GROUP BY t), "
    "p AS (SELECT a.class AS a, b.class AS b, len(list_intersect(a.t, b.t)) AS common, len(a.t) + len(b.t) AS total FROM c a JOIN c b ON a.class < b.class) SELECT a, b, common::BIGINT AS common, round(common / (total - common), 6) AS similarity FROM p WHERE common / (total - common) >= 0.3"
)
def relations_colinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of hosts, named by their least host, whose sets of linked hosts have a Jaccard similarity of 0.3 or more."""
    edges = relations.host_links(table(spark, sf_dir, "pages"))
    pairs, _ = colinks.similar(edges, 0.3, target_col="href_host")
    return pairs.withColumn("similarity", F.round("similarity", 6))
