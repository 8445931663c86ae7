"""Personal data: fixed shapes, and terms that disclose them by co-occurrence.

Everything here is made of Spark functions. Four shapes (email, ip, card, phone)
are protected entities. Over the whole corpus the terms standing close to an
entity are counted: with p(c) the share of documents that hold an entity of
kind c, and p(c|t) the share of the documents with term t in which it stands
next to one, the pointwise mutual information PMI(c;t) = ln p(c|t)/p(c) says
how strongly t reveals c, and PMI over the information content -ln p(c) is its
disclosure, at most 1. Terms beyond a threshold, that stood next to enough
different entities, become spans of kind ``term`` wherever they occur, and
``sanitise`` generalises them to the name of the kind they disclose.

The patterns are written with possessive repetitions and guards so that a text
is scanned once and without recursion, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

KINDS = ("email", "ip", "card", "phone")
#: Equal in result to the plain patterns of the docstring of ``base_spans``. ``\G`` is the end of the match before.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters of context on either side of an entity, and the different entities a term must have stood next to.
REACH, SUPPORT = 64, 5
#: Disclosure from which a term is reported.
DISCLOSURE = 0.75
_OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})?"
_WORD = r"[^\p{L}\p{N}]+"


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.split(F.regexp_replace(match, "[^0-9]", ""), ""))
    digits = F.filter(digits, lambda x: x != "")

    def value(x: Column, at: Column) -> Column:
        d = x.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(at % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.transform(digits, value), F.lit(0), lambda a, x: a + x)
    return (F.size(digits) <= 19) & (total % 10 == 0)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _possible(kind: str, text: Column) -> Column:
    """Cheap and necessary, so that few texts reach the pattern."""
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")
    if kind == "card":
        return text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")
    return F.contains(text, F.lit("@" if kind == "email" else "+"))


#: Matches of one text whose lengths are summed up once for all that follow.
BLOCK = 128
_SPAN = "array<struct<kind:string,start:int,end:int,match:string>>"


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside a lambda it would else be computed for each element."""
    return F.transform(F.array(value), body)[0]


def _located(kind: str, text: Column, pattern: Column) -> Column:
    """Spans of every match: what splitting leaves between the matches gives their positions in code points.

    The pattern runs twice over a text, whatever it finds. A match's place is a
    sum over the blocks of ``BLOCK`` matches before it and the rest of its own.
    """
    sums = lambda a, first, n: F.aggregate(F.slice(a, first + 1, n), F.lit(0), lambda x, y: x + y)
    block = lambda k: F.floor(k / F.lit(BLOCK)).cast("int")

    def placed(x: Column) -> Column:
        gaps, found = x["gaps"], x["found"]
        steps = F.zip_with(gaps, found, lambda g, m: g + F.coalesce(F.length(m), F.lit(0)))
        return _once(steps, lambda steps: _once(blocks(steps), lambda whole: F.transform(found, lambda m, k: span(m, sums(whole, F.lit(0), block(k)) + sums(steps, block(k) * BLOCK, k - block(k) * BLOCK) + F.get(gaps, k)))))

    def blocks(steps: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), block(F.size(steps) - 1)), lambda b: sums(steps, b * BLOCK, F.lit(BLOCK)))

    def span(match: Column, start: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match"))

    return _once(F.struct(F.transform(F.split(text, pattern, -1), F.length).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found")), placed)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, match>> by kind and start; code points, ends exclusive; empty for null.

    Leftmost non-overlapping matches of each kind by itself, failing ones
    dropped: email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip
    four dotted numbers of at most 255; card 13 to 19 digits, single spaces or
    hyphens between them, that pass Luhn; phone ``+`` and 9 to 15 digits.
    """
    found = []
    for kind in KINDS:
        kept = _keep(kind, _located(kind, text, F.lit(PATTERNS[kind])))
        found.append(F.when(_possible(kind, text), kept).otherwise(F.array().cast(_SPAN)))
    return F.coalesce(F.concat(*found), F.array().cast(_SPAN))


def _keep(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda x: _valid(kind, x["match"]))


def terms_of(text: Column) -> Column:
    """Lower-cased words of three letters or digits at least, each once."""
    return F.array_distinct(F.filter(F.split(F.lower(text), _WORD), lambda x: F.length(x) >= 3))


def disclosing_terms(docs: DataFrame, marked: DataFrame, *, text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(term, kind, disclosure) of the terms that reveal protected entities; the strongest kind of each.

    ``marked`` has the base spans (``spans``) and contexts (``near``) of every
    row of ``docs``. Documents are counted as rows in all four numbers, so copies
    weigh alike in each; only the support is of different entities. Every count
    is combined in the tasks before it is shuffled.
    """
    total = marked.count()
    kinds = marked.select(F.explode(F.array_distinct(F.col("spans.kind"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n_kind"))
    near = marked.where(F.size("near") > 0).select("near")
    each = F.array_distinct(F.flatten(F.transform("near", lambda s: F.transform(s["terms"], lambda t: F.struct(s["kind"].alias("kind"), t.alias("term"))))))
    both = near.select(F.inline(each)).groupBy("kind", "term").agg(F.count("*").alias("n_both"))
    stood = near.select(F.inline("near")).select("kind", "match", F.explode("terms").alias("term")).distinct()
    pairs = stood.groupBy("kind", "term").agg(F.count("*").alias("support")).where(F.col("support") >= support).join(both, ["kind", "term"])
    pairs = materialise(pairs.join(kinds, "kind"), "pii-pairs")
    wanted = pairs.select("term").distinct()
    frequency = docs.select(F.explode(terms_of(F.col(text_col))).alias("term")).join(wanted, "term").groupBy("term").agg(F.count("*").alias("n_term"))
    content = -F.ln(F.col("n_kind") / F.lit(total))
    shown = 1 + F.ln(F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))) / content
    found = pairs.where(F.col("n_kind") < total).join(frequency, "term").select("term", "kind", shown.alias("disclosure")).where(F.col("disclosure") >= disclosure)
    return found.groupBy("term").agg(F.max_by("kind", F.struct("disclosure", "kind")).alias("kind"), F.max("disclosure").alias("disclosure"))


def detect(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``id_col``, ``row`` (digest of the text) and ``spans``: base spans, then ``term`` spans by start.

    One row per row of ``df``. A null or empty text has no spans. Rows equal in
    id and text get equal results; a null id is carried as it is. Only spans
    and digests are shuffled unless a term is found; then the texts that hold
    one are read again.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = base_spans(text)
    near = F.transform(
        F.col("spans"),
        lambda s: F.struct(s["kind"].alias("kind"), s["match"].alias("match"), terms_of(F.concat_ws(" ", F.substring(F.col("_text"), F.greatest(F.lit(1), s["start"] + 1 - REACH), F.least(F.lit(REACH), s["start"])), F.substring(F.col("_text"), s["end"] + 1, F.lit(REACH)))).alias("terms")),
    )
    marked = df.select(F.col(id_col), text.alias("_text"), spans.alias("spans")).select(id_col, F.xxhash64("_text").alias("row"), "spans", near.alias("near"))
    marked = materialise(marked, "pii-marked")
    terms = materialise(disclosing_terms(df, marked, text_col=text_col, support=support, disclosure=disclosure), "pii-terms")
    if not terms.head(1):
        return marked.drop("near")
    holding = df.select(F.xxhash64(text).alias("row"), F.explode(terms_of(text)).alias("term")).join(terms, "term")
    holding = holding.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(F.length("term").alias("n"), "term", "kind"))).alias("held"))
    # Written first: where few texts hold a term, its size is then known and only those texts are moved.
    holding = materialise(holding, "pii-holding")
    texts = df.select(F.xxhash64(text).alias("row"), text.alias("_text"))
    once = texts.join(holding, "row").groupBy("row").agg(F.first("_text").alias("_text"), F.first("held").alias("held"))
    listed = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.reverse(F.col("held.term")), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    added = once.select("row", _located("term", F.col("_text"), listed).alias("added"))
    return marked.drop("near").join(added, "row", "left").select(id_col, "row", F.concat("spans", F.coalesce("added", F.array().cast(_SPAN))).alias("spans"))


def sanitise(text: Column, spans: Column) -> Column:
    """The text with every span generalised to ``[kind]``; of overlapping spans the earlier, longer one counts."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        shown = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] >= a["at"], F.struct((-s["back"]).alias("at"), shown.alias("out"))).otherwise(a)

    return F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
