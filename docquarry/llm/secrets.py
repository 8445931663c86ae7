"""Secret scans: fixed shapes, and strings that zstandard cannot explain.

Three shapes are always reported. Beyond them, a token that stands near a
sensitive word, on either side, is compressed by zstandard primed with the text around
it and a dictionary of common identifiers. The marginal bytes (with the
candidate, less without it) per byte of the candidate measure how new it is:
names, paths and words that the surroundings explain cost little, random keys
cost nearly all of their length. The shorter a token is, the less that can tell, so short
ones have to cost all of it and to mix letters and digits.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_arrow

#: Kinds in the order of their listing; ``novel`` is what compression adds.
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words near which a token is a candidate, and how many characters before or after.
SENSITIVE, REACH = re.compile(r"(?ai:credential|passphrase|private|bearer|authorization|signature|access[_ -]?key|api[_ -]?key|password|passwd|secret|token)"), 96
#: Characters that a candidate has at least, and below which it has to have letters and digits.
LEAST, SHORT = 12, 20
RUN = re.compile(r"[A-Za-z0-9+/_.-]+={0,2}")
_IN_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-=")
#: Characters on either side that prime the compressor.
AROUND = 2048
#: Marginal compressed bytes per byte from which a candidate is reported: of ``SHORT`` characters and more, and of fewer.
NOVELTY, SHORT_NOVELTY = 0.7, 0.95
IDENTIFIERS = (
    "access account address algorithm application argument array attribute authorization background boolean buffer "
    "bytes callback certificate client column command comment config configuration connection constant content context "
    "controller count create credential current data database default delete description directory document element "
    "endpoint environment error event exception execute expected export expression extension factory field file filter "
    "format function generate handler hash header host identifier import index information input instance integer "
    "interface internal item iterator key label language length level library listener local location logger manager "
    "message metadata method model module name namespace null number object offset operation option output package page "
    "parameter parent password path pattern payload permission pointer position prefix private process project property "
    "protected protocol provider public query queue random range receive record reference register repository request "
    "resource response result return schema script search secret section security selector sequence server service "
    "session setting signature source start state static status storage stream string structure suffix system table "
    "target template thread timestamp token transaction transform type undefined update upload user username util "
    "validate value variable version video view virtual visible warning width window worker write https://www.example.com "
    "0123456789abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
).encode()


def novelty(candidate: str, around: str) -> float:
    """Marginal compressed bytes per byte of ``candidate`` against the text around it and the identifiers."""
    import zstandard

    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + around.encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compressor = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    raw = candidate.encode()
    return (len(compressor.compress(raw)) - len(compressor.compress(b""))) / len(raw)


def _windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches within ``REACH`` of a sensitive word, joined where they meet and widened to whole runs of a token's characters; each place once."""
    near: list[list[int]] = []
    for word in SENSITIVE.finditer(text):
        lo, hi = max(0, word.start() - REACH), min(len(text), word.end() + REACH)
        if near and lo <= near[-1][1]:
            near[-1][1] = hi
        else:
            near.append([lo, hi])
    done = 0
    for lo, hi in near:
        lo = max(lo, done)
        while lo > done and text[lo - 1] in _IN_RUN:
            lo -= 1
        if hi > lo:
            run = RUN.match(text, hi) if hi < len(text) and text[hi - 1] in _IN_RUN else None
            done = run.end() if run else hi
            yield lo, done


def _plausible(raw: str) -> bool:
    """Long runs of letters or digits, or a shorter or dotted one with both."""
    both = any(x.isdigit() for x in raw) and any(x.isalpha() for x in raw)
    return len(raw) >= LEAST and (both or len(raw) >= SHORT and "." not in raw)


def _candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of the tokens near sensitive words, less what the ``taken`` spans (sorted) have of them; addresses of mails and pages are none."""
    starts, reach = [s for s, _ in taken], [0, *accumulate((e for _, e in taken), max)]
    for lo, hi in _windows(text):
        for m in RUN.finditer(text, lo, hi):
            start, end = m.span()
            if end - start < LEAST or text[end : end + 1] == "@" or text[start - 1 : start] == "@" or m[0].startswith("//"):
                continue
            parts = [(start, end)]
            if reach[bisect_left(starts, end)] > start:
                parts = []
                for s, e in (x for x in taken[: bisect_left(starts, end)] if x[1] > start):
                    parts.append((start, min(s, end)))
                    start = max(start, e)
                parts.append((start, end))
            for a, z in parts:
                while a < z and text[a] in "._-/+=":
                    a += 1
                while a < z and text[z - 1] in "._-/":
                    z -= 1
                if _plausible(text[a:z]):
                    yield a, z


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in code points, by start and kind; none for null or empty text."""
    if not text:
        return []
    low = text.lower()
    found = []
    if any(x in low for x in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    taken = sorted((s, e) for s, _, e in found)
    if any(x in low for x in ("credential", "passphrase", "private", "bearer", "authorization", "signature", "key", *_WORDS)):
        for a, z in _candidates(text, taken):
            limit = NOVELTY if z - a >= SHORT else SHORT_NOVELTY
            if novelty(text[a:z], text[max(0, a - AROUND) : a] + text[z : z + AROUND]) >= limit:
                found.append((a, 3, z))
    return sorted(found)


def scan(df: DataFrame, *, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """``df`` with ``out_col``: array of struct<kind, start, end, match> in order of start.

    Positions are code points, ends exclusive. Null and empty texts give an
    empty array. Every row is judged by itself, so repeated rows get equal
    results; a column called ``out_col`` is replaced, all others stay.
    """
    bounded_arrow(df.sparkSession)

    def one(text: str | None) -> list[tuple]:
        return [(KINDS[k], s, e, text[s:e]) for s, k, e in spans(text)]

    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "start", "end", "match"), x, strict=True)) for x in one(t)] for t in texts], dtype=object)

    return df.withColumn(out_col, F.pandas_udf(each, "array<struct<kind:string,start:int,end:int,match:string>>")(F.col(text_col)))
