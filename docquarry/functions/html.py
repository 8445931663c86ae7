"""Column functions over HTML and URLs, all of built-in Spark expressions.

The patterns repeat groups possessively, so a long page needs no deep
recursion. Null pages give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities of the pages; ``&amp;`` comes last so that nothing is unescaped twice.
ENTITIES = {"&quot;": '"', "&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&amp;": "&"}
#: Tags that stand inside a block.
INLINE = "b|a|i|em|strong|span"
BLOCK = rf"(?i)<(p|li|h1)\b[^>]*>((?:[^<]++|</?(?:{INLINE})\b[^>]*>)*+)"
HREF = r'(?i)<a\b[^>]*?\bhref="([^"]*)"'
HEADING = r"(?is)<h([1-6])\b[^>]*>(.*?)</h[1-6]>"
SPACE = r"[ \t\n\f\r]+"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def without_tags(html: Column) -> Column:
    return squeezed(F.regexp_replace(html, "<[^>]*>", " "))


def html_text(html: Column) -> Column:
    """Text of a page without scripts, styles and tags, white space collapsed."""
    shown = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script>", " ")
    return without_tags(F.regexp_replace(shown, r"(?is)<style\b[^>]*>.*?</style>", " "))


def html_title(html: Column) -> Column:
    return squeezed(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))


def html_h1(html: Column) -> Column:
    return without_tags(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))


def main_content(html: Column) -> Column:
    """Text of the article element; empty if there is none."""
    return html_text(F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*)</article>", 1))


def blocks(html: Column) -> Column:
    """array<struct<kind, text>> of paragraphs, list items and first-level headings in order.

    An unclosed block ends at the next tag that is not an inline one.
    """
    kinds = F.regexp_extract_all(html, F.lit(BLOCK), F.lit(1))
    texts = F.regexp_extract_all(html, F.lit(BLOCK), F.lit(2))
    return F.zip_with(kinds, texts, lambda k, t: F.struct(F.lower(k).alias("kind"), without_tags(t).alias("text")))


def links(html: Column) -> Column:
    """Link targets in order."""
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(1))


def headings(html: Column) -> Column:
    """array<struct<level, text>> of all headings in order."""
    levels = F.regexp_extract_all(html, F.lit(HEADING), F.lit(1))
    texts = F.regexp_extract_all(html, F.lit(HEADING), F.lit(2))
    return F.zip_with(levels, texts, lambda n, t: F.struct(n.cast("int").alias("level"), without_tags(t).alias("text")))


def table_rows(html: Column) -> Column:
    """array<array<string>>: the cells of each table row in order."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), without_tags))


def unescape(text: Column) -> Column:
    for entity, plain in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def url_part(url: Column, part: str) -> Column:
    """``HOST``, ``PATH`` or ``QUERY``; null where the URL cannot be parsed."""
    return F.try_parse_url(url, F.lit(part))


def resolve(base: Column, href: Column) -> Column:
    """An absolute URL from a page's URL and a link on it; dot segments stay, a null base or link gives null."""
    origin, path = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1), F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"^/(.*/)", 1))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:/?#]+:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.rlike(r"^([?#]|$)"), F.concat(origin, path, href))
        .otherwise(F.concat(origin, folder, href))
    )


def place(url: Column) -> Column:
    """Host and path of a URL; null without a host."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+[^?#]*)", 1), F.lit(""))


def host(url: Column) -> Column:
    """Host of a URL without its port; null without one."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1), F.lit(""))
