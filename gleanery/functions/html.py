"""HTML gates, blocks, headings, links and metadata by built-in expressions (one regular expression pass each, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.url import is_crawlable, resolve

MIN_BYTES, MAX_BYTES, MIN_LETTERS = 500, 10 * 1024 * 1024, 200
#: Where the content type is looked for, in order of precedence; blog also looks at the url, video too.
CONTENT_TYPES = [
    ("faq", "faq|question|answer|help", ""), ("product", "buy|price|product|cart|shop|add to basket", ""), ("video", "video|watch|youtube", "video"), ("recipe", "recipe|ingredients|cook|servings", ""),
    ("review", "review|rating|stars", ""), ("blog", "blog|news|article|post|journal|press|update|editorial", "blog|news|post"),
]


def letters_outside_tags(html: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), "[^A-Za-z0-9]", ""))


def is_good_page(html: Column) -> Column:
    """500 bytes to 10 MB, an html or DOCTYPE tag (case as written), over 200 letters or digits outside tags."""
    return F.coalesce(F.octet_length(html).between(MIN_BYTES, MAX_BYTES) & (html.contains("<html") | html.contains("<!DOCTYPE")) & (letters_outside_tags(html) > MIN_LETTERS), F.lit(False))


def is_promising_page(html: Column) -> Column:
    """Markup in the first 500 characters and over 300 letters or digits in the first 5000."""
    return F.coalesce(F.lower(F.substring(html, 1, 500)).rlike("<html|<!doctype|<head|<body") & (letters_outside_tags(F.substring(html, 1, 5000)) > 300), F.lit(False))


def strip_blocks(html: Column) -> Column:
    """Without style, noscript, nav, header and footer blocks."""
    for tag in ("style", "noscript", "nav", "header", "footer"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    return html


def inner_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), r"\s+", " "))


_META = r"""(?is)<meta[^>]*(?:property|name)=["']{0}["'][^>]*content=["']([^"']*)["']"""


def _named(html: Column, names: tuple[str, ...], otherwise: Column) -> Column:
    """The trimmed content of the first of the names that the page has, null if that is blank; otherwise if it has none."""
    out = F.when(F.lit(False), None)
    for name in names:
        out = out.when(html.rlike(_META.format(name)), F.nullif(F.trim(F.regexp_extract(html, _META.format(name), 1)), F.lit("")))
    return out.otherwise(otherwise)


def title(html: Column) -> Column:
    """og:title, else twitter:title (null if the first of them that is there is blank), else the title element, else the first h1 with text."""
    element = lambda tag: F.nullif(inner_text(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    return _named(html, ("og:title", "twitter:title"), F.coalesce(element("title"), element("h1")))


def description(html: Column) -> Column:
    """og:description, else twitter:description, else description; null if the first of them that is there is blank."""
    return _named(html, ("og:description", "twitter:description", "description"), F.lit(None).cast("string"))


def headings(html: Column) -> Column:
    """struct(level, text) of h1 to h6 with text under 200 bytes, by level, then order in the page."""
    at_level = lambda n: lambda x: F.struct(F.lit(n).alias("level"), inner_text(x).alias("text"))
    per = [F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}>"), 1), at_level(n)) for n in range(1, 7)]
    return F.filter(F.concat(*per), lambda h: (h["text"] != "") & (F.octet_length(h["text"]) < 200))


def links(html: Column, base: Column) -> Column:
    """Distinct link targets of closed anchors, resolved and normalised, crawlable ones only; comments, scripts and styles don't count."""
    clean = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", ""), r"(?s)<!--.*?-->", "")
    found = F.regexp_extract_all(clean, F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"'#][^"']*)["'][^>]*>.*?</a>"""), 1)
    return F.filter(F.array_distinct(F.transform(found, lambda x: resolve(base, x))), lambda x: (x != "") & is_crawlable(x))


def content_type(page_title: Column, about: Column, url: Column) -> Column:
    text, low = F.lower(F.concat(F.coalesce(about, F.lit("")), F.lit(" "), F.coalesce(page_title, F.lit("")))), F.lower(url)
    out = F.when(F.lit(False), "")
    for name, words, in_url in CONTENT_TYPES:
        out = out.when(text.rlike(words) | (low.rlike(in_url) if in_url else F.lit(False)), name)
    return out.otherwise("article")
