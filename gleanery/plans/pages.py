"""Queries over raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import gates as G
from gleanery.functions import html as H
from gleanery.functions.extract import extract
from gleanery.functions.url import HIGH_PRIORITY, bare_domain, crawl_priority
from gleanery.session import load


def _pages(spark, d):
    return load(spark, d, "raw_pages").select("page_id", "url", "depth", "content")


def page_gates(spark, d):
    c = F.col("content")
    return _pages(spark, d).select("page_id", H.is_good_page(c).alias("good"), H.is_promising_page(c).alias("promising"), F.coalesce(F.lower(F.substring(c, 1, 1000)).rlike("<html|<!doctype|<body"), F.lit(False)).alias("html"))


def page_metadata(spark, d):
    c = F.col("content")
    p = _pages(spark, d).select("page_id", "url", H.title(c).alias("title"), H.description(c).alias("description"), F.octet_length(H.strip_blocks(c)).alias("stripped_bytes"), H.headings(c).alias("h"))
    return p.select("page_id", "title", "description", "stripped_bytes", H.content_type(F.col("title"), F.col("description"), F.col("url")).alias("content_type"), F.size("h").alias("headings"), F.array_join(F.transform("h", lambda x: F.concat(x["level"].cast("string"), F.lit(":"), x["text"])), "|").alias("outline"))


def page_links(spark, d):
    return _pages(spark, d).select("page_id", F.explode(H.links(F.col("content"), F.col("url"))).alias("target"))


def discovered_links(spark, d):
    """New URLs of a crawl round with the best priority any page gives them: not crawled so far, anti-joined before the ranking."""
    pages = _pages(spark, d)
    found = pages.select("depth", F.explode(H.links(F.col("content"), F.col("url"))).alias("url")).groupBy("url").agg(F.min(F.col("depth") + 1).alias("depth"), F.count("*").alias("inlinks"))
    return found.join(pages.select("url").distinct(), "url", "left_anti").select("url", "depth", "inlinks", F.round(crawl_priority(F.col("url"), F.col("depth")), 6).alias("priority"))


def links_by_host(spark, d):
    """Links of each site: pages, links, links to other sites."""
    each = _pages(spark, d).select(bare_domain(F.col("url")).alias("site"), "page_id", F.explode_outer(H.links(F.col("content"), F.col("url"))).alias("target"))
    return each.groupBy("site").agg(F.countDistinct("page_id").alias("pages"), F.count("target").alias("links"), F.count_if(bare_domain(F.col("target")) != F.col("site")).alias("outward"))


def page_language(spark, d):
    c = F.col("content")
    return _pages(spark, d).select("page_id", G.language_info(c, F.col("url")).alias("i"), F.round(G.technical_score(c), 6).alias("technical")).select("page_id", "i.language", "i.confidence", "i.english_url", "technical")


def page_extraction(spark, d):
    """Metadata, main text and headings of every page from its element tree."""
    return extract(_pages(spark, d), "page_id", "url", "content")


QUERIES = {f.__name__: f for f in (page_gates, page_metadata, page_links, discovered_links, links_by_host, page_language, page_extraction)}

from gleanery.functions.url import excluded_regex  # noqa: E402
from gleanery.plans.urls import _norm  # noqa: E402

_LET = "length(regexp_replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '[^A-Za-z0-9]', '', 'g'))"
_META = r"""nullif(trim(regexp_extract(content, '(?is)<meta[^>]*(?:property|name)=["'']{0}["''][^>]*content=["'']([^"'']*)["'']', 1)), '')"""
_named = lambda name: rf"""WHEN regexp_matches(content, '(?is)<meta[^>]*(?:property|name)=["'']{name}["''][^>]*content=["'']([^"'']*)["'']') THEN {_META.format(name)}"""
_INNER = r"trim(regexp_replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))"
_EL = "nullif(" + _INNER.format(r"regexp_extract(content, '(?is)<{0}\b[^>]*>(.*?)</{0}>', 1)").replace("{{0}}", "{0}") + ", '')"
_strip = "content"
for _t in ("style", "noscript", "nav", "header", "footer"):
    _strip = rf"regexp_replace({_strip}, '(?is)<{_t}\b[^>]*>.*?</{_t}>', '', 'g')"
_HEADS = " || ".join(rf"list_transform(regexp_extract_all(content, '(?is)<h{n}\b[^>]*>(.*?)</h{n}>', 1), lambda x: '{n}:' || {_INNER.format('x')})" for n in range(1, 7))
_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(txt, '{w}')" + (f" OR regexp_matches(lower(url), '{u}')" if u else "") + f" THEN '{n}'" for n, w, u in H.CONTENT_TYPES) + " ELSE 'article' END"
_LINKS = rf"""c AS (SELECT page_id, url AS base, depth, regexp_replace(regexp_replace(regexp_replace(content, '(?is)<script\b[^>]*>.*?</script>', '', 'g'), '(?is)<style\b[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS content FROM raw_pages),
a AS (SELECT page_id, base, depth, unnest(regexp_extract_all(content, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"''#][^"'']*)["''][^>]*>.*?</a>', 1)) AS link FROM c),
j AS (SELECT page_id, base, depth, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN regexp_extract(base, '^(.*?:)//', 1) || link WHEN starts_with(link, '/') THEN regexp_extract(base, '^(.*?://[^/]*)', 1) || link ELSE regexp_extract(base, '^(.*/)', 1) || link END AS joined FROM a),
n AS (SELECT DISTINCT page_id, base, depth, {_norm("joined")} AS target FROM j), l AS (SELECT * FROM n WHERE target <> '' AND NOT regexp_matches(lower(target), '{excluded_regex()}') AND length(target) <= 500)"""
_SITE = r"regexp_replace(lower(regexp_extract({0}, '^.*?://([^/?#]*)', 1)), '^www\.', '')"
_PRIO = f"round(least(greatest(0.1, 1.0 - depth * 0.15) * CASE WHEN d IN ({', '.join(repr(x) for x in HIGH_PRIORITY)}) OR contains(d, '.edu') OR contains(d, '.gov') THEN 1.3 ELSE 1.0 END * CASE WHEN contains(d, 'news') OR contains(d, 'wiki') THEN 1.2 ELSE 1.0 END * CASE WHEN length(url) > 200 THEN 0.8 ELSE 1.0 END, 2.0)::DOUBLE, 6)"
_DOM, _PATH = r"lower(regexp_extract(url, '^.*?://([^/?#]*)', 1))", r"lower(regexp_extract(url, '^.*?://[^/]*(/[^?#]*)', 1))"
_BY_URL = rf"CASE WHEN {_DOM} = '' THEN NULL WHEN regexp_matches({_DOM}, '^(?:en|english)\.') THEN 'en' WHEN regexp_matches({_DOM}, '^(?:{'|'.join(G.OTHER_SUBDOMAINS)})\.') THEN 'non-en' WHEN regexp_matches({_DOM}, '{'|'.join(G.ENGLISH_HOSTS)}') THEN 'en' WHEN regexp_matches({_PATH}, '/(?:en|english)/') THEN 'en' WHEN regexp_matches({_PATH}, '/(?:{'|'.join(G.OTHER_PATHS)})/') THEN 'non-en' WHEN regexp_extract({_DOM}, '([^.:]*)(?::[0-9]+)?$', 1) IN ({', '.join(repr(x) for x in G.ENGLISH_TLDS)}) THEN 'en' END"
_SHARES = ", ".join(f"len(list_filter(w, lambda x: list_contains({v.split()!r}, x))) / greatest(len(w), 1) AS s_{k}" for k, v in G.FREQUENT.items())
_BEST = "greatest(" + ", ".join(f"s_{k}" for k in G.FREQUENT) + ")"
SQL = {
    "page_language": rf"""WITH a AS (SELECT page_id, content, {_BY_URL} AS u, nullif(lower(regexp_extract(content, 'lang=["'']?([^"''\s>]{{2}})', 1)), '') AS h, regexp_extract_all(lower(regexp_replace(regexp_replace(content, '<[^>]*>', ' ', 'g'), 'https?://\S+', ' ', 'g')), '\p{{L}}+') AS w FROM raw_pages), s AS (SELECT *, {_SHARES} FROM a), b AS (SELECT *, coalesce(u = 'en', false) AS english_url, CASE WHEN coalesce({_BEST}, 0) < 0.08 THEN NULL {" ".join(f"WHEN s_{k} = {_BEST} THEN '{k}'" for k in G.FREQUENT)} END AS by_words FROM s), c AS (SELECT *, CASE WHEN trim(coalesce(content, '')) = '' THEN NULL WHEN english_url THEN 'en' ELSE coalesce(h, by_words) END AS language FROM b)
SELECT page_id, language, CASE WHEN language IS NULL THEN 0.0 WHEN english_url THEN 0.95 ELSE 0.8 END::DOUBLE AS confidence, english_url, round(len(regexp_extract_all(content, '(?i)\b(?:{'|'.join(G.TECHNICAL)})\b')) / greatest(strlen(content), 1) * 1000, 6) AS technical FROM c""",
    "page_gates": f"SELECT page_id, coalesce(strlen(content) BETWEEN 500 AND 10485760 AND (contains(content, '<html') OR contains(content, '<!DOCTYPE')) AND {_LET.format('content')} > 200, false) AS good, coalesce(regexp_matches(lower(substr(content, 1, 500)), '<html|<!doctype|<head|<body') AND {_LET.format('substr(content, 1, 5000)')} > 300, false) AS promising, coalesce(regexp_matches(lower(substr(content, 1, 1000)), '<html|<!doctype|<body'), false) AS html FROM raw_pages",
    "page_metadata": f"WITH m AS (SELECT page_id, url, content, CASE {_named('og:title')} {_named('twitter:title')} ELSE coalesce({_EL.format('title')}, {_EL.format('h1')}) END AS title, CASE {_named('og:description')} {_named('twitter:description')} {_named('description')} END AS description FROM raw_pages), h AS (SELECT *, lower(coalesce(description, '') || ' ' || coalesce(title, '')) AS txt, list_filter({_HEADS}, lambda x: length(x) > 2 AND strlen(x) - 2 < 200) AS h FROM m) SELECT page_id, title, description, CAST(strlen({_strip}) AS INTEGER) AS stripped_bytes, {_TYPE} AS content_type, CAST(coalesce(len(h), -1) AS INTEGER) AS headings, array_to_string(h, '|') AS outline FROM h",
    "page_links": f"WITH {_LINKS} SELECT page_id, target FROM l",
    "discovered_links": f"WITH {_LINKS}, g AS (SELECT target AS url, min(depth + 1) AS depth, count(*) AS inlinks, lower(regexp_extract(target, '^.*?://([^/?#]*)', 1)) AS d FROM l GROUP BY target) SELECT url, CAST(depth AS INTEGER) AS depth, inlinks, {_PRIO} AS priority FROM g WHERE url NOT IN (SELECT url FROM raw_pages)",
    "links_by_host": f"WITH {_LINKS}, p AS (SELECT page_id, {_SITE.format('url')} AS site FROM raw_pages) SELECT p.site, count(DISTINCT p.page_id) AS pages, count(target) AS links, count(*) FILTER ({_SITE.format('target')} <> p.site) AS outward FROM p LEFT JOIN l ON p.page_id = l.page_id GROUP BY p.site",
}
