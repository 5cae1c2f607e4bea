"""Queries over URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import url as U
from gleanery.session import load


def url_parts(spark, d):
    u = F.col("url")
    return load(spark, d, "raw_pages").select("page_id", U.domain(u).alias("host"), U.bare_domain(u).alias("site"), U.path(u).alias("path"), U.is_fetchable(u).alias("fetchable"), U.is_valid(u).alias("valid"), U.is_crawlable(u).alias("crawlable"))


def url_normalize(spark, d):
    """Every URL with noise added (tracking parameters, fragment, case, slashes), normalised."""
    noisy = F.concat(F.regexp_replace("url", "^http", "HTTP"), F.lit("//x/?utm_source=a&q=1&ref&b=&gclid=2#top"))
    return load(spark, d, "raw_pages").select("page_id", U.normalize(F.col("url")).alias("plain"), U.normalize(noisy).alias("noisy"))


def url_resolve(spark, d):
    pages = load(spark, d, "raw_pages").select("page_id", "url")
    links = F.array(*[F.lit(x) for x in ("http://A.example/x//y/", "//cdn.example/lib", "/root/page?ref=1&z=2", "next#frag", "")])
    return pages.select("page_id", "url", F.explode(links).alias("link")).select("page_id", "link", U.resolve(F.col("url"), F.col("link")).alias("target"))


def url_priority(spark, d):
    return load(spark, d, "raw_pages").select("page_id", F.round(U.crawl_priority(F.col("url"), F.col("depth")), 6).alias("priority"))


def url_authority(spark, d):
    """Authority and rank of a fixed set of hosts and of all pages' hosts."""
    known = spark.createDataFrame([(f"https://{h.lstrip('.')}/a",) for h in ("wikipedia.org", "www.github.com", "cs.mit.edu", "x.ac.uk", "nasa.gov", "foo.org", "bar.com", "a.b.net", "dev.to", "uni.edu.au")], "url string")
    urls = load(spark, d, "raw_pages").select("url").unionByName(known).distinct()
    u = F.col("url")
    return urls.select("url", U.authority(u).alias("authority"), U.domain_rank(u).alias("rank"), U.is_educational(u).alias("educational"))


QUERIES = {f.__name__: f for f in (url_parts, url_normalize, url_resolve, url_priority, url_authority)}


def _norm(u: str) -> str:
    full = f"(CASE WHEN contains({u}, '://') THEN {u} ELSE 'http://' || {u} END)"
    head = rf"regexp_extract({full}, '^(.*?://[^/?#]*)', 1)"
    rest = rf"regexp_replace(substr({full}, length({head}) + 1), '#.*$', '')"
    kept = rf"array_to_string(list_filter(string_split(regexp_extract({rest}, '\?(.*)$', 1), '&'), lambda p: contains(p, '=') AND NOT list_contains({U.TRACKING!r}, string_split(p, '=')[1])), '&')"
    whole = rf"(lower({head}) || regexp_replace(regexp_replace({rest}, '\?.*$', ''), '/+', '/', 'g') || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END)"
    return f"(CASE WHEN {u} IS NULL OR {u} = '' OR length({u}) > 2048 THEN '' WHEN ends_with({whole}, '/') AND length({whole}) > length({head}) + 1 THEN substr({whole}, 1, length({whole}) - 1) ELSE {whole} END)"


def _lookup(host: str, table: dict[str, float], default: float) -> str:
    exact = " ".join(f"WHEN {host} = '{k}' THEN {v}" for k, v in table.items() if k[0] != ".")
    suffix = " ".join(f"WHEN ends_with({host}, '{k}') THEN {v}" for k, v in sorted(((k, v) for k, v in table.items() if k[0] == "."), key=lambda x: (-len(x[0]), x[0])))
    return f"CAST(CASE {exact} {suffix} ELSE {default} END AS DOUBLE)"


_DOM = r"lower(regexp_extract(url, '^.*?://([^/?#]*)', 1))"
_SITE = rf"regexp_replace({_DOM}, '^www\.', '')"
_RANK = {**U.RANK_TIER_1, **U.RANK_TIER_2, **U.RANK_SUFFIXES}
SQL = {
    "url_parts": rf"SELECT page_id, {_DOM} AS host, {_SITE} AS site, CASE WHEN regexp_extract(url, '^.*?://[^/]*(/[^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^.*?://[^/]*(/[^?#]*)', 1) END AS path, coalesce(regexp_matches(url, '^https?://') AND length(url) > 10, false) AS fetchable, coalesce(length(url) <= 2048 AND regexp_matches(url, '://[^/?#]'), false) AS valid, coalesce(NOT regexp_matches(lower(url), '{U.excluded_regex()}') AND length(url) <= 500, false) AS crawlable FROM raw_pages",
    "url_normalize": f"WITH a AS (SELECT page_id, url, regexp_replace(url, '^http', 'HTTP') || '//x/?utm_source=a&q=1&ref&b=&gclid=2#top' AS noisy_url FROM raw_pages) SELECT page_id, {_norm('url')} AS plain, {_norm('noisy_url')} AS noisy FROM a",
    "url_resolve": "WITH a AS (SELECT page_id, url, unnest(['http://A.example/x//y/', '//cdn.example/lib', '/root/page?ref=1&z=2', 'next#frag', '']) AS link FROM raw_pages), j AS (SELECT page_id, link, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN regexp_extract(url, '^(.*?:)//', 1) || link WHEN starts_with(link, '/') THEN regexp_extract(url, '^(.*?://[^/]*)', 1) || link ELSE regexp_extract(url, '^(.*/)', 1) || link END AS joined FROM a) SELECT page_id, link, CASE WHEN link = '' THEN '' ELSE " + _norm("joined") + " END AS target FROM j",
    "url_priority": f"WITH a AS (SELECT page_id, url, depth, {_DOM} AS d FROM raw_pages) SELECT page_id, round(least(greatest(0.1, 1.0 - depth * 0.15) * CASE WHEN d IN ('wikipedia.org', 'github.com', 'stackoverflow.com', 'arxiv.org') OR contains(d, '.edu') OR contains(d, '.gov') THEN 1.3 ELSE 1.0 END * CASE WHEN contains(d, 'news') OR contains(d, 'wiki') THEN 1.2 ELSE 1.0 END * CASE WHEN length(url) > 200 THEN 0.8 ELSE 1.0 END, 2.0)::DOUBLE, 6) AS priority FROM a",
    "url_authority": f"WITH u AS (SELECT url FROM raw_pages UNION SELECT unnest(['https://wikipedia.org/a', 'https://www.github.com/a', 'https://cs.mit.edu/a', 'https://x.ac.uk/a', 'https://nasa.gov/a', 'https://foo.org/a', 'https://bar.com/a', 'https://a.b.net/a', 'https://dev.to/a', 'https://uni.edu.au/a'])) SELECT url, {_lookup(_DOM, U.AUTHORITY, 0.3)} AS authority, {_lookup(_SITE, _RANK, 1.0)} AS rank, {_lookup(_SITE, _RANK, -1.0)} > 0 AS educational FROM u",
}
