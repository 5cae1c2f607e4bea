"""Crawl control over raw_pages, request_log and domain_config."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions.sites import site_of
from gleanery.operators import crawl as C
from gleanery.session import load

AS_OF = "2024-07-01 00:00:00"
ROBOTS = [
    ("flecal.example", "User-agent: *\nDisallow: /wiki\nAllow: /wiki/a\n# note\nSitemap: https://flecal.example/sitemap_index.xml\n"),
    ("forum.zangru.test", "User-agent: other\nDisallow: /\nUser-agent: *\r\nDisallow: /thread # all\nDisallow:\nsitemap: https://forum.zangru.test/news.xml\n"),
    ("forum.treelcor.test", "User-agent: *\nDisallow: /\nAllow: /p/\n"),
]


def _log(spark, d):
    return load(spark, d, "request_log").distinct().withColumn("site", F.regexp_replace(F.lower(F.trim("domain")), r"^www\.", ""))


def _pages(spark, d):
    return load(spark, d, "raw_pages").withColumn("t", F.to_timestamp("crawl_time"))


def recrawl_schedule(spark, d):
    s = C.recrawl_schedule(_pages(spark, d).where("t IS NOT NULL"), "url", "t", "content_hash")
    return s.select("url", "crawls", "backoff", F.unix_timestamp("next_crawl").alias("next_crawl"))


def frontier(spark, d):
    """The 100 URLs to crawl next as of a fixed moment."""
    as_of = F.to_timestamp(F.lit(AS_OF))
    p = _pages(spark, d).groupBy("url").agg(F.max(F.to_timestamp("expected_next_crawl")).alias("due"), F.min("depth").alias("depth")).where("due IS NOT NULL")
    p = p.withColumn("priority", F.round(C.recrawl_priority(F.col("due"), as_of), 6))
    return p.orderBy(*C.frontier_order("due", "priority", "depth", as_of), "url").limit(100).select("url", F.unix_timestamp("due").alias("due"), "priority", "depth")


def ready_counts(spark, d):
    as_of = F.to_timestamp(F.lit(AS_OF))
    return _pages(spark, d).select(F.to_timestamp("expected_next_crawl").alias("due")).agg(F.count("due").alias("scheduled"), F.count_if(F.col("due") <= as_of).alias("ready"))


def request_gaps(spark, d):
    """Requests that came within 50 ms of their site's previous one, by site."""
    g = C.time_since_previous(_log(spark, d).where("site IS NOT NULL"), "site", "req_time")
    return g.groupBy("site").agg(F.count("*").alias("requests"), F.count_if(F.col("gap_ms") <= 50).alias("too_fast"), F.min("gap_ms").alias("least_gap"))


def blacklist(spark, d):
    """Sites with five timeouts in a row or ten errors in all."""
    log = _log(spark, d).where("site IS NOT NULL")
    bad = F.coalesce(F.col("outcome").isin("timeout", "error"), F.lit(False))
    runs = C.longest_runs(log, "site", ["req_time", "req_id"], F.col("outcome") == "timeout", F.col("outcome").isNull(), F.to_date("req_time"))
    errors = log.groupBy("site").agg(F.count_if(bad).alias("errors"))
    return errors.join(runs, "site", "left").select("site", "errors", F.coalesce("longest", F.lit(0)).alias("timeouts_in_a_row")).where((F.col("errors") >= C.ERROR_TOTAL) | (F.col("timeouts_in_a_row") >= C.TIMEOUT_RUN))


def error_counts(spark, d):
    return _log(spark, d).groupBy("site", "outcome", "http_status_code").agg(F.count("*").alias("n"))


def crawl_rates(spark, d):
    per = _log(spark, d).groupBy(F.date_trunc("hour", "req_time").alias("h")).agg(F.count("*").alias("n"), F.sum("body_bytes").alias("bytes"))
    return per.select(F.unix_timestamp(F.col("h").cast("timestamp")).alias("hour"), "n", F.round(F.col("n") / 3600, 6).alias("per_second"), F.col("bytes"), C.rate_band(F.col("n") / 3600).alias("band"))


def enriched_pages(spark, d):
    """Pages joined with their site's configuration (left join, defaults where there is none)."""
    cfg = load(spark, d, "domain_config").select(F.regexp_replace(F.lower(F.trim("domain")), r"^www\.", "").alias("site"), "crawl_frequency_limit", "enabled", "priority_multiplier").groupBy("site").agg(F.max("crawl_frequency_limit").alias("hours"), F.max("enabled").alias("enabled"), F.max("priority_multiplier").alias("factor"))
    p = _pages(spark, d).select("page_id", site_of(F.col("url")).alias("site"), "t")
    return p.join(cfg, "site", "left").select("page_id", "site", F.coalesce("enabled", F.lit(True)).alias("enabled"), F.when(F.isnan("factor"), None).otherwise(F.col("factor")).alias("factor"), F.unix_timestamp(F.timestamp_seconds(F.col("t").cast("double") + F.coalesce("hours", F.lit(24)) * 3600)).alias("next_crawl"))


def robots_verdicts(spark, d):
    robots = spark.createDataFrame(ROBOTS, "domain string, content string")
    urls = _pages(spark, d).select("page_id", site_of(F.col("url")).alias("site"), F.regexp_extract("url", r"^.*?://[^/]*(/[^?#]*)", 1).alias("path"))
    return C.robots_decision(urls, C.robots_rules(robots), "site", "path").select("page_id", "verdict")


def robots_sitemaps(spark, d):
    return C.robots_sitemaps(spark.createDataFrame(ROBOTS, "domain string, content string"))


def backoff_tables(spark, d):
    """Waiting times by failures for URLs, feeds and sitemaps."""
    f = F.col("id").cast("int")
    return spark.range(0, 8).select(f.alias("failures"), C.failure_backoff_minutes(f).alias("url_minutes"), C.feed_interval_minutes(F.lit(10), f).alias("feed_minutes"), C.sitemap_interval_hours(F.lit(24), f).alias("sitemap_hours"))


QUERIES = {f.__name__: f for f in (recrawl_schedule, frontier, ready_counts, request_gaps, blacklist, error_counts, crawl_rates, enriched_pages, robots_verdicts, robots_sitemaps, backoff_tables)}

_S = r"regexp_replace(lower(trim(domain)), '^www\.', '')"
_L = f"r AS (SELECT *, {_S} AS site FROM (SELECT DISTINCT * FROM request_log))"
_EP = "CAST(floor(epoch({0})) AS BIGINT)"
_T = "CAST(crawl_time AS TIMESTAMPTZ)"
_U = r"regexp_replace(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#\s]+)', 1)), '^www\.', '')"
SQL = {
    "recrawl_schedule": f"WITH h AS (SELECT DISTINCT url, epoch(try_cast(crawl_time AS TIMESTAMP)) AS t, coalesce(content_hash, '') AS h FROM raw_pages WHERE try_cast(crawl_time AS TIMESTAMP) IS NOT NULL), c AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY url ORDER BY t, h) <> h, true) AS ch FROM h), r AS (SELECT *, sum(CAST(ch AS INTEGER)) OVER (PARTITION BY url ORDER BY t, h ROWS UNBOUNDED PRECEDING) AS run FROM c), g AS (SELECT url, run, count(*) AS n, min(t) AS s, max(t) AS e FROM r GROUP BY url, run), l AS (SELECT *, sum(n) OVER (PARTITION BY url) AS crawls, row_number() OVER (PARTITION BY url ORDER BY run DESC) AS k FROM g), b AS (SELECT *, CAST(least(8, pow(2, least(n, 10) - 1)) AS INTEGER) AS backoff FROM l WHERE k = 1) SELECT url, CAST(crawls AS BIGINT) AS crawls, backoff, CAST(e + greatest(15, least(720, greatest(1, floor((e - s) / 3600) * backoff)) * 60) * 60 AS BIGINT) AS next_crawl FROM b",
    "frontier": f"WITH p AS (SELECT url, max(epoch(try_cast(expected_next_crawl AS TIMESTAMP))) AS due, min(depth) AS depth FROM raw_pages GROUP BY url), q AS (SELECT *, floor((epoch(TIMESTAMP '{AS_OF}') - due) / 60) AS m FROM p WHERE due IS NOT NULL), s AS (SELECT *, round(CASE WHEN m >= 0 THEN 1 + m / 60 ELSE greatest(0.1, 1 - floor((due - epoch(TIMESTAMP '{AS_OF}')) / 60) / 1440) END::DOUBLE, 6) AS priority FROM q) SELECT url, CAST(due AS BIGINT) AS due, priority, depth FROM s ORDER BY due <= epoch(TIMESTAMP '{AS_OF}') DESC, due, round(priority, 2) DESC, depth, url LIMIT 100",
    "ready_counts": f"WITH p AS (SELECT try_cast(expected_next_crawl AS TIMESTAMP) AS due FROM raw_pages) SELECT count(due) AS scheduled, count(*) FILTER (due <= TIMESTAMP '{AS_OF}') AS ready FROM p",
    "request_gaps": f"WITH {_L}, g AS (SELECT site, (epoch_us(req_time) - epoch_us(lag(req_time) OVER (PARTITION BY site ORDER BY req_time))) / 1000 AS gap FROM r WHERE site IS NOT NULL) SELECT site, count(*) AS requests, count(*) FILTER (gap <= 50) AS too_fast, min(gap) AS least_gap FROM g GROUP BY site",
    "blacklist": f"WITH {_L}, o AS (SELECT site, req_time, req_id, outcome FROM r WHERE site IS NOT NULL AND outcome IS NOT NULL), i AS (SELECT site, outcome, sum(CASE WHEN outcome <> 'timeout' THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY req_time, req_id ROWS UNBOUNDED PRECEDING) AS island FROM o), m AS (SELECT site, island, count(*) AS n FROM i WHERE outcome = 'timeout' GROUP BY ALL), x AS (SELECT site, max(n) AS longest FROM m GROUP BY site), e AS (SELECT site, count(*) FILTER (outcome IN ('timeout', 'error')) AS errors FROM r WHERE site IS NOT NULL GROUP BY site) SELECT e.site, errors, coalesce(longest, 0) AS timeouts_in_a_row FROM e LEFT JOIN x ON e.site = x.site WHERE errors >= 10 OR coalesce(longest, 0) >= 5",
    "error_counts": f"WITH {_L} SELECT site, outcome, http_status_code, count(*) AS n FROM r GROUP BY ALL",
    "crawl_rates": f"WITH {_L}, p AS (SELECT date_trunc('hour', req_time) AS h, count(*) AS n, sum(body_bytes) AS bytes FROM r GROUP BY h) SELECT {_EP.format('h')} AS hour, n, round(n / 3600, 6) AS per_second, CAST(bytes AS BIGINT) AS bytes, CASE WHEN n / 3600 >= 300 THEN 'target' WHEN n / 3600 >= 200 THEN 'high' WHEN n / 3600 >= 100 THEN 'good' WHEN n / 3600 >= 50 THEN 'moderate' WHEN n / 3600 >= 10 THEN 'low' ELSE 'very low' END AS band FROM p",
    "enriched_pages": f"WITH c AS (SELECT {_S} AS site, max(crawl_frequency_limit) AS hours, max(enabled) AS enabled, max(priority_multiplier) AS factor FROM domain_config GROUP BY 1), p AS (SELECT page_id, {_U} AS site, epoch(try_cast(crawl_time AS TIMESTAMP)) AS t FROM raw_pages) SELECT page_id, p.site, coalesce(enabled, true) AS enabled, CASE WHEN isnan(factor) THEN NULL ELSE factor END AS factor, CAST(t + coalesce(hours, 24) * 3600 AS BIGINT) AS next_crawl FROM p LEFT JOIN c ON p.site = c.site",
    "backoff_tables": "WITH f AS (SELECT CAST(range AS INTEGER) AS failures FROM range(0, 8)) SELECT failures, CAST(CASE WHEN failures > 0 THEN 2 * pow(2, least(failures, 5) - 1) ELSE 0 END AS INTEGER) AS url_minutes, CAST(CASE WHEN failures > 0 THEN least(60, 10 * pow(2, least(failures, 5))) ELSE 10 END AS INTEGER) AS feed_minutes, CAST(CASE WHEN failures > 0 THEN least(72, 24 * pow(2, least(failures, 3))) ELSE 24 END AS INTEGER) AS sitemap_hours FROM f",
    "robots_verdicts": f"WITH rules(domain, allow, rule) AS (VALUES ('flecal.example', false, '/wiki'), ('flecal.example', true, '/wiki/a'), ('forum.zangru.test', false, '/thread'), ('forum.treelcor.test', false, '/'), ('forum.treelcor.test', true, '/p/')), u AS (SELECT page_id, {_U} AS site, regexp_extract(url, '^.*?://[^/]*(/[^?#]*)', 1) AS path FROM raw_pages), m AS (SELECT page_id, max(length(rule)) FILTER (NOT allow AND starts_with(path, rule)) AS dis, max(length(rule)) FILTER (allow AND starts_with(path, rule)) AS al, count(domain) AS known FROM u LEFT JOIN rules ON u.site = rules.domain GROUP BY page_id) SELECT page_id, CASE WHEN known = 0 THEN 'deferred' WHEN dis IS NULL THEN 'allowed' WHEN coalesce(al, 0) > dis THEN 'allowed' ELSE 'disallowed' END AS verdict FROM m",
    "robots_sitemaps": "SELECT * FROM (VALUES ('flecal.example', 'https://flecal.example/sitemap_index.xml', 0.9::DOUBLE), ('forum.zangru.test', 'https://forum.zangru.test/news.xml', 0.8::DOUBLE)) t(domain, sitemap, priority)",
}
