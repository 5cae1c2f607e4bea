"""Readers of crawl files, configuration, feeds, sitemaps and headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.url import is_fetchable
from gleanery.operators.crawl import changefreq_priority, feed_interval_of_priority
from gleanery.sources import schemas


def read_pages(spark: SparkSession, path: str, recursive: bool = True, modified_after: str | None = None) -> DataFrame:
    """Raw pages of *.jsonl files (bad and blank lines give rows with `_corrupt_record`) and *.json arrays (a bad file fails the read).

    path is a directory or one file. `source_file` and `modified_at` come from the file's metadata. Rows aren't checked here: see valid_pages.
    """

    def read(pattern: str, array: bool) -> DataFrame:
        r = spark.read.schema(schemas.RAW_PAGE + ", _corrupt_record string").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).option("mode", "FAILFAST" if array else "PERMISSIVE")
        if array:
            r = spark.read.schema(schemas.RAW_PAGE).option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).option("mode", "FAILFAST").option("multiLine", True)
        if modified_after:
            r = r.option("modifiedAfter", modified_after)
        df = r.json(path).select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("modified_at"))
        return df if "_corrupt_record" in df.columns else df.withColumn("_corrupt_record", F.lit(None).cast("string"))

    if path.endswith(".json"):
        df = read("*.json", True)
    elif path.endswith(".jsonl"):
        df = read("*.jsonl", False)
    else:
        df = read("*.jsonl", False).unionByName(read("*.json", True))
    return df


def row_problem(url: Column, content: Column, corrupt: Column) -> Column:
    """Why a raw row is not taken: not_json, missing_url, bad_url, empty_content; null for a good one."""
    return F.when(corrupt.isNotNull(), "not_json").when(F.coalesce(url, F.lit("")) == "", "missing_url").when(~is_fetchable(url), "bad_url").when(F.trim(F.coalesce(content, F.lit(""))) == "", "empty_content")


def valid_pages(pages: DataFrame) -> DataFrame:
    """The good rows; a null or empty domain is taken from the url."""
    good = pages.where(row_problem(F.col("url"), F.col("content"), F.col("_corrupt_record")).isNull())
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^.*?://([^/?#]*)", 1)), r"^www\.", "")
    return good.withColumn("domain", F.when(F.trim(F.coalesce("domain", F.lit(""))) == "", host).otherwise(F.col("domain"))).drop("_corrupt_record")


def read_statistics(pages: DataFrame) -> DataFrame:
    """One row: rows, good rows, rows by problem, files."""
    p = row_problem(F.col("url"), F.col("content"), F.col("_corrupt_record"))
    return pages.agg(F.count("*").alias("rows"), F.count_if(p.isNull()).alias("good"), *[F.count_if(p == x).alias(x) for x in ("not_json", "missing_url", "bad_url", "empty_content")], F.countDistinct("source_file").alias("files"))


def new_files(found: DataFrame, done: DataFrame) -> DataFrame:
    """Files of found (path) that are not in done (path)."""
    return found.join(done.select("path").distinct(), "path", "left_anti")


def read_string_array(spark: SparkSession, path: str) -> DataFrame:
    """(value): the strings of a JSON array file, in order of the file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "array<string>")).alias("value"))


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """(url, priority, interval_minutes) of a feed list: *.json (defaults: priority 5; the interval follows the priority) or text lines `url [minutes]`, # comments."""
    if path.endswith(".json"):
        f = spark.read.schema(schemas.FEED).option("multiLine", True).json(path).where("url IS NOT NULL")
        return f.select("url", F.coalesce("priority", F.lit(5)).alias("priority")).withColumn("interval_minutes", feed_interval_of_priority(F.col("priority")))
    parts = F.split(F.trim(F.regexp_replace("value", "#.*$", "")), r"\s+")
    lines = spark.read.text(path).select(parts.alias("p")).where(F.col("p")[0] != "")
    return lines.select(F.col("p")[0].alias("url"), F.lit(5).alias("priority"), F.coalesce(F.try_element_at("p", F.lit(2)).try_cast("int"), F.lit(10)).alias("interval_minutes"))


def read_domain_config(spark: SparkSession, path: str) -> DataFrame:
    """(domain, interval_hours, use_freshness, multiplier, language_whitelist, enabled, priority_multiplier) of a JSON object by domain; intervals like 30m, 12h, 2d."""
    text = spark.read.text(path, wholetext=True)
    each = text.select(F.explode(F.from_json("value", f"map<string,{schemas.DOMAIN_CONFIG}>")).alias("domain", "c"))
    number, unit = F.regexp_extract("c.crawl_frequency.interval", r"^\s*(\d+)", 1).cast("double"), F.lower(F.regexp_extract("c.crawl_frequency.interval", r"([A-Za-z])\s*$", 1))
    hours = F.coalesce(number * F.when(unit == "m", 1 / 60).when(unit == "d", 24.0).otherwise(1.0), F.lit(24.0))
    return each.select("domain", hours.alias("interval_hours"), F.coalesce("c.crawl_frequency.use_freshness_based", F.lit(False)).alias("use_freshness"), F.coalesce("c.crawl_frequency.multiplier", F.lit(1.0)).alias("multiplier"), F.coalesce("c.language_whitelist", F.array().cast("array<string>")).alias("language_whitelist"), F.coalesce("c.enabled", F.lit(True)).alias("enabled"), F.coalesce("c.priority_multiplier", F.lit(1.0)).alias("priority_multiplier"))


def strip_comments(text: Column) -> Column:
    """JSON text without // and /* */ comments; a // behind a colon (in an address) stays."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"(?m)(?<!:)//.*$", "")


def _texts(xml: Column, path: str) -> Column:
    return F.xpath(xml, F.lit(path))


def parse_rss(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """feeds with one row for each item: link, title, description, published (string). Items without a link are left out."""
    item = "struct<link:string,title:string,description:string,pubDate:string>"
    items = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)(<item\b.*?</item>)"), 1)
    each = feeds.select(*[c for c in feeds.columns if c != xml], F.explode(items).alias("__i"))
    parsed = each.withColumn("__x", F.from_xml("__i", item, {"mode": "PERMISSIVE"}))
    return parsed.select(*[c for c in feeds.columns if c != xml], F.trim("__x.link").alias("link"), F.trim("__x.title").alias("title"), F.trim("__x.description").alias("description"), F.trim("__x.pubDate").alias("published")).where("link <> ''")


def parse_atom(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """As parse_rss, of Atom entries: the alternate link (else the first), summary else content, updated else published."""
    entries = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)(<entry\b.*?</entry>)"), 1)
    each = feeds.select(*[c for c in feeds.columns if c != xml], F.explode(entries).alias("__e"))
    e = F.col("__e")
    tag = lambda name: F.nullif(F.trim(F.regexp_extract(e, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1)), F.lit(""))
    alternate = F.coalesce(F.nullif(F.regexp_extract(e, r"""(?is)<link\b[^>]*rel=["']alternate["'][^>]*href=["']([^"']+)""", 1), F.lit("")), F.nullif(F.regexp_extract(e, r"""(?is)<link\b[^>]*href=["']([^"']+)["'][^>]*rel=["']alternate["']""", 1), F.lit("")), F.nullif(F.regexp_extract(e, r"""(?is)<link\b[^>]*href=["']([^"']+)""", 1), F.lit("")))
    out = each.select(*[c for c in feeds.columns if c != xml], alternate.alias("link"), tag("title").alias("title"), F.coalesce(tag("summary"), tag("content")).alias("description"), F.coalesce(tag("updated"), tag("published")).alias("published"))
    return out.where("link IS NOT NULL")


def parse_sitemap_index(files: DataFrame, xml: str = "xml") -> DataFrame:
    """(…, sitemap): the sitemaps an index lists; other files give none."""
    locs = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<sitemap\b[^>]*>.*?<loc>\s*(.*?)\s*</loc>.*?</sitemap>"), 1)
    return files.select(*[c for c in files.columns if c != xml], F.explode(locs).alias("sitemap"))


def parse_sitemap(files: DataFrame, xml: str = "xml") -> DataFrame:
    """(…, url, last_modified, change_frequency, priority) of a urlset; the priority is clamped to 0 and 1, else follows the frequency."""
    urls = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)(<url\b[^>]*>.*?</url>)"), 1)
    each = files.select(*[c for c in files.columns if c != xml], F.explode(urls).alias("__u"))
    tag = lambda name: F.nullif(F.trim(F.regexp_extract("__u", rf"(?is)<{name}>(.*?)</{name}>", 1)), F.lit(""))
    stated = F.greatest(F.lit(0.0), F.least(F.lit(1.0), tag("priority").try_cast("double")))
    out = each.select(*[c for c in files.columns if c != xml], tag("loc").alias("url"), tag("lastmod").alias("last_modified"), F.lower(tag("changefreq")).alias("change_frequency"), F.when(tag("priority").try_cast("double").isNotNull(), stated).otherwise(changefreq_priority(tag("changefreq"))).alias("priority"))
    return out.where("url IS NOT NULL")


def parse_headers(text: Column) -> Column:
    """map of lower-case header names to values of a raw header block; the last of repeated headers counts."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(r"^[^:\s]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)
