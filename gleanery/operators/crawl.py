"""Crawl control as DataFrame operators: recrawl back-off, politeness, error runs, robots rules, frontier order.

Histories are cut into time buckets, so that a window never holds more than one bucket of one site; buckets are combined afterwards by
short summaries. A site with a third of all requests is thus spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BACKOFF, MAX_HOURS, MIN_MINUTES = 8, 720, 15
TIMEOUT_RUN, ERROR_TOTAL = 5, 10


def recrawl_schedule(history: DataFrame, url: str, time: str, content_hash: str) -> DataFrame:
    """(url, crawls, backoff, last_crawl, last_change, next_crawl) after each URL's last crawl.

    A changed hash (null counts as a value of its own) sets the multiplier back to 1, an equal one doubles it up to 8; the wait is the hours
    since the last change (whole hours) times the multiplier, one hour to 30 days. Repeated rows of a crawl count once; ties of time go by hash.
    """
    h = history.select(F.col(url).alias("u"), F.col(time).alias("t"), F.coalesce(F.col(content_hash), F.lit("")).alias("h")).distinct()
    order = Window.partitionBy("u").orderBy("t", "h")
    h = h.withColumn("changed", F.coalesce(F.lag("h").over(order) != F.col("h"), F.lit(True)))
    h = h.withColumn("run", F.sum(F.col("changed").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = h.groupBy("u", "run").agg(F.count("*").alias("n"), F.min("t").alias("since"), F.max("t").alias("last"))
    last = runs.groupBy("u").agg(F.max(F.struct("run", "n", "since", "last")).alias("r"), F.sum("n").alias("crawls")).select("u", "crawls", "r.*")
    backoff = F.least(F.lit(MAX_BACKOFF), F.pow(F.lit(2), F.least("n", F.lit(10)) - 1).cast("int"))
    hours = F.floor((F.col("last").cast("double") - F.col("since").cast("double")) / 3600)
    minutes = F.greatest(F.lit(MIN_MINUTES), F.least(F.lit(MAX_HOURS), F.greatest(F.lit(1), hours * backoff)) * 60)
    return last.select(F.col("u").alias(url), "crawls", backoff.alias("backoff"), F.col("last").alias("last_crawl"), F.col("since").alias("last_change"), F.timestamp_seconds(F.col("last").cast("double") + minutes * 60).alias("next_crawl"))


def failure_backoff_minutes(failures: Column) -> Column:
    """2, 4, 8, 16, 32 minutes; 0 without failures."""
    return F.when(failures > 0, 2 * F.pow(F.lit(2), F.least(failures, F.lit(5)) - 1)).otherwise(0).cast("int")


def feed_interval_minutes(interval: Column, failures: Column) -> Column:
    return F.when(failures > 0, F.least(F.lit(60), interval * F.pow(F.lit(2), F.least(failures, F.lit(5))))).otherwise(interval).cast("int")


def sitemap_interval_hours(interval: Column, failures: Column) -> Column:
    return F.when(failures > 0, F.least(F.lit(72), interval * F.pow(F.lit(2), F.least(failures, F.lit(3))))).otherwise(interval).cast("int")


def feed_interval_of_priority(priority: Column) -> Column:
    return F.when(priority >= 9, 5).when(priority <= 6, 30).otherwise(10)


def sitemap_interval_of_priority(priority: Column) -> Column:
    return F.when(priority >= 0.8, 12).when(priority >= 0.5, 24).otherwise(48)


def changefreq_priority(freq: Column) -> Column:
    table = {"always": 1.0, "hourly": 0.9, "daily": 0.8, "weekly": 0.6, "monthly": 0.4, "yearly": 0.2, "never": 0.1}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.lower(freq)], F.lit(0.5))


def recrawl_priority(due: Column, as_of: Column) -> Column:
    """1 plus the hours overdue; before that 1 less the days until due, 0.1 at least (whole minutes)."""
    minutes = F.floor((as_of.cast("double") - due.cast("double")) / 60)
    return F.when(minutes >= 0, 1 + minutes / 60).otherwise(F.greatest(F.lit(0.1), 1 - F.floor((due.cast("double") - as_of.cast("double")) / 60) / 1440))


def rate_band(per_second: Column) -> Column:
    return F.when(per_second >= 300, "target").when(per_second >= 200, "high").when(per_second >= 100, "good").when(per_second >= 50, "moderate").when(per_second >= 10, "low").otherwise("very low")


def time_since_previous(log: DataFrame, group: str, time: str, bucket: str = "hour") -> DataFrame:
    """log with `gap_ms`, the time since the group's previous request (null for its first).

    A lag within each bucket; only the first row of a bucket looks up the last request of the group's previous bucket.
    """
    b = log.withColumn("__b", F.date_trunc(bucket, time))
    within = F.lag(time).over(Window.partitionBy(group, "__b").orderBy(time))
    last = b.groupBy(group, "__b").agg(F.max(time).alias("__last"))
    before = last.select(F.col(group).alias("__g"), F.col("__b").alias("__bb"), F.lag("__last").over(Window.partitionBy(group).orderBy("__b")).alias("__before"))
    joined = b.withColumn("__lag", within).join(before, b[group].eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__bb")), "left")
    previous = F.coalesce("__lag", "__before")
    return joined.withColumn("gap_ms", (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(previous.cast("timestamp"))) / 1000).drop("__b", "__lag", "__g", "__bb", "__before")


def longest_runs(log: DataFrame, group: str, order: list[str], hit: Column, skip: Column, day: Column) -> DataFrame:
    """(group, longest): the longest run of consecutive hits in each group; rows with skip don't break or lengthen a run.

    Runs are summarised per day (length, prefix, suffix, longest) and the days are folded in order, so no window spans a group.
    """
    rows = log.where(~skip).select(F.col(group).alias("g"), day.alias("d"), hit.alias("hit"), *order)
    w = Window.partitionBy("g", "d").orderBy(*order)
    rows = rows.withColumn("i", F.row_number().over(w)).withColumn("island", F.sum((~F.col("hit")).cast("int")).over(w))
    n = rows.groupBy("g", "d").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("int")).alias("hits"), F.max("island").alias("last_island"))
    islands = rows.where("hit").groupBy("g", "d", "island").agg(F.count("*").alias("len"))
    joined = islands.alias("x").join(n.alias("y"), F.col("x.g").eqNullSafe(F.col("y.g")) & (F.col("x.d") == F.col("y.d")), "right")
    days = joined.groupBy("y.g", "y.d", "y.n").agg(F.coalesce(F.max("len"), F.lit(0)).alias("best"), F.coalesce(F.max(F.when(F.col("island") == 0, F.col("len"))), F.lit(0)).alias("head"), F.coalesce(F.max(F.when(F.col("island") == F.col("last_island"), F.col("len"))), F.lit(0)).alias("tail"))
    ordered = days.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("d", "n", "best", "head", "tail"))).alias("days"))  # one entry a day

    def step(acc: Column, x: Column) -> Column:
        joined_run = acc["tail"] + x["head"]
        return F.struct(F.greatest(acc["best"], x["best"], joined_run).alias("best"), F.when(x["head"] == x["n"], joined_run).otherwise(x["tail"]).alias("tail"))

    zero = F.struct(F.lit(0).cast("bigint").alias("best"), F.lit(0).cast("bigint").alias("tail"))
    return ordered.select(F.col("g").alias(group), F.aggregate("days", zero, step, lambda a: a["best"]).alias("longest"))


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(domain, allow, rule, length) of the groups for agent and for all; the last of consecutive user-agent lines names the group.

    robots: domain, content. Comments, blank and foreign lines are skipped, carriage returns trimmed. An ordered fold, no UDF.
    """
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: F.trim(F.regexp_replace(x, r"#.*$|\r", ""))), lambda x: x != "")
    zero = F.struct(F.lit(False).alias("on"), F.array().cast("array<struct<allow:boolean,rule:string>>").alias("rules"))

    def step(acc: Column, x: Column) -> Column:
        low = F.lower(x)
        value = F.trim(F.regexp_replace(x, r"^[^:]*:", ""))
        rule = F.struct(low.startswith("allow:").alias("allow"), value.alias("rule"))
        keep = acc["on"] & (low.startswith("allow:") | low.startswith("disallow:")) & (value != "")
        return F.struct(F.when(low.startswith("user-agent:"), value.isin("*", agent)).otherwise(acc["on"]).alias("on"), F.when(keep, F.concat(acc["rules"], F.array(rule))).otherwise(acc["rules"]).alias("rules"))

    return robots.select("domain", F.explode(F.aggregate(lines, zero, step, lambda a: a["rules"])).alias("r")).select("domain", "r.allow", "r.rule", F.length("r.rule").alias("length"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(domain, sitemap, priority): sitemap lines with a priority by their name."""
    found = robots.select("domain", F.explode(F.regexp_extract_all("content", F.lit(r"(?im)^[ \t]*sitemap:[ \t]*([^\s#]+)"), 1)).alias("sitemap"))
    s = F.col("sitemap")
    return found.select("domain", "sitemap", F.when(s.contains("index"), 0.9).when(s.contains("news"), 0.8).when(s.contains("image") | s.contains("video"), 0.6).otherwise(0.5).alias("priority"))


def robots_decision(urls: DataFrame, rules: DataFrame, domain: str, path: str) -> DataFrame:
    """urls with `verdict`: allowed, disallowed, or deferred where the domain's rules are unknown. The longest matching rule wins, Disallow on ties.

    The join is on the domain; prefixes are tested within it (a domain has few rules).
    """
    known = rules.select(F.col("domain").alias("__d")).distinct().withColumn("__known", F.lit(True))
    per = rules.groupBy("domain").agg(F.collect_set(F.struct("allow", "rule", "length")).alias("__rules")).withColumnRenamed("domain", "__d")
    joined = urls.join(per.join(known, "__d"), urls[domain] == F.col("__d"), "left")
    longest = lambda allow: F.coalesce(F.array_max(F.transform(F.filter("__rules", lambda r: (r["allow"] == allow) & F.col(path).startswith(r["rule"])), lambda r: r["length"])), F.lit(0))
    verdict = F.when(F.col("__known").isNull(), "deferred").when(longest(False) == 0, "allowed").when(longest(True) > longest(False), "allowed").otherwise("disallowed")
    return joined.withColumn("verdict", verdict).drop("__d", "__rules", "__known")


def frontier_order(due: str, priority: str, depth: str, as_of: Column) -> list[Column]:
    """Ready URLs first, then earlier due, higher priority (to two digits) and smaller depth."""
    return [(F.col(due) <= as_of).desc(), F.col(due).asc(), F.round(priority, 2).desc(), F.col(depth).asc()]
