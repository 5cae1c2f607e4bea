"""Chunk filters and headings, document and date reports, admission, boosts and batch search, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions.url import bare_domain, crawl_priority, domain_rank
from gleanery.operators import search as S
from gleanery.operators.ranking import distributed_row_number
from gleanery.session import cut, discard, load

AS_OF, COOLDOWN_S, RECENT_DAYS, FEED_HOURS, SITEMAP_HOURS = "2025-06-01 00:00:00", 60, 365, 48, 168
MAX_DEPTH, QUEUE_SIZE = 3, 20_000
MIN_LENGTH, MAX_LENGTH, MIN_QUALITY, MIN_CHUNK_BYTES = 100, 1_000_000, 0.3, 25

# Marks of encoded text, style sheets, wiki pages and JSON in a chunk; words of interfaces; phrases of links.
CHUNK_MARKS = [
    "\\u003c", "\\u003e", "\\u0026", "&nbsp;", "&amp;", "&lt;", "&gt;",
    ".mw-parser-output", "navbox", "display:inline", "margin:0", "padding:0", "font-weight:bold", "background-color:", "border:", "content:", "::after", "::before", ".hlist", "box-sizing:", "line-height:",
    "text-align:", "white-space:", "border-color:", "border-left:", "border-top:", "float:", "max-width:", "@media", "counter-reset:", "counter-increment:",
    "vtePart of", "vteReligions", "Retrieved from", "Hidden categories:", "Articles with", "Pages with", "Webarchive template", "Commons category",
    '"type":', '"href":', '"title":', '"class":', '"id":', '"style":',
]
INTERFACE_WORDS = [
    "diffhist", "talk contribs", "mobile edit", "visual edit", "android app", "ios app", "hidden tag", "wikiedu", "dashboard", "assignment wizard", "wikiloop", "battlefield", "user creation", "account", "antivandal",
    "rollback", "manual revert", "tag filter", "namespace", "template", "category", "portal", "module", "invert selection", "recent changes", "options", "hide", "show", "edit filter", "cleanup", "vandalism",
    "deletion", "backlogs", "village pump", "mailing lists", "signpost",
]
LINK_PHRASES = ["click here", "read more", "learn more", "view all", "home page", "contact us", "about us", "privacy policy"]
# Words of a query, what a text must hold then, and its boost.
BOOSTS = [
    (["what", "define", "definition", "meaning", "explain"], r"\b(?:what\s+is|definition|meaning|explain|introduction|overview)\b", 1.5),
    (["tutorial", "guide", "how", "learn", "course"], r"\b(?:tutorial|guide|how\s+to|learn|course|lesson)\b", 1.4),
    (["reference", "documentation", "docs", "api"], r"\b(?:reference|documentation|docs|manual|api)\b", 1.3),
    (["example", "sample", "demo", "code"], r"\b(?:example|sample|demo|code|implementation)\b", 1.2),
]
BOOST_QUERY, MAX_BOOST = "explain the guide with an example", 3.0


def _words(c):
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def _uses(low, phrases, weigh=lambda p: 1):
    """How often the phrases occur in a text, without overlaps, each counted with its weight."""
    total = F.lit(0)
    for p in phrases:
        total = total + (F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / len(p) * weigh(p)
    return total


def is_noise(text):
    """Whether a chunk is remains of markup, of an interface or of navigation (nine groups of rules)."""
    low, n = F.lower(text), F.size(_words(text))
    marked = F.lit(False)
    for m in CHUNK_MARKS:
        marked = marked | text.contains(m)
    style = F.length(F.regexp_replace(text, "[^:;]", ""))
    capitals = F.regexp_count(text, F.lit(r"(?s)(?=[\p{Lu}\P{L}]{3})"))
    links = _uses(low, LINK_PHRASES, lambda p: p.count(" ") + 1)
    return (
        marked
        | ((n > 0) & (_uses(low, INTERFACE_WORDS) / F.greatest(n, F.lit(1)) > 0.2))
        | ((style > 20) & (F.octet_length(text) > 500) & (style / F.octet_length(text) > 0.01))
        | (F.length(F.regexp_replace(text, r"[^\[\]]", "")) > 10)
        | (capitals > F.floor(n / 4))
        | ((n > 0) & (links / F.greatest(n, F.lit(1)) > 0.3))
    )


def _chunks(spark, d):
    return load(spark, d, "doc_chunks").select("chunk_id", "document_id", "text_chunk", "relevant_headings").distinct()


def chunk_noise(spark, d):
    """For each chunk whether it is noise, and whether it is long enough to be kept."""
    return _chunks(spark, d).where("text_chunk IS NOT NULL").select("chunk_id", is_noise(F.col("text_chunk")).alias("noise"), (F.octet_length("text_chunk") >= MIN_CHUNK_BYTES).alias("long_enough"))


def _documents(spark, d):
    """One row for each document: of different rows the one with the smallest url, then title."""
    one = F.min(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(f"o_{c}") for c in ("url", "title", "description")], "title", "description", "url", "author_name", "published_date", "canonical_url", "main_content", "keywords", "word_count", "content_quality_score", "is_technical_content"))
    return load(spark, d, "processed_docs").groupBy("document_id").agg(one.alias("x")).select("document_id", "x.*")


def chunk_headings(spark, d):
    """Each chunk with at most three headings of its document that share a word with its first twenty longer words, in order."""
    own = F.array_distinct(F.flatten(F.sort_array(F.collect_list("relevant_headings"))))
    headings = load(spark, d, "doc_chunks").select("document_id", "relevant_headings").where("relevant_headings IS NOT NULL").distinct().groupBy("document_id").agg(own.alias("headings"))
    words = F.slice(F.filter(_words(F.lower("text_chunk")), lambda w: F.octet_length(w) > 3), 1, 20)
    shared = F.slice(F.filter("headings", lambda h: F.arrays_overlap(_words(F.lower(h)), F.col("words"))), 1, 3)
    rows = _chunks(spark, d).where("text_chunk IS NOT NULL").select("chunk_id", "document_id", words.alias("words")).join(headings, "document_id")
    return rows.select("chunk_id", F.array_join(shared, "|").alias("headings"))


def extractor_score(spark, d):
    """Score up to 5 of a document: its words, and how many headings its chunks name."""
    headings = load(spark, d, "doc_chunks").select("document_id", F.explode("relevant_headings").alias("h")).groupBy("document_id").agg(F.countDistinct("h").alias("headings"))
    docs = _documents(spark, d).join(headings, "document_id", "left").select("document_id", F.size(_words(F.coalesce("main_content", F.lit("")))).alias("words"), F.coalesce("headings", F.lit(0)).alias("headings"))
    score = F.when(F.col("words") > 100, F.least(F.col("words") / 1000, F.lit(3.0))).otherwise(0.0) + F.when(F.col("headings") > 0, 1.0).otherwise(0.0) + F.when(F.col("headings") > 2, 0.5).otherwise(0.0)
    return docs.select("document_id", "words", "headings", F.round(F.least(score, F.lit(5.0)), 6).alias("score"))


def date_range(spark, d):
    """Earliest and latest publication day, days between, dated documents, and whether any is recent. Other formats than ISO don't count."""
    day = F.try_to_date(F.regexp_extract("published_date", r"^(\d{4}-\d{2}-\d{2})(?:T.*)?$", 1), "yyyy-MM-dd")
    days = _documents(spark, d).select(day.alias("day")).where("day IS NOT NULL")
    recent = F.max((F.datediff(F.lit(AS_OF).cast("date"), F.col("day")) <= RECENT_DAYS).cast("int")) == 1
    return days.agg(F.date_format(F.min("day"), "yyyy-MM-dd").alias("earliest"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("latest"), F.datediff(F.max("day"), F.min("day")).alias("span_days"), F.count("*").alias("dated"), F.coalesce(recent, F.lit(False)).alias("recent"))


def document_reports(spark, d):
    """Completeness, richness and technical quality of each document, the weighted score, its issues and strengths."""
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    shown = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    images = load(spark, d, "site_docs").groupBy("document_id").agg(F.max(F.coalesce(F.col("primary_image.src") != "", F.lit(False)).cast("int")).alias("images"))
    docs = _documents(spark, d).join(images, "document_id", "left").withColumn("images", F.coalesce(F.col("images") == 1, F.lit(False)))
    keys, chars = F.coalesce(F.size("keywords"), F.lit(0)), F.length(F.coalesce("main_content", F.lit("")))
    has_keys = F.coalesce(F.size("keywords") > 0, F.lit(False))
    complete = sum((filled(c).cast("int") for c in ("title", "description", "author_name", "published_date", "canonical_url")), F.lit(0)) / 5 * 100
    rich = (shown("main_content").cast("int") + has_keys.cast("int") + F.col("images").cast("int")) / 5 * 100
    good = F.coalesce((F.col("content_quality_score") > 5) & ~F.isnan("content_quality_score"), F.lit(False))
    technical = 20.0 * (F.coalesce(F.col("word_count") > 100, F.lit(False)).cast("int") + good.cast("int") + (keys >= 5).cast("int"))
    say = lambda *pairs: F.array_join(F.array_compact(F.array(*[F.when(c, t) for c, t in pairs])), "; ")
    issues = say((~shown("title"), "Missing or empty title"), (~shown("description"), "Missing description"), (~has_keys, "No keywords extracted"), (~filled("author_name"), "Missing author information"), (~filled("published_date"), "Missing publication date"), (chars < 100, "Very short content (< 100 characters)"), (~F.col("images"), "No images found"))
    strengths = say((chars > 1000, "Rich content (> 1000 characters)"), (keys >= 10, "Comprehensive keywords"), (F.coalesce("is_technical_content", F.lit(False)), "Technical content detected"))
    return docs.select("document_id", complete.alias("completeness"), rich.alias("richness"), technical.alias("technical"), F.round(complete * 0.3 + rich * 0.4 + technical * 0.3, 6).alias("score"), issues.alias("issues"), strengths.alias("strengths"))


def length_window(spark, d):
    """Documents whose text length and quality lie within the accepted window."""
    ok = F.length("main_content").between(MIN_LENGTH, MAX_LENGTH) & (F.col("content_quality_score") >= MIN_QUALITY) & ~F.isnan("content_quality_score")
    return load(spark, d, "processed_docs").where(ok).select("document_id").distinct()


def frontier_admission(spark, d):
    """URLs admitted to the queue, in order of arrival: not too deep, each once, up to the queue's size."""
    seen = load(spark, d, "raw_pages").where(F.col("depth") <= MAX_DEPTH).groupBy("url").agg(F.min("page_id").alias("page_id"))
    return distributed_row_number(seen, [], [F.col("page_id")], "place").where(F.col("place") <= QUEUE_SIZE).select("url", "place")


def base_order(spark, d):
    """URLs in queue order: priority in steps of 0.01, then depth, then url."""
    pages = load(spark, d, "raw_pages").groupBy("url").agg(F.min("depth").alias("depth"))
    keyed = pages.select("url", "depth", F.floor(F.round(crawl_priority(F.col("url"), F.col("depth")), 6) * 100 + 1e-6).alias("step"))
    return distributed_row_number(keyed, [], [F.desc("step"), F.col("depth"), F.col("url")], "place").select("url", "place")


def recent_entries(spark, d):
    """Pages that arrived recently enough for feeds and for sitemaps, counted back from the last arrival."""
    pages = load(spark, d, "raw_pages").select("page_id", "received_at").distinct()
    end = pages.agg(F.max("received_at").alias("end"))
    age = lambda h: F.coalesce(F.col("received_at") >= F.col("end") - F.expr(f"INTERVAL {h} HOURS"), F.lit(False))
    return pages.crossJoin(F.broadcast(end)).select("page_id", age(FEED_HOURS).alias("in_feed"), age(SITEMAP_HOURS).alias("in_sitemap"))  # one row


def cooling_domains(spark, d):
    """For each domain whether an error within the cooldown before the end of the log keeps it from being asked."""
    log = load(spark, d, "request_log").where("domain IS NOT NULL")
    last = log.groupBy("domain").agg(F.max(F.when(F.col("outcome").isin("error", "timeout"), F.col("req_time"))).alias("failed"))
    end = log.agg(F.max("req_time").alias("end"))
    blocked = F.coalesce(F.unix_micros("end") - F.unix_micros("failed") < COOLDOWN_S * 1_000_000, F.lit(False))
    return last.crossJoin(F.broadcast(end)).select("domain", blocked.alias("blocked"))  # one row


def content_boost(spark, d):
    """Boost of each document for BOOST_QUERY by the kind of its content, and the total with its domain's rank, capped."""
    docs = _documents(spark, d)
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring(F.coalesce("main_content", F.lit("")), 1, 500)))  # the rule looks at the beginning only
    boost = F.lit(1.0)
    for words, pattern, factor in BOOSTS:
        if any(w in BOOST_QUERY for w in words):
            boost = boost * F.when(text.rlike(pattern), factor).otherwise(1.0)
    return docs.select("document_id", F.round(boost, 6).alias("boost"), F.round(F.least(domain_rank(F.col("url")) * boost, F.lit(MAX_BOOST)), 6).alias("total"))


def duplicate_totals(spark, d):
    """Exact and near duplicates, both, and what is left without the exact ones."""
    from gleanery.plans.insights import exact_duplicates, near_duplicate_titles

    count = lambda df, name: df.agg(F.count("*").alias(name))
    one = count(exact_duplicates(spark, d), "exact").crossJoin(count(near_duplicate_titles(spark, d), "near")).crossJoin(load(spark, d, "site_docs").agg(F.countDistinct("document_id").alias("documents")))  # one row each
    return one.select("exact", "near", (F.col("exact") + F.col("near")).alias("total"), (F.col("documents") - F.col("exact")).alias("unique"))


def rerank_distribution(spark, d):
    """How the scores of all reranked documents are distributed."""
    from gleanery.plans.insights import rerank_all

    s = F.col("score")
    return rerank_all(spark, d).agg(F.count_if(s >= 0.8).alias("high"), F.count_if((s >= 0.5) & (s < 0.8)).alias("medium"), F.count_if(s < 0.5).alias("low"), F.round(F.avg("score"), 3).alias("average"))


def batch_search(spark, d):
    """The ten best documents for each of many queries (the titles of documents whose id is divisible by 20), over stored postings."""
    docs = load(spark, d, "documents").select("doc_id", "text", "source")
    queries = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(S.tokens(F.col("text")), 1, 3), " ").alias("query"))
    stored = cut(S.document_postings(docs, "doc_id", "text"), "postings")
    found = S.search_postings(stored, docs, "doc_id", queries, 10).select("query_id", "doc_id", "score", "place")
    discard(stored)
    return found


QUERIES = {
    f.__name__: f
    for f in (chunk_noise, chunk_headings, extractor_score, date_range, document_reports, length_window, frontier_admission, base_order, recent_entries, cooling_domains, content_boost, duplicate_totals, rerank_distribution, batch_search)
}

_q = lambda x: "'" + x.replace("'", "''") + "'"
_W = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"
_USES = lambda low, phrases, weigh=lambda p: 1: " + ".join(f"(length({low}) - length(replace({low}, {_q(p)}, ''))) / {len(p)} * {weigh(p)}" for p in phrases)
_C = "c AS (SELECT DISTINCT chunk_id, document_id, text_chunk, relevant_headings FROM doc_chunks WHERE text_chunk IS NOT NULL)"
_D = """d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(url, ''), coalesce(title, ''), coalesce(description, ''), title, description, url, author_name, published_date, canonical_url, main_content) AS rn FROM processed_docs) WHERE rn = 1)"""
SQL = {
    "chunk_noise": f"""WITH {_C}, t AS (SELECT chunk_id, text_chunk AS t, lower(text_chunk) AS low, len({_W.format('text_chunk')}) AS n, length(regexp_replace(text_chunk, '[^:;]', '', 'g')) AS style FROM c)
SELECT chunk_id, ({' OR '.join(f'contains(t, {_q(m)})' for m in CHUNK_MARKS)}) OR (n > 0 AND ({_USES('low', INTERFACE_WORDS)}) / greatest(n, 1) > 0.2) OR (style > 20 AND strlen(t) > 500 AND style / strlen(t) > 0.01) OR length(regexp_replace(t, '[^\\[\\]]', '', 'g')) > 10
OR len(list_filter(range(1, length(t) - 1), lambda i: regexp_full_match(substr(t, i, 3), '(?s)[\\p{{Lu}}\\P{{L}}]{{3}}'))) > n // 4 OR (n > 0 AND ({_USES('low', LINK_PHRASES, lambda p: p.count(' ') + 1)}) / greatest(n, 1) > 0.3) AS noise, strlen(t) >= {MIN_CHUNK_BYTES} AS long_enough FROM t""",
    "chunk_headings": f"""WITH {_C}, h AS (SELECT DISTINCT document_id, relevant_headings FROM doc_chunks WHERE relevant_headings IS NOT NULL), g AS (SELECT document_id, flatten(list_sort(list(relevant_headings))) AS hs FROM h GROUP BY document_id),
e AS (SELECT document_id, list_filter(hs, lambda x, i: list_position(hs, x) = i) AS hs FROM g), w AS (SELECT chunk_id, document_id, list_filter({_W.format('lower(text_chunk)')}, lambda x: strlen(x) > 3)[1:20] AS words FROM c)
SELECT chunk_id, array_to_string(list_filter(hs, lambda x: list_has_any({_W.format('lower(x)')}, words))[1:3], '|') AS headings FROM w JOIN e ON w.document_id = e.document_id""",
    "extractor_score": f"""WITH {_D}, h AS (SELECT document_id, count(DISTINCT h) AS headings FROM (SELECT document_id, unnest(relevant_headings) AS h FROM doc_chunks) GROUP BY document_id),
x AS (SELECT d.document_id, len({_W.format("coalesce(main_content, '')")}) AS words, coalesce(headings, 0) AS headings FROM d LEFT JOIN h ON d.document_id = h.document_id)
SELECT document_id, CAST(words AS INTEGER) AS words, headings, round(least(CASE WHEN words > 100 THEN least(words / 1000, 3.0::DOUBLE) ELSE 0 END + CASE WHEN headings > 0 THEN 1.0 ELSE 0.0 END + CASE WHEN headings > 2 THEN 0.5 ELSE 0.0 END, 5.0)::DOUBLE, 6) AS score FROM x""",
    "date_range": f"""WITH {_D}, y AS (SELECT try_cast(nullif(regexp_extract(published_date, '^(\\d{{4}}-\\d{{2}}-\\d{{2}})(?:T.*)?$', 1), '') AS DATE) AS day FROM d)
SELECT strftime(min(day), '%Y-%m-%d') AS earliest, strftime(max(day), '%Y-%m-%d') AS latest, CAST(date_diff('day', min(day), max(day)) AS INTEGER) AS span_days, count(*) AS dated, coalesce(bool_or(date_diff('day', day, DATE '2025-06-01') <= {RECENT_DAYS}), false) AS recent FROM y WHERE day IS NOT NULL""",
    "document_reports": f"""WITH {_D}, i AS (SELECT document_id, bool_or(coalesce(primary_image.src <> '', false)) AS images FROM site_docs GROUP BY document_id),
x AS (SELECT d.*, coalesce(i.images, false) AS images, coalesce(len(keywords), 0) AS keys, length(coalesce(main_content, '')) AS chars FROM d LEFT JOIN i ON d.document_id = i.document_id),
y AS (SELECT *, (coalesce(title <> '', false)::INT + coalesce(description <> '', false)::INT + coalesce(author_name <> '', false)::INT + coalesce(published_date <> '', false)::INT + coalesce(canonical_url <> '', false)::INT) / 5 * 100 AS completeness,
(coalesce(trim(main_content) <> '', false)::INT + (keys > 0)::INT + images::INT) / 5 * 100 AS richness, 20.0::DOUBLE * (coalesce(word_count > 100, false)::INT + coalesce(content_quality_score > 5 AND NOT isnan(content_quality_score), false)::INT + (keys >= 5)::INT) AS technical FROM x)
SELECT document_id, completeness, richness, technical, round(completeness * 0.3 + richness * 0.4 + technical * 0.3, 6) AS score,
concat_ws('; ', CASE WHEN NOT coalesce(trim(title) <> '', false) THEN 'Missing or empty title' END, CASE WHEN NOT coalesce(trim(description) <> '', false) THEN 'Missing description' END, CASE WHEN keys = 0 THEN 'No keywords extracted' END, CASE WHEN NOT coalesce(author_name <> '', false) THEN 'Missing author information' END,
CASE WHEN NOT coalesce(published_date <> '', false) THEN 'Missing publication date' END, CASE WHEN chars < 100 THEN 'Very short content (< 100 characters)' END, CASE WHEN NOT images THEN 'No images found' END) AS issues,
concat_ws('; ', CASE WHEN chars > 1000 THEN 'Rich content (> 1000 characters)' END, CASE WHEN keys >= 10 THEN 'Comprehensive keywords' END, CASE WHEN coalesce(is_technical_content, false) THEN 'Technical content detected' END) AS strengths FROM y""",
    "length_window": f"SELECT DISTINCT document_id FROM processed_docs WHERE length(main_content) BETWEEN {MIN_LENGTH} AND {MAX_LENGTH} AND content_quality_score >= {MIN_QUALITY} AND NOT isnan(content_quality_score)",
    "frontier_admission": f"WITH s AS (SELECT url, min(page_id) AS page_id FROM raw_pages WHERE depth <= {MAX_DEPTH} GROUP BY url), r AS (SELECT url, row_number() OVER (ORDER BY page_id) AS place FROM s) SELECT url, place FROM r WHERE place <= {QUEUE_SIZE}",
    "recent_entries": f"WITH p AS (SELECT DISTINCT page_id, received_at FROM raw_pages), e AS (SELECT max(received_at) AS last FROM p) SELECT page_id, coalesce(received_at >= last - INTERVAL {FEED_HOURS} HOUR, false) AS in_feed, coalesce(received_at >= last - INTERVAL {SITEMAP_HOURS} HOUR, false) AS in_sitemap FROM p, e",
    "cooling_domains": f"WITH l AS (SELECT * FROM request_log WHERE domain IS NOT NULL), f AS (SELECT domain, max(req_time) FILTER (outcome IN ('error', 'timeout')) AS failed FROM l GROUP BY domain), e AS (SELECT max(req_time) AS last FROM l) SELECT domain, coalesce(epoch_us(last) - epoch_us(failed) < {COOLDOWN_S} * 1000000, false) AS blocked FROM f, e",
}

from gleanery.functions.url import RANK_SUFFIXES, RANK_TIER_1, RANK_TIER_2  # noqa: E402
from gleanery.plans import insights  # noqa: E402
from gleanery.plans.pages import _PRIO, _SITE  # noqa: E402

_ranks = {**RANK_TIER_1, **RANK_TIER_2}
_RANK = "CASE site " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in _ranks.items()) + " ELSE CASE " + " ".join(f"WHEN ends_with(site, {_q(k)}) THEN {v}" for k, v in sorted(RANK_SUFFIXES.items(), key=lambda x: (-len(x[0]), x[0]))) + " ELSE 1.0 END END"
_BOOST = " * ".join(f"CASE WHEN regexp_matches(txt, {_q(p)}) THEN {f} ELSE 1.0 END" for w, p, f in BOOSTS if any(x in BOOST_QUERY for x in w))
SQL |= {
    "base_order": f"WITH p AS (SELECT url, min(depth) AS depth FROM raw_pages GROUP BY url), k AS (SELECT url, depth, lower(regexp_extract(url, '^.*?://([^/?#]*)', 1)) AS d FROM p), s AS (SELECT url, depth, floor({_PRIO} * 100 + 1e-6) AS step FROM k) SELECT url, row_number() OVER (ORDER BY step DESC, depth, url) AS place FROM s",
    "content_boost": f"WITH {_D}, t AS (SELECT document_id, lower(coalesce(title, '') || ' ' || substr(coalesce(main_content, ''), 1, 500)) AS txt, {_SITE.format('url')} AS site FROM d), b AS (SELECT *, ({_BOOST})::DOUBLE AS boost FROM t) SELECT document_id, round(boost, 6) AS boost, round(least(({_RANK})::DOUBLE * boost, {MAX_BOOST}), 6) AS total FROM b",
    "duplicate_totals": f"WITH x AS (SELECT count(*) AS exact FROM ({insights.SQL['exact_duplicates']})), n AS (SELECT count(*) AS near FROM ({insights.SQL['near_duplicate_titles']})), d AS (SELECT count(DISTINCT document_id) AS documents FROM site_docs) SELECT exact, near, exact + near AS total, documents - exact AS \"unique\" FROM x, n, d",
    "batch_search": """WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), []) AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
e AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM t), p AS (SELECT term, doc_id, count(*) AS tf, max(length) AS length FROM e GROUP BY term, doc_id), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT doc_id AS query_id, unnest(w[1:3]) AS term FROM t WHERE doc_id % 20 = 0),
r AS (SELECT query_id, p.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score FROM q JOIN p ON q.term = p.term JOIN f ON q.term = f.term, s GROUP BY query_id, p.doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM r) SELECT query_id, doc_id, score, CAST(place AS INTEGER) AS place FROM o WHERE place <= 10""",
}
