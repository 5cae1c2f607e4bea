"""Result insights, duplicates and reranking over site_docs as one large result list."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.functions import quality as Q
from gleanery.functions.sites import site_of
from gleanery.functions.text import signature
from gleanery.operators.ranking import distributed_row_number
from gleanery.operators.similarity import similar_sets
from gleanery.session import load

TYPES = {
    "tutorial": r"tutorial|guide|how\s+to|step\s+by\s+step|walkthrough|getting\s+started|introduction\s+to", "documentation": r"documentation|docs|api\s+reference|manual|specification|official\s+guide|reference", "blog_post": "blog|article|post|published|author|opinion|thoughts|experience",
    "forum_discussion": r"forum|discussion|thread|question|answer|community|stack\s+overflow", "code_example": "example|sample|demo|snippet|code|implementation|source", "news": "news|announcement|release|update|breaking|latest|today", "academic": "paper|research|study|journal|academic|university|publication",
}
YEAR = 2025
QUERY = "inside the registry"


def _results(spark, d):
    r = load(spark, d, "site_docs").dropDuplicates(["document_id"])
    return r.select("document_id", "title", "description", site_of(F.col("url")).alias("site"), "content_type", "categories", "author_name", "published_date", "semantic_info", F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))).alias("both"))


def search_insights(spark, d):
    q = F.col("semantic_info.content_quality_score")
    return _results(spark, d).agg(F.count("*").alias("results"), F.countDistinct("site").alias("domains"), F.count("author_name").alias("with_author"), F.round(F.avg(F.when(~F.isnan(q) & (q != 0), q)), 2).alias("mean_quality"), F.countDistinct("content_type").alias("types"))


def top_domains(spark, d):
    return _results(spark, d).groupBy("site").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "site").limit(10).select("site", "n", F.coalesce(F.create_map(*[F.lit(x) for kv in Q.HOST_AUTHORITY.items() for x in kv])[F.col("site")], F.lit(0.5)).alias("authority"))


def diversity(spark, d):
    r = _results(spark, d)
    cats = r.select(F.explode("categories").alias("c")).agg(F.countDistinct("c").alias("categories"))
    return r.agg(F.countDistinct("site").alias("domains"), F.countDistinct("content_type").alias("types"), F.count("*").alias("n")).crossJoin(F.broadcast(cats)).select(F.round(F.least(F.lit(1.0), (F.col("domains") + F.col("types") + F.col("categories")) / F.greatest("n", F.lit(1))), 6).alias("score"))  # one row each


def content_types(spark, d):
    hits = F.array_compact(F.array(*[F.when(F.col("both").rlike(p), k) for k, p in TYPES.items()]))
    return _results(spark, d).select(F.explode(F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("general")))).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


def freshness(spark, d):
    years = F.transform(F.regexp_extract_all("both", F.lit(r"20\d{2}"), 0), lambda y: y.cast("int"))
    last = F.array_max(years)
    bucket = F.when(last >= YEAR - 1, "very_recent").when(last >= YEAR - 3, "recent").when(last >= YEAR - 5, "older").when(last.isNotNull(), "outdated").when(F.col("both").rlike("latest|new|updated|current|2025"), "very_recent").otherwise("recent")
    return _results(spark, d).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def topic_clusters(spark, d):
    words = _results(spark, d).select(F.explode(F.regexp_extract_all("both", F.lit("[a-z]{4,}"), 0)).alias("topic"))
    return words.groupBy("topic").agg(F.count("*").alias("frequency")).where("frequency >= 2").orderBy(F.desc("frequency"), "topic").limit(5)


def authority_signals(spark, d):
    any_ = lambda *w: Q.any_of(F.col("both"), list(w)) | Q.any_of(F.coalesce("site", F.lit("")), list(w))
    return _results(spark, d).agg(F.count_if(any_("official", "documentation", "docs", "api reference")).alias("official_docs"), F.count_if(Q.any_of(F.col("both"), ["expert", "maintainer", "core team", "lead developer"])).alias("expert_content"), F.count_if(Q.any_of(F.coalesce("site", F.lit("")), ["stackoverflow", "github", "reddit"])).alias("community"), F.count_if(any_("research", "academic", "university", "paper", "journal")).alias("academic"))


def exact_duplicates(spark, d):
    """Every document and the first one (smallest id) with the same title and description."""
    r = _results(spark, d).select("document_id", signature(F.col("title"), F.col("description")).alias("s"))
    first = r.groupBy("s").agg(F.min("document_id").alias("first_id"), F.count("*").alias("copies"))
    return r.join(first, "s").where("document_id <> first_id").select("document_id", "first_id", "copies")


def near_duplicate_titles(spark, d):
    """Pairs of different titles (as word sets) with a Jaccard similarity of 0.8 or more; copies are one class, by their smallest title."""
    titles = _results(spark, d).where(F.trim("title") != "").select(F.lower(F.trim("title")).alias("t"), F.array_sort(F.array_distinct(F.split(F.lower(F.trim("title")), r"\s+"))).alias("words"))
    classes = titles.groupBy("words").agg(F.min("t").alias("t"))
    return similar_sets(classes, "t", "words", 0.8).select(F.col("a").alias("title_a"), F.col("b").alias("title_b"), F.round("similarity", 6).alias("similarity"))


def rerank(spark, d):
    """The first 50 documents by id reranked: 0.4 quality, 0.5 relevance, 0.1 position."""
    top = _results(spark, d).orderBy("document_id").limit(50).withColumn("position", F.row_number().over(Window.orderBy("document_id")) - 1)
    scored = top.withColumn("score", _rerank_score())
    return scored.select("document_id", "position", "score", (F.row_number().over(Window.orderBy(F.desc("score"), "position")) - 1).alias("new_position"))


def rerank_all(spark, d):
    """All documents, in the order of their ids, reranked as in rerank."""
    placed = distributed_row_number(_results(spark, d), [], [F.col("document_id")], "position").withColumn("position", F.col("position") - 1)
    scored = placed.select("document_id", "position", _rerank_score().alias("score"))
    return distributed_row_number(scored, [], [F.desc("score"), F.col("position")], "new_position").withColumn("new_position", F.col("new_position") - 1)


def _rerank_score():
    s = F.round(Q.result_quality(F.col("description"), F.col("title"), F.col("site")), 3) * 0.4 + Q.relevance(QUERY, F.col("description"), F.col("title")) * 0.5 + F.greatest(F.lit(0.0), 1 - F.col("position") * 0.1) * 0.1
    return F.round(s, 6)


QUERIES = {f.__name__: f for f in (search_insights, top_domains, diversity, content_types, freshness, topic_clusters, authority_signals, exact_duplicates, near_duplicate_titles, rerank, rerank_all)}

_R = r"r AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#\s]+)', 1)), '^www\.', '') AS site, lower(coalesce(title, '') || ' ' || coalesce(description, '')) AS both_ FROM (SELECT *, row_number() OVER (PARTITION BY document_id) AS rn FROM site_docs) WHERE rn = 1)"


def _any(t, words):
    return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"


def _cnt(t, words):
    return "(" + " + ".join(f"CAST(contains({t}, '{w}') AS INTEGER)" for w in words) + ")"


_WD = r"len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> ''))"
SQL = {
    "search_insights": f"WITH {_R} SELECT count(*) AS results, count(DISTINCT site) AS domains, count(author_name) AS with_author, round(avg(semantic_info.content_quality_score) FILTER (NOT isnan(semantic_info.content_quality_score) AND semantic_info.content_quality_score <> 0), 2) AS mean_quality, count(DISTINCT content_type) AS types FROM r",
    "top_domains": f"WITH {_R} SELECT site, count(*) AS n, CAST(CASE site {' '.join(f'WHEN {k!r} THEN {v}' for k, v in Q.HOST_AUTHORITY.items())} ELSE 0.5 END AS DOUBLE) AS authority FROM r GROUP BY site ORDER BY n DESC, site LIMIT 10",
    "diversity": f"WITH {_R} SELECT round(least(1.0, (count(DISTINCT site) + count(DISTINCT content_type) + (SELECT count(DISTINCT c) FROM (SELECT unnest(categories) AS c FROM r))) / greatest(count(*), 1))::DOUBLE, 6) AS score FROM r",
    "content_types": f"WITH {_R}, h AS (SELECT list_filter([" + ", ".join(f"CASE WHEN regexp_matches(both_, '{p}') THEN '{k}' END" for k, p in TYPES.items()) + "], lambda x: x IS NOT NULL) AS h FROM r), e AS (SELECT unnest(CASE WHEN len(h) > 0 THEN h ELSE ['general'] END) AS type FROM h) SELECT type, count(*) AS n FROM e GROUP BY type",
    "freshness": rf"WITH {_R}, y AS (SELECT both_, list_max(list_transform(regexp_extract_all(both_, '20\d{{2}}'), lambda y: CAST(y AS INTEGER))) AS last FROM r) SELECT CASE WHEN last >= 2024 THEN 'very_recent' WHEN last >= 2022 THEN 'recent' WHEN last >= 2020 THEN 'older' WHEN last IS NOT NULL THEN 'outdated' WHEN regexp_matches(both_, 'latest|new|updated|current|2025') THEN 'very_recent' ELSE 'recent' END AS bucket, count(*) AS n FROM y GROUP BY bucket",
    "topic_clusters": f"WITH {_R}, w AS (SELECT unnest(regexp_extract_all(both_, '[a-z]{{4,}}')) AS topic FROM r) SELECT topic, count(*) AS frequency FROM w GROUP BY topic HAVING count(*) >= 2 ORDER BY frequency DESC, topic LIMIT 5",
    "authority_signals": f"WITH {_R} SELECT count(*) FILTER ({_any('both_', ['official', 'documentation', 'docs', 'api reference'])} OR {_any('site', ['official', 'documentation', 'docs', 'api reference'])}) AS official_docs, count(*) FILTER ({_any('both_', ['expert', 'maintainer', 'core team', 'lead developer'])}) AS expert_content, count(*) FILTER ({_any('site', ['stackoverflow', 'github', 'reddit'])}) AS community, count(*) FILTER ({_any('both_', ['research', 'academic', 'university', 'paper', 'journal'])} OR {_any('site', ['research', 'academic', 'university', 'paper', 'journal'])}) AS academic FROM r",
    "exact_duplicates": rf"WITH {_R}, s AS (SELECT document_id, md5(regexp_replace(trim(lower(coalesce(title, '') || ' ' || coalesce(description, ''))), '\s+', ' ', 'g')) AS s FROM r), f AS (SELECT s, min(document_id) AS first_id, count(*) AS copies FROM s GROUP BY s) SELECT document_id, first_id, copies FROM s JOIN f USING (s) WHERE document_id <> first_id",
    "near_duplicate_titles": rf"WITH {_R}, t AS (SELECT lower(trim(title)) AS t, list_sort(list_distinct(regexp_split_to_array(lower(trim(title)), '\s+'))) AS w FROM r WHERE trim(title) <> ''), c AS (SELECT w, min(t) AS t FROM t GROUP BY w), p AS (SELECT a.t AS title_a, b.t AS title_b, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS na, len(b.w) AS nb FROM c a JOIN c b ON a.t < b.t) SELECT title_a, title_b, round(i / (na + nb - i), 6) AS similarity FROM p WHERE i / (na + nb - i) >= 0.8",
    "rerank": f"WITH {_R}, t AS (SELECT *, row_number() OVER (ORDER BY document_id) - 1 AS position, coalesce(description, '') AS t FROM r QUALIFY position < 50), g AS (SELECT *, {_WD} AS w, {_WD} / len(regexp_split_to_array(t, '[.!?]+')) AS per, CAST(CASE site {' '.join(f'WHEN {k!r} THEN {v}' for k, v in Q.HOST_BOOST.items())} ELSE 0 END AS DOUBLE) AS boost FROM t), h AS (SELECT *, round(least(least({_cnt('both_', Q.DEPTH)} / 5.0, 1.0) * 0.25 + least(least({_cnt('both_', Q.AUTHORITY)} / 3.0, 1.0) + boost, 1.0) * 0.2 + least({_cnt('both_', Q.FRESHNESS)} / 3.0, 1.0) * 0.15 + least({_cnt('both_', Q.ENGAGEMENT)} / 2.0, 1.0) * 0.1 + (CASE WHEN t = '' THEN 0.0 WHEN per BETWEEN 10 AND 20 THEN 1.0 WHEN per BETWEEN 5 AND 30 THEN 0.7 ELSE 0.4 END) * 0.15 + (CASE WHEN t = '' THEN 0.0 WHEN w >= 200 THEN 1.0 WHEN w >= 100 THEN 0.8 WHEN w >= 50 THEN 0.6 ELSE 0.3 END) * 0.15 + boost, 1.0)::DOUBLE, 3) AS q FROM g), s AS (SELECT document_id, position, round((q * 0.4 + {_cnt('both_', QUERY.split())} / 3 * 0.5 + greatest(0, 1 - position * 0.1) * 0.1)::DOUBLE, 6) AS score FROM h) SELECT document_id, CAST(position AS INTEGER) AS position, score, CAST(row_number() OVER (ORDER BY score DESC, position) - 1 AS INTEGER) AS new_position FROM s",
}
