"""Queries over quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import quality as Q
from gleanery.functions.url import bare_domain
from gleanery.session import load


def _docs(spark, d):
    return load(spark, d, "processed_docs").dropDuplicates(["proc_id"])


def document_quality(spark, d):
    c = F.col
    score = Q.content_quality(c("main_content"), c("title"), c("description"), c("author_name"), c("published_date"), c("word_count"), F.size("content_categories"))
    return _docs(spark, d).select("proc_id", F.round(score, 5).alias("score"), Q.fast_quality(c("main_content"), c("title"), F.size("keywords")).alias("fast_score"))


def result_quality(spark, d):
    s = Q.result_quality(F.col("main_content"), F.col("title"), bare_domain(F.col("url")))
    return _docs(spark, d).select("proc_id", F.round(s, 3).alias("score"), Q.quality_tier(F.round(s, 6)).alias("tier"), F.round(Q.relevance("the festival report", F.col("main_content"), F.col("title")), 6).alias("relevance"))


def quality_distribution(spark, d):
    s = F.round(Q.result_quality(F.col("main_content"), F.col("title"), bare_domain(F.col("url"))), 3)
    return _docs(spark, d).select(s.alias("s")).agg(F.round(F.avg("s"), 3).alias("average"), F.max("s").alias("highest"), F.min("s").alias("lowest"), F.count_if(F.col("s") >= 0.8).alias("high"), F.count_if(F.col("s").between(0.5, 0.7999999)).alias("medium"), F.count_if(F.col("s") < 0.5).alias("low"))


def chunk_quality(spark, d):
    t = F.col("text_chunk")
    return load(spark, d, "doc_chunks").select("chunk_id", "text_chunk", "relevant_headings").distinct().select("chunk_id", Q.meaningful(t).alias("meaningful"), F.round(Q.chunk_score(t, F.size("relevant_headings")), 4).alias("score"))


def text_metrics(spark, d):
    t = F.col("main_content")
    words = F.size(F.filter(Q.words_of(t), lambda w: F.octet_length(w) > 2))
    return _docs(spark, d).where("main_content IS NOT NULL").select(
        "proc_id", words.alias("words"), F.regexp_count(t, F.lit(r"\.")).alias("sentences"), F.greatest(F.regexp_count(t, F.lit("\n")), F.lit(1)).alias("paragraphs"), F.round(F.greatest(words / 200, F.lit(1.0)), 6).alias("minutes"), F.round(words / F.greatest(F.octet_length(t), F.lit(1)), 6).alias("density")
    )


def corpus_report(spark, d):
    """Bands, completeness and mean length of the corpus in one pass."""
    q = Q.fast_quality(F.col("main_content"), F.col("title"), F.size("keywords"))
    r = _docs(spark, d).withColumn("q", q)
    has = lambda c: F.count_if(F.col(c).isNotNull() & (F.trim(c) != ""))
    return r.agg(
        F.count("*").alias("documents"), F.count_if(F.col("q") >= 90).alias("excellent"), F.count_if((F.col("q") >= 70) & (F.col("q") < 90)).alias("good"), F.count_if((F.col("q") >= 50) & (F.col("q") < 70)).alias("fair"), F.count_if(F.col("q") < 50).alias("poor"),
        has("title").alias("with_title"), has("description").alias("with_description"), has("author_name").alias("with_author"), has("published_date").alias("with_date"), F.count_if(F.size("keywords") > 0).alias("with_keywords"), F.round(F.avg("word_count"), 4).alias("mean_words"), F.round(F.avg("q"), 4).alias("mean_score"),
    )


QUERIES = {f.__name__: f for f in (document_quality, result_quality, quality_distribution, chunk_quality, text_metrics, corpus_report)}


def _any(t, words):
    return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"


def _count(t, words):
    return "(" + " + ".join(f"CAST(contains({t}, '{w}') AS INTEGER)" for w in words) + ")"


_D = "d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY proc_id) AS rn FROM processed_docs) WHERE rn = 1)"
_W = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''))"
_FAST = f"""((CASE WHEN length(trim(coalesce(main_content, ''))) > 1000 THEN 40.0 WHEN length(trim(coalesce(main_content, ''))) > 500 THEN 30.0 WHEN length(trim(coalesce(main_content, ''))) > 100 THEN 20.0 WHEN length(trim(coalesce(main_content, ''))) > 20 THEN 10.0 ELSE 0.0 END
 + CASE WHEN length(trim(coalesce(title, ''))) BETWEEN 20 AND 100 THEN 30.0 WHEN length(trim(coalesce(title, ''))) BETWEEN 10 AND 150 THEN 20.0 WHEN length(trim(coalesce(title, ''))) > 0 THEN 10.0 ELSE 0.0 END
 + CASE WHEN coalesce(len(keywords), -1) >= 5 THEN 20.0 WHEN coalesce(len(keywords), -1) >= 3 THEN 15.0 WHEN coalesce(len(keywords), -1) >= 1 THEN 10.0 ELSE 0.0 END
 + CASE WHEN {_W.format("coalesce(main_content, '')")} > 50 THEN 10.0 WHEN {_W.format("coalesce(main_content, '')")} > 10 THEN 5.0 ELSE 0.0 END)::DOUBLE)"""
_HOST = r"regexp_replace(lower(regexp_extract(url, '^.*?://([^/?#]*)', 1)), '^www\.', '')"
_RES = f"""e AS (SELECT *, coalesce(main_content, '') AS t, lower(coalesce(title, '') || ' ' || coalesce(main_content, '')) AS b, CAST(CASE {_HOST} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in Q.HOST_BOOST.items())} ELSE 0 END AS DOUBLE) AS boost FROM d),
g AS (SELECT *, {_W.format("t")} AS w, {_W.format("t")} / len(regexp_split_to_array(t, '[.!?]+')) AS per FROM e),
h AS (SELECT *, least(least({_count('b', Q.DEPTH)} / 5.0, 1.0) * 0.25 + least(least({_count('b', Q.AUTHORITY)} / 3.0, 1.0) + boost, 1.0) * 0.2 + least({_count('b', Q.FRESHNESS)} / 3.0, 1.0) * 0.15 + least({_count('b', Q.ENGAGEMENT)} / 2.0, 1.0) * 0.1
 + (CASE WHEN t = '' THEN 0.0 WHEN per BETWEEN 10 AND 20 THEN 1.0 WHEN per BETWEEN 5 AND 30 THEN 0.7 ELSE 0.4 END) * 0.15 + (CASE WHEN t = '' THEN 0.0 WHEN w >= 200 THEN 1.0 WHEN w >= 100 THEN 0.8 WHEN w >= 50 THEN 0.6 ELSE 0.3 END) * 0.15 + boost, 1.0)::DOUBLE AS s FROM g)"""
_kind = "CASE " + " ".join(f"WHEN {_any('b', w.split())} THEN {v}" for w, v in Q.EDUCATIONAL) + " ELSE 1.0 END"
SQL = {
    "document_quality": rf"""WITH {_D}, e AS (SELECT *, coalesce(main_content, '') AS t, coalesce(title, '') AS ti, lower(coalesce(main_content, '')) AS l, lower(coalesce(title, '')) AS lt, lower(coalesce(main_content, '')) || ' ' || lower(coalesce(title, '')) AS b, coalesce(len(content_categories), -1) AS hd FROM d),
f AS (SELECT *, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) / strlen(t) AS cap, list_transform(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> ''), lambda w: lower(w)) AS ws, len(regexp_extract_all(l, '{Q.CITATIONS}')) AS cited FROM e)
SELECT proc_id, {_FAST} AS fast_score, round(CASE WHEN t = '' THEN 0.1 ELSE (CASE WHEN word_count < 30 THEN 0.05 WHEN word_count < 50 THEN 0.15 WHEN word_count < 75 THEN 0.4 WHEN word_count < 150 THEN 0.8 WHEN word_count < 300 THEN 1.3 WHEN word_count <= 1000 THEN 1.5 WHEN word_count <= 3000 THEN 1.4 ELSE 1.2 END) * 0.2
 + (CASE WHEN contains(t, '```') THEN 1.2 ELSE 1.0 END) * (CASE WHEN hd >= 3 THEN 1.15 WHEN hd >= 1 THEN 1.05 ELSE 1.0 END) * 0.2
 + greatest(({_kind}) * (1.0 + {_count('b', Q.POSITIVE)} * 0.08) * (1.0 - {_count('b', Q.NEGATIVE)} * 0.15), 0.1) * 0.15
 + (CASE WHEN cap BETWEEN 0.02 AND 0.08 THEN 1.1 WHEN cap > 0.15 THEN 0.8 ELSE 1.0 END) * (CASE WHEN len(list_distinct(ws)) / len(ws) > 0.4 THEN 1.1 ELSE 1.0 END) * 0.1
 + (CASE WHEN strlen(ti) BETWEEN 10 AND 120 THEN 1.1 ELSE 1.0 END) * (CASE WHEN list_has_any(regexp_split_to_array(lt, '\s+'), ['how', 'guide', 'tutorial', 'api']) THEN 1.05 ELSE 1.0 END) * (CASE WHEN strlen(coalesce(description, '')) > 50 THEN 1.05 ELSE 1.0 END) * (CASE WHEN author_name IS NOT NULL THEN 1.02 ELSE 1.0 END) * (CASE WHEN published_date IS NOT NULL THEN 1.02 ELSE 1.0 END) * 0.1
 + least((CASE WHEN contains(t, '```') OR contains(t, '<code>') THEN 1.25 ELSE 1.0 END) * (CASE WHEN contains(t, 'def ') OR contains(t, 'function ') THEN 1.15 ELSE 1.0 END) * (CASE WHEN contains(l, 'class ') THEN 1.1 ELSE 1.0 END), 2.5) * 0.1
 + least((CASE WHEN cited > 0 THEN 1.0 + least(cited * 0.1, 0.5) ELSE 1.0 END) * (CASE WHEN {_any('l', Q.CREDENTIALS)} OR {_any('lt', Q.CREDENTIALS)} THEN 1.1 ELSE 1.0 END) * (CASE WHEN {_any('l', Q.INSTITUTIONS)} OR {_any('lt', Q.INSTITUTIONS)} THEN 1.15 ELSE 1.0 END), 2.0) * 0.1 + 0.05 END::DOUBLE, 5) AS score FROM f""",
    "result_quality": f"WITH {_D}, {_RES} SELECT proc_id, round(s, 3) AS score, CASE WHEN round(s, 6) >= 0.8 THEN 'high' WHEN round(s, 6) >= 0.6 THEN 'medium-high' WHEN round(s, 6) >= 0.4 THEN 'medium' WHEN round(s, 6) >= 0.2 THEN 'low-medium' ELSE 'low' END AS tier, round({_count('b', ['the', 'festival', 'report'])} / 3, 6) AS relevance FROM h",
    "quality_distribution": f"WITH {_D}, {_RES}, z AS (SELECT round(s, 3) AS s FROM h) SELECT round(avg(s), 3) AS average, max(s) AS highest, min(s) AS lowest, count(*) FILTER (s >= 0.8) AS high, count(*) FILTER (s BETWEEN 0.5 AND 0.7999999) AS medium, count(*) FILTER (s < 0.5) AS low FROM z",
    "chunk_quality": rf"""WITH c AS (SELECT DISTINCT chunk_id, text_chunk, relevant_headings, trim(text_chunk) AS t FROM doc_chunks) SELECT chunk_id, coalesce(strlen(t) >= 20 AND {_W.format('t')} >= 3 AND length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) >= floor(strlen(t) / 5) AND length(regexp_replace(t, '[^{{}}\[\]",:;]', '', 'g')) <= floor(strlen(t) / 3) AND {_any('lower(t)', Q.COMMON)}, false) AS meaningful, round(least(length(text_chunk) / 200, 1.0) * 50 + least(coalesce(len(relevant_headings), -1) / 5, 1.0) * 50, 4) AS score FROM c""",
    "text_metrics": rf"WITH {_D}, e AS (SELECT proc_id, main_content AS t, len(list_filter(regexp_split_to_array(main_content, '\s+'), lambda w: strlen(w) > 2)) AS w FROM d WHERE main_content IS NOT NULL) SELECT proc_id, CAST(w AS INTEGER) AS words, CAST(len(regexp_extract_all(t, '\.')) AS INTEGER) AS sentences, CAST(greatest(len(regexp_extract_all(t, chr(10))), 1) AS INTEGER) AS paragraphs, round(greatest(w / 200, 1.0)::DOUBLE, 6) AS minutes, round(w / greatest(strlen(t), 1), 6) AS density FROM e",
    "corpus_report": f"WITH {_D}, z AS (SELECT *, {_FAST} AS q FROM d) SELECT count(*) AS documents, count(*) FILTER (q >= 90) AS excellent, count(*) FILTER (q >= 70 AND q < 90) AS good, count(*) FILTER (q >= 50 AND q < 70) AS fair, count(*) FILTER (q < 50) AS poor, count(*) FILTER (trim(title) <> '') AS with_title, count(*) FILTER (trim(description) <> '') AS with_description, count(*) FILTER (trim(author_name) <> '') AS with_author, count(*) FILTER (trim(published_date) <> '') AS with_date, count(*) FILTER (len(keywords) > 0) AS with_keywords, round(avg(word_count), 4) AS mean_words, round(avg(q), 4) AS mean_score FROM z",
}
