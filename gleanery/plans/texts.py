"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.session import load

_NOISE = " vte diffhist mail me at a.b@c.example or https://x.example/y?z=1 &amp; \\\\u003c wow!!!! end"


def clean_texts(spark, d):
    t = F.concat(F.col("text"), F.lit(_NOISE.replace("\\\\", "\\")))
    return load(spark, d, "documents").select("doc_id", T.clean_text(t).alias("cleaned"))


def clean_descriptions(spark, d):
    return load(spark, d, "documents").select("doc_id", T.clean_description(F.col("text")).alias("description"))


def text_chunks(spark, d):
    """Sentence chunks of every text of documents."""
    chunks = load(spark, d, "documents").select("doc_id", F.posexplode(T.sentence_chunks(T.clean_text(F.col("text")), 400, 50)).alias("chunk_index", "chunk"))
    return chunks


def search_terms(spark, d):
    return load(spark, d, "documents").select("doc_id", F.size(T.terms(F.col("text"))).alias("terms"), T.preview(F.col("text")).alias("preview"), T.highlight(F.col("text"), ["lighthouse", "kernel"]).alias("excerpt"), T.clean_query(F.substring("text", 1, 60)).alias("query"))


def signatures(spark, d):
    docs = load(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", T.signature(F.col("content_type"), F.col("text")).alias("signature"), F.concat(F.lit("doc_"), F.substring(F.sha2("url", 256), 1, 12)).alias("document_id"))


def frequent_keywords(spark, d):
    return T.frequent_keywords(load(spark, d, "documents").where("text IS NOT NULL"), "doc_id", "text")


def phrase_keywords(spark, d):
    k = T.phrase_keywords(load(spark, d, "documents").where("text IS NOT NULL"), "doc_id", "text")
    return k.withColumn("score", F.round("score", 6))


QUERIES = {f.__name__: f for f in (clean_texts, clean_descriptions, text_chunks, search_terms, signatures, frequent_keywords, phrase_keywords)}


def _clean(t: str) -> str:
    t = rf"regexp_replace({t}, '\s?vte\s', ' ', 'g')"
    for p in (T.INTERFACE, T.URLS, T.EMAILS, T.ENTITIES, T.ESCAPES):
        t = f"regexp_replace({t}, '{p}', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({t}, '[.!?]{{3,}}', '...', 'g'), '\s+', ' ', 'g'))"


_WORDS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_PRE = rf"trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '{T.ENTITIES}', ' ', 'g'))"
_DESC = rf"trim(regexp_replace(regexp_replace(text, '{T.ENTITIES}', ' ', 'g'), '\s+', ' ', 'g'))"
SQL = {
    "clean_texts": f"SELECT doc_id, {_clean('(text || ' + repr(_NOISE.replace(chr(92) * 2, chr(92))) + ')')} AS cleaned FROM documents".replace("\\\\u003c wow", "\\u003c wow"),
    "clean_descriptions": f"WITH a AS (SELECT doc_id, {_DESC} AS t FROM documents), b AS (SELECT *, substr(t, 1, 300) AS h FROM a) SELECT doc_id, CASE WHEN length(t) <= 300 THEN t WHEN contains(h, '.') THEN substr(h, 1, length(h) - instr(reverse(h), '.') + 1) WHEN contains(h, ' ') THEN substr(h, 1, length(h) - instr(reverse(h), ' ')) || '...' ELSE substr(h, 1, 297) || '...' END AS description FROM b",
    "search_terms": rf"WITH a AS (SELECT doc_id, text, least(CASE WHEN instr(lower(text), 'lighthouse') > 0 THEN instr(lower(text), 'lighthouse') END, CASE WHEN instr(lower(text), 'kernel') > 0 THEN instr(lower(text), 'kernel') END) AS pos FROM documents), b AS (SELECT *, greatest(1, pos - 100) AS s FROM a), c AS (SELECT *, least(length(text), s + 299) AS e FROM b) SELECT doc_id, CAST(len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 3)) AS INTEGER) AS terms, coalesce(CASE WHEN length({_PRE}) > 300 THEN substr({_PRE}, 1, 300) || '...' ELSE {_PRE} END, '') AS preview, CASE WHEN pos IS NULL THEN substr(text, 1, 300) ELSE CASE WHEN s > 1 THEN '...' ELSE '' END || substr(text, s, e - s + 1) || CASE WHEN e < length(text) THEN '...' ELSE '' END END AS excerpt, trim(regexp_replace(regexp_replace(trim(substr(text, 1, 60)), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s\-.?!]', '', 'g')) AS query FROM c",
    "signatures": r"SELECT doc_id, md5(regexp_replace(trim(lower(coalesce(content_type, '') || ' ' || text)), '\s+', ' ', 'g')) AS signature, 'doc_' || substr(sha256(url), 1, 12) AS document_id FROM documents WHERE text IS NOT NULL",
    "frequent_keywords": f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS keyword FROM documents), c AS (SELECT doc_id, keyword, count(*) AS n FROM w WHERE keyword NOT IN ({_WORDS}) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, keyword) AS r FROM c) SELECT doc_id, keyword, n FROM r WHERE r <= 10 AND n >= 2",
    "phrase_keywords": rf"WITH p AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(regexp_replace(lower(text), '[^a-z\s]', '|', 'g'), '\b(?:{'|'.join(T.STOP_WORDS)})\b', '|', 'g'), '|'), lambda p: trim(p) <> '')) AS p FROM documents), w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(p), '\s+'), lambda w: w <> '') AS w FROM p), e AS (SELECT doc_id, len(w) - 1 AS degree, unnest(w) AS keyword FROM w), s AS (SELECT doc_id, keyword, (sum(degree) + count(*)) / count(*) AS score FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, keyword) AS r FROM s WHERE length(keyword) > 2) SELECT doc_id, keyword, round(CAST(score AS DOUBLE), 6) AS score FROM r WHERE r <= 10",
}
