"""Ranked retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import search as S
from gleanery.session import load

TERMS = ["kernel", "lighthouse"]
QUERY = "quiet lighthouse"
FUZZY = ["kernal", "lighthous", "budgets", "festivl", "of"]


def bm25_topk(spark, d):
    """Ten best documents for two terms."""
    scored = S.bm25(load(spark, d, "documents").select("doc_id", "text").where("text is not null"), {"text": 1.0}, TERMS)
    return scored.where("score > 0").select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


def term_statistics(spark, d):
    return S.term_statistics(load(spark, d, "documents"), "doc_id", "text")


def postings(spark, d):
    p = S.postings(load(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return p.select("term", "doc_id", "tf", F.col("positions")[0].alias("first_position"), "length")


def ranked_search(spark, d):
    """Weighted best-field search over chunks joined to documents, phrase boost, diversity by site."""
    return S.search(S.search_view(load(spark, d, "doc_chunks"), load(spark, d, "site_docs")), QUERY, 10)


def fuzzy_expansion(spark, d):
    return S.fuzzy_terms(S.term_statistics(load(spark, d, "documents"), "doc_id", "text"), "term", FUZZY)


def fallback_search(spark, d):
    """Title, text or url matches, used only when the first query finds nothing (here it does: no word is 'zzzz')."""
    view = S.search_view(load(spark, d, "doc_chunks"), load(spark, d, "site_docs"))
    first = S.search(view, "zzzzunknown", 5).select("chunk_id", "score")
    second = S.bm25(view, {"title": 2.0, "text_chunk": 1.0}, ["news"])
    second = second.withColumn("score", F.round(F.col("score") + F.when(F.col("url").contains("news"), 1.0).otherwise(0.0), 6)).where("score > 0").select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(5)
    return first.unionByName(second.join(first.agg(F.count("*").alias("n")).where("n = 0"), how="cross").drop("n"))


QUERIES = {f.__name__: f for f in (bm25_topk, term_statistics, postings, ranked_search, fuzzy_expansion, fallback_search)}

_TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def _tf(field: str, term: str) -> str:
    return f"len(list_filter({_TOK.format(field)}, lambda x: x = '{term}'))"


def _score(field: str, terms: list[str], weight: float) -> str:
    parts = [f"CASE WHEN {field}_{i} > 0 THEN ln(1 + (n - df_{field}_{i} + 0.5) / (df_{field}_{i} + 0.5)) * {field}_{i} * 2.5 / ({field}_{i} + 1.5 * (0.25 + 0.75 * {field}_n / avg_{field})) ELSE 0 END" for i in range(len(terms))]
    return f"({' + '.join(parts)}) * {weight}"


def _bm25(source: str, keep: str, fields: dict[str, float], terms: list[str]) -> str:
    """Common table expressions v (rows with counts), s (statistics) and r (rows with score)."""
    counts = ", ".join(f"coalesce(len({_TOK.format(f)}), 0) AS {f}_n, " + ", ".join(f"coalesce({_tf(f, t)}, 0) AS {f}_{i}" for i, t in enumerate(terms)) for f in fields)
    stats = ", ".join(f"avg({f}_n) AS avg_{f}, " + ", ".join(f"count(*) FILTER ({f}_{i} > 0) AS df_{f}_{i}" for i in range(len(terms))) for f in fields)
    scores = [_score(f, terms, w) for f, w in fields.items()]
    best = f"greatest({', '.join(scores)})" if len(scores) > 1 else scores[0]
    return f"v AS (SELECT {keep}, {counts} FROM {source}), s AS (SELECT count(*) AS n, {stats} FROM v), r AS (SELECT v.*, {best} AS score FROM v, s)"


_VIEW = """c AS (SELECT chunk_id, document_id, any_value(text_chunk) AS text_chunk, any_value(array_to_string(relevant_headings, ' ')) AS headings FROM doc_chunks GROUP BY chunk_id, document_id),
dd AS (SELECT document_id, any_value(title) AS title, any_value(url) AS url, any_value(array_to_string(keywords, ' ')) AS keywords, any_value(semantic_info.content_quality_score) AS quality, any_value(semantic_info.domain_score) AS domain_score FROM site_docs GROUP BY document_id),
w AS (SELECT c.*, title, url, keywords, quality, domain_score, regexp_replace(lower(regexp_extract(url, '^\\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#\\s]+)', 1)), '^www\\.', '') AS site FROM c JOIN dd USING (document_id))"""
_PHRASE = r"(len(regexp_extract_all(' ' || array_to_string(regexp_extract_all(lower(text_chunk), '[\p{L}\p{N}]+'), '  ') || ' ', ' quiet  lighthouse ')))"

SQL = {
    "bm25_topk": "WITH " + _bm25("documents WHERE text IS NOT NULL", "doc_id", {"text": 1.0}, TERMS) + " SELECT doc_id, round(score, 6) AS score FROM r WHERE score > 0 ORDER BY round(score, 6) DESC, doc_id LIMIT 10",
    "term_statistics": f"WITH e AS (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents), g AS (SELECT doc_id, term, count(*) AS tf FROM e GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM g GROUP BY term",
    "postings": f"WITH p AS (SELECT doc_id, {_TOK.format('text')} AS t FROM documents), e AS (SELECT doc_id, len(t) AS length, unnest(t) AS term, unnest(range(len(t))) AS position FROM p) SELECT term, doc_id, count(*) AS tf, CAST(min(position) AS INTEGER) AS first_position, CAST(max(length) AS INTEGER) AS length FROM e GROUP BY term, doc_id",
    "ranked_search": "WITH " + _VIEW + ", " + _bm25("w", "chunk_id, document_id, site, quality, domain_score, text_chunk", S.FIELDS, QUERY.split()) + f""",
t AS (SELECT chunk_id, document_id, site, quality, domain_score, round(score + 2.0 * {_PHRASE}, 6) AS score FROM r),
k AS (SELECT *, row_number() OVER (ORDER BY score DESC, quality DESC NULLS LAST, domain_score DESC NULLS LAST, chunk_id) AS rank FROM t WHERE score > 0 QUALIFY rank <= 90),
q AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY rank) > 3 AS beyond FROM k),
z AS (SELECT *, row_number() OVER (ORDER BY beyond, rank) AS place FROM q)
SELECT chunk_id, document_id, site, score, CAST(rank AS INTEGER) AS rank, CAST(place AS INTEGER) AS place FROM z WHERE place <= 10""",
    "fuzzy_expansion": f"WITH v AS (SELECT DISTINCT unnest({_TOK.format('text')}) AS term FROM documents), q AS (SELECT unnest({FUZZY!r}) AS query), a AS (SELECT query, CASE WHEN length(query) <= 2 THEN 0 WHEN length(query) <= 5 THEN 1 ELSE 2 END AS edits FROM q) SELECT query, term, CAST(levenshtein(term, query) AS INTEGER) AS distance FROM v, a WHERE abs(length(term) - length(query)) <= edits AND levenshtein(term, query) <= edits",
    "fallback_search": "WITH " + _VIEW + ", " + _bm25("w", "chunk_id, url", {"title": 2.0, "text_chunk": 1.0}, ["news"]) + ", t AS (SELECT chunk_id, round(score + CASE WHEN contains(url, 'news') THEN 1.0 ELSE 0.0 END, 6) AS score FROM r) SELECT chunk_id, score FROM t WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 5",
}
