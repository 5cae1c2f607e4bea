"""Quality scores of documents, chunks and results as column expressions. Lengths are in bytes where the definition says bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that the document score counts, with the factors they give.
EDUCATIONAL = [("tutorial guide documentation manual reference api how-to", 1.4), ("example demo introduction overview basics fundamentals", 1.25), ("blog news announcement release", 1.1)]
POSITIVE = "detailed comprehensive complete thorough in-depth".split()
NEGATIVE = "broken outdated deprecated old legacy".split()
CITATIONS = r"\[\d+\]|\(\d{4}\)|doi:|isbn:|arxiv:|according to|research shows|study found|published in"
CREDENTIALS = ["phd", "ph.d", "doctor", "professor", "researcher", "expert", "scientist", "engineer", "certified", "author:", "by:", "written by"]
INSTITUTIONS = ["university", "institute", "research center", "official", "documentation", "specification", "standard", "rfc", "ieee", "acm"]
# Phrases that the result score counts.
DEPTH = ["implementation", "algorithm", "architecture", "design pattern", "best practices", "performance", "optimization", "scalability", "security", "testing", "documentation", "code example", "step by step", "detailed explanation", "comprehensive"]
AUTHORITY = ["official documentation", "api reference", "specification", "white paper", "research", "peer reviewed", "academic", "expert", "maintainer", "core team", "official blog"]
FRESHNESS = ["2024", "2025", "latest", "updated", "recent", "new version", "current", "modern"]
ENGAGEMENT = ["comments", "discussion", "community", "forum", "stack overflow", "github", "popular", "trending"]
# Boost and authority of hosts in result lists (others 0 and 0.5).
HOST_BOOST = {"github.com": 0.15, "stackoverflow.com": 0.2, "docs.python.org": 0.25, "developer.mozilla.org": 0.2, "reactjs.org": 0.15, "nodejs.org": 0.15, "microsoft.com": 0.1, "google.com": 0.1, "w3.org": 0.15, "ieee.org": 0.2}
HOST_AUTHORITY = {"github.com": 0.9, "stackoverflow.com": 0.95, "docs.python.org": 0.98, "developer.mozilla.org": 0.95, "reactjs.org": 0.9, "nodejs.org": 0.9, "microsoft.com": 0.85, "google.com": 0.85, "w3.org": 0.9, "ieee.org": 0.95}
# Common English words of which a chunk must hold one.
COMMON = "the and or but in on at to for of with by a an is are was were this that".split()


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def count_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def content_quality(text: Column, title: Column, description: Column, author: Column, published: Column, word_count: Column, headings: Column) -> Column:
    """Weighted sum of eight factors (may exceed 1); 0.1 for an empty text."""
    text, title, description = (F.coalesce(c, F.lit("")) for c in (text, title, description))
    low, low_title = F.lower(text), F.lower(title)
    both = F.concat(low, F.lit(" "), low_title)
    length = F.when(word_count < 30, 0.05).when(word_count < 50, 0.15).when(word_count < 75, 0.4).when(word_count < 150, 0.8).when(word_count < 300, 1.3).when(word_count <= 1000, 1.5).when(word_count <= 3000, 1.4).otherwise(1.2)
    structure = F.when(text.contains("```"), 1.2).otherwise(1.0) * F.when(headings >= 3, 1.15).when(headings >= 1, 1.05).otherwise(1.0)
    kind = F.when(any_of(both, EDUCATIONAL[0][0].split()), EDUCATIONAL[0][1]).when(any_of(both, EDUCATIONAL[1][0].split()), EDUCATIONAL[1][1]).when(any_of(both, EDUCATIONAL[2][0].split()), EDUCATIONAL[2][1]).otherwise(1.0)
    kind = F.greatest(kind * (1.0 + count_of(both, POSITIVE) * 0.08) * (1.0 - count_of(both, NEGATIVE) * 0.15), F.lit(0.1))
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / F.octet_length(text)
    words = F.transform(words_of(text), lambda w: F.lower(w))
    language = F.when(capitals.between(0.02, 0.08), 1.1).when(capitals > 0.15, 0.8).otherwise(1.0) * F.when(F.size(F.array_distinct(words)) / F.size(words) > 0.4, 1.1).otherwise(1.0)
    title_words = F.split(low_title, r"\s+")
    metadata = F.when(F.octet_length(title).between(10, 120), 1.1).otherwise(1.0) * F.when(F.arrays_overlap(title_words, F.array(*[F.lit(w) for w in ("how", "guide", "tutorial", "api")])), 1.05).otherwise(1.0)
    metadata = metadata * F.when(F.octet_length(description) > 50, 1.05).otherwise(1.0) * F.when(author.isNotNull(), 1.02).otherwise(1.0) * F.when(published.isNotNull(), 1.02).otherwise(1.0)
    technical = F.when(text.contains("```") | text.contains("<code>"), 1.25).otherwise(1.0) * F.when(text.contains("def ") | text.contains("function "), 1.15).otherwise(1.0) * F.when(low.contains("class "), 1.1).otherwise(1.0)
    cited = F.regexp_count(low, F.lit(CITATIONS))
    trust = F.when(cited > 0, 1.0 + F.least(cited * 0.1, F.lit(0.5))).otherwise(1.0) * F.when(any_of(low, CREDENTIALS) | any_of(low_title, CREDENTIALS), 1.1).otherwise(1.0) * F.when(any_of(low, INSTITUTIONS) | any_of(low_title, INSTITUTIONS), 1.15).otherwise(1.0)
    total = length * 0.2 + structure * 0.2 + kind * 0.15 + language * 0.1 + metadata * 0.1 + F.least(technical, F.lit(2.5)) * 0.1 + F.least(trust, F.lit(2.0)) * 0.1 + 0.05
    return F.when(text == "", 0.1).otherwise(total)


def fast_quality(text: Column, title: Column, keywords: Column) -> Column:
    """0 to 100 from the lengths of text and title, keywords and words."""
    n, t = F.length(F.trim(F.coalesce(text, F.lit("")))), F.length(F.trim(F.coalesce(title, F.lit(""))))
    k, w = F.coalesce(keywords, F.lit(0)), F.size(words_of(F.coalesce(text, F.lit(""))))
    return (
        F.when(n > 1000, 40.0).when(n > 500, 30.0).when(n > 100, 20.0).when(n > 20, 10.0).otherwise(0.0)
        + F.when(t.between(20, 100), 30.0).when(t.between(10, 150), 20.0).when(t > 0, 10.0).otherwise(0.0)
        + F.when(k >= 5, 20.0).when(k >= 3, 15.0).when(k >= 1, 10.0).otherwise(0.0)
        + F.when(w > 50, 10.0).when(w > 10, 5.0).otherwise(0.0)
    )


def result_quality(text: Column, title: Column, host: Column) -> Column:
    """Six weighted factors and the host's boost, at most 1, rounded to three digits."""
    text, title, host = (F.coalesce(c, F.lit("")) for c in (text, title, host))
    both = F.lower(F.concat(title, F.lit(" "), text))
    boost = F.coalesce(F.create_map(*[F.lit(x) for kv in HOST_BOOST.items() for x in kv])[F.lower(host)], F.lit(0.0))
    share = lambda words, n: F.least(count_of(both, words) / n, F.lit(1.0))
    words = F.size(words_of(text))
    per = words / F.size(F.split(text, "[.!?]+"))
    readable = F.when(text == "", 0.0).when(per.between(10, 20), 1.0).when((per >= 5) & (per <= 30), 0.7).otherwise(0.4)
    complete = F.when(text == "", 0.0).when(words >= 200, 1.0).when(words >= 100, 0.8).when(words >= 50, 0.6).otherwise(0.3)
    total = share(DEPTH, 5.0) * 0.25 + F.least(share(AUTHORITY, 3.0) + boost, F.lit(1.0)) * 0.2 + share(FRESHNESS, 3.0) * 0.15 + share(ENGAGEMENT, 2.0) * 0.1 + readable * 0.15 + complete * 0.15
    return F.least(total + boost, F.lit(1.0))


def quality_tier(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium-high").when(score >= 0.4, "medium").when(score >= 0.2, "low-medium").otherwise("low")


def relevance(query: str, text: Column, title: Column) -> Column:
    """Share of the query's words that the title or text holds."""
    words = query.lower().split()
    both = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))
    return count_of(both, words) / len(words) if words else F.lit(0.0)


def meaningful(chunk: Column) -> Column:
    """At least 20 bytes and three words, a fifth letters, at most a third JSON signs, one common word."""
    t = F.trim(chunk)
    size = F.octet_length(t)
    letters, signs = F.length(F.regexp_replace(t, r"[^\p{L}]", "")), F.length(F.regexp_replace(t, r'[^{}\[\]",:;]', ""))
    return F.coalesce((size >= 20) & (F.size(words_of(t)) >= 3) & (letters >= F.floor(size / 5)) & (signs <= F.floor(size / 3)) & any_of(F.lower(t), COMMON), F.lit(False))


def chunk_score(chunk: Column, keywords: Column) -> Column:
    return F.least(F.length(chunk) / 200, F.lit(1.0)) * 50 + F.least(keywords / 5, F.lit(1.0)) * 50
