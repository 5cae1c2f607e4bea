"""Cheap language gates, technical share and template summaries as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.url import domain, path

# Host and path marks of languages, hosts and top-level domains taken for English.
OTHER_SUBDOMAINS = "es de fr it pt ru zh ja ko ar hi nl pl sv da no fi".split()
OTHER_PATHS = "de es fr it pt ru zh ja ko deutsch espanol francais italiano portuguese".split()
ENGLISH_HOSTS = "google facebook twitter youtube reddit stackoverflow github microsoft apple amazon wikipedia linkedin instagram netflix spotify dropbox slack zoom techcrunch engadget theverge wired ars-technica hacker-news medium substack wordpress blogspot".split()
ENGLISH_TLDS = "com org net edu gov mil int us uk ca au nz ie za www en english".split()
# Frequent short words of each language, for texts without any mark.
FREQUENT = {
    "en": "the of and to in is that for with was", "es": "el la los las de que y en por con", "fr": "le la les des et est une dans pour que", "de": "der die das und ist nicht mit den von ein", "it": "il lo gli della che di e un per non",
    "pt": "o os das que não uma com para em por", "nl": "de het een van en is dat niet met voor", "ru": "и в не на что с по это как для",
}
#: Terms that make a text technical, as whole words; a parameter of technical_score.
TECHNICAL = (
    "api function class method algorithm code software programming development technology technical system framework library database server client frontend backend compiler object variable loop array string boolean integer float pointer "
    "recursion stack queue tree graph hash encryption protocol network cloud container docker kubernetes git version repository branch merge commit debug exception error log performance optimization testing json xml yaml html css javascript "
    "typescript python java sql nosql security authentication token session cookie http https rest cache cluster query latency thread process"
).split()


def language_of_url(url: Column) -> Column:
    """'en', 'non-en' or null by subdomain, known host, path and top-level domain, in this order."""
    d, p = domain(url), F.lower(path(url))
    return (
        F.when(d == "", None).when(d.rlike(r"^(?:en|english)\."), "en").when(d.rlike(rf"^(?:{'|'.join(OTHER_SUBDOMAINS)})\."), "non-en").when(d.rlike("|".join(ENGLISH_HOSTS)), "en")
        .when(p.rlike("/(?:en|english)/"), "en").when(p.rlike(rf"/(?:{'|'.join(OTHER_PATHS)})/"), "non-en").when(F.element_at(F.split(F.regexp_replace(d, r":\d+$", ""), r"\."), -1).isin(*ENGLISH_TLDS), "en")
    )


def language_of_html(html: Column) -> Column:
    """The first two letters of the first lang attribute; null without one."""
    return F.nullif(F.lower(F.substring(F.regexp_extract(html, r"""lang=["']?([^"'\s>]{2})""", 1), 1, 2)), F.lit(""))


def language_of_words(text: Column, least: float = 0.08) -> Column:
    """The language whose frequent words make the largest share of the words, if that share is `least` or more; ties in table order."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"https?://\S+", " ")), F.lit(r"\p{L}+"), 0)
    shares = {k: _share(words, v.split()) for k, v in FREQUENT.items()}
    best = F.greatest(*shares.values())
    name = F.when(F.coalesce(best, F.lit(0.0)) < least, None)
    for k, s in shares.items():
        name = name.when(s == best, k)
    return name


def _share(words: Column, frequent: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*frequent))) / F.greatest(F.size(words), F.lit(1))


def language_info(text: Column, url: Column) -> Column:
    """struct(language, confidence, english_url): url, lang attribute, then words; 0.95 if the url says English, 0.8 otherwise, 0 without a language."""
    by_url = language_of_url(url)
    english = F.coalesce(by_url == "en", F.lit(False))
    language = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", None).when(english, "en").otherwise(F.coalesce(language_of_html(text), language_of_words(text)))
    return F.struct(language.alias("language"), F.when(language.isNull(), 0.0).when(english, 0.95).otherwise(0.8).alias("confidence"), english.alias("english_url"))


def technical_score(text: Column, terms: list[str] = TECHNICAL) -> Column:
    """Hits of technical terms for a thousand bytes; over 0.3 counts as technical."""
    return F.regexp_count(text, F.lit(rf"(?i)\b(?:{'|'.join(terms)})\b")) / F.greatest(F.octet_length(text), F.lit(1)) * 1000


def template_summary(results: DataFrame, query: str, limit: int = 300) -> DataFrame:
    """One row with `summary` of ranked results (rank, title, site): count, three commonest sites, first title, cut at a word.

    results is the short list of one query.
    """
    sites = results.where("site <> ''").groupBy("site").agg(F.count("*").alias("n"))
    top = sites.agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "site"))), lambda x: x["site"]), 1, 3).alias("sites"))
    main = results.agg(F.count("*").alias("n"), F.min_by(F.trim("title"), "rank").alias("title"))
    q, many = F.lit(query), F.size("sites") > 1
    parts = [
        F.when(F.col("n") == 1, F.concat(F.lit("Found 1 relevant result for '"), q, F.lit("'."))).otherwise(F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" relevant results for '"), q, F.lit("'."))),
        F.when(many, F.concat(F.lit("Results span multiple sources including "), F.array_join("sites", ", "), F.lit("."))).when(F.size("sites") == 1, F.concat(F.lit("Results primarily from "), F.col("sites")[0], F.lit("."))),
        F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("Top result: '"), F.col("title"), F.lit("'."))),
    ]
    text = F.concat_ws(" ", *parts)
    cut = F.concat(F.regexp_replace(F.substring(text, 1, limit), r" \S*$", ""), F.lit("..."))
    return main.crossJoin(F.broadcast(top)).select(F.when(F.col("n") == 0, "No results found.").when(F.length(text) > limit, cut).otherwise(text).alias("summary"))  # one row each
