"""Query intelligence over a fixed list of queries and over all titles of the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import query as I
from gleanery.session import load

SAMPLES = [
    "python import error modulenotfound fix", "react hooks tutorial step by step", "python pandas api reference", "how to fix javascript error in react", "docker kubernetes tutorial for beginners", "python machine learning tutorial", "",
    "JSON vs XML", 'alternatives to "big data" tools', "pytohn funciton databse", "advanced SQL course pdf", "getting started with AWS", "compare vue versus angular", "code example snippet demo of git testing", "?!",
]


def _queries(spark, d):
    """The samples and every distinct title of site_docs, as queries."""
    fixed = spark.createDataFrame([(x,) for x in SAMPLES], "query string")
    return fixed.unionByName(load(spark, d, "site_docs").where("title IS NOT NULL").select(F.col("title").alias("query"))).distinct()


def query_intent(spark, d):
    q = F.col("query")
    return _queries(spark, d).select("query", I.intent(q).alias("i"), I.valid(q).alias("valid")).select("query", "i.intent", "i.confidence", F.array_join("i.filters", ",").alias("filters"), "valid")


def query_entities(spark, d):
    return _queries(spark, d).select("query", I.entities(F.col("query")).alias("e")).select("query", *[F.array_join(f"e.{x}", ",").alias(x) for x in ("technologies", "levels", "content_types")])


def query_enhancement(spark, d):
    q = F.col("query")
    return _queries(spark, d).select("query", F.array_join(I.expansions(q), ",").alias("expansions"), I.enhanced(q).alias("enhanced"), F.array_join(I.suggestions(q), "|").alias("suggestions"), F.array_join(I.corrections(q), ",").alias("corrections"), F.array_join(I.phrases(q), "|").alias("phrases"), F.array_join(I.acronyms(q), ",").alias("acronyms"), I.confidence(q).alias("confidence"))


QUERIES = {f.__name__: f for f in (query_intent, query_entities, query_enhancement)}

_LIST = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in SAMPLES) + "]"
_Q = f"q AS (SELECT unnest({_LIST}) AS query UNION SELECT title FROM site_docs WHERE title IS NOT NULL), l AS (SELECT query, lower(query) AS q FROM q)"


def _hits(patterns):
    return " + ".join(f"len(regexp_extract_all(q, '{p}'))" for p in patterns)


def _lits(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _list(table):
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(q, {p!r})' for p in v)} THEN '{k}' END" for k, v in table.items()) + "], lambda x: x IS NOT NULL), ',')"


_EXP = "flatten([" + ", ".join(f"CASE WHEN contains(q, '{k}') THEN {_lits(v)} ELSE [] END" for k, v in I.EXPANSIONS.items()) + "])"
_names = list(I.INTENTS)
SQL = {
    "query_intent": f"WITH {_Q}, s AS (SELECT query, " + ", ".join(f"{_hits(v)} AS {k}" for k, v in I.INTENTS.items()) + f" FROM l), b AS (SELECT *, greatest({', '.join(_names)}) AS best FROM s), n AS (SELECT query, best, CASE WHEN best = 0 THEN 'general' " + " ".join(f"WHEN {k} = best THEN '{k}'" for k in _names) + " END AS intent FROM b) SELECT query, intent, CASE WHEN best = 0 THEN 0.5 ELSE round(least(best / 3, 1.0), 3) END::DOUBLE AS confidence, CASE intent " + " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in I.FILTERS.items()) + " END AS filters, coalesce(length(query) <= 500 AND regexp_matches(query, '[a-zA-Z0-9]'), false) AS valid FROM n",
    "query_entities": f"WITH {_Q} SELECT query, {_list(I.TECHNOLOGIES)} AS technologies, {_list(I.LEVELS)} AS levels, {_list(I.CONTENT)} AS content_types FROM l",
    "query_enhancement": f"""WITH {_Q}, e AS (SELECT query, q, {_EXP} AS x, list_filter(regexp_split_to_array(q, '\\s+'), lambda w: list_contains({_lits(I.SPELLING)}, w)) AS bad FROM l),
f AS (SELECT *, list_filter(x, lambda v, i: list_position(x, v) = i) AS u FROM e),
g AS (SELECT *, contains(q, 'how') OR contains(q, 'tutorial') OR contains(q, 'guide') AS h, contains(q, 'error') OR contains(q, 'fix') OR contains(q, 'problem') AS p, contains(q, 'python') OR contains(q, 'javascript') OR contains(q, 'react') OR contains(q, 'vue') AS t FROM f)
SELECT query, array_to_string(u, ',') AS expansions, CASE WHEN len(u) = 0 THEN trim(query) ELSE trim(query) || ' OR (' || array_to_string(list_transform(u[1:3], lambda v: '"' || v || '"'), ' OR ') || ')' END AS enhanced,
array_to_string(list_filter([CASE WHEN h THEN query || ' for beginners' END, CASE WHEN h THEN query || ' step by step' END, CASE WHEN p THEN 'solve ' || query END, CASE WHEN p THEN 'debug ' || query END, CASE WHEN t THEN query || ' best practices' END, CASE WHEN t THEN query || ' examples' END], lambda v: v IS NOT NULL)[1:5], '|') AS suggestions,
array_to_string(list_transform(bad, lambda w: w || ':' || CASE w {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in I.SPELLING.items())} END), ',') AS corrections,
array_to_string(regexp_extract_all(query, '"([^"]*)"', 1), '|') AS phrases, array_to_string(regexp_extract_all(query, '\\b[A-Z]{{2,}}\\b'), ',') AS acronyms, least(round((0.5 + least(len(u) * 0.1, 0.3) + least(len(bad) * 0.2, 0.2))::DOUBLE, 3), 1.0) AS confidence FROM g""",
}
