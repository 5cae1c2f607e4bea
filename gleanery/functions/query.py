"""Query intelligence: intent, entities, expansion, suggestions, spelling, phrases as column expressions over a query column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of each intent, in order of precedence, and the filters it suggests.
INTENTS = {
    "tutorial": [r"how\s+to\s+", r"tutorial\s+", r"guide\s+", r"step\s+by\s+step", r"learn\s+", r"getting\s+started", r"beginners?\s+", r"introduction\s+to"],
    "troubleshooting": [r"error\s+", r"fix\s+", r"problem\s+", r"issue\s+", r"debug\s+", r"solve\s+", r"troubleshoot", r"not\s+working", r"broken\s+", r"failed\s+"],
    "reference": [r"documentation\s+", r"reference\s+", r"api\s+", r"docs\s+", r"manual\s+", r"specification"],
    "comparison": [r"vs\s+", r"versus\s+", r"compare\s+", r"difference\s+between", r"better\s+than", r"alternatives?\s+to"],
    "example": [r"example\s+", r"sample\s+", r"demo\s+", r"code\s+example", r"snippet\s+"],
}
FILTERS = {
    "tutorial": ["guide", "tutorial", "beginner-friendly", "step-by-step"], "troubleshooting": ["solution", "fix", "debugging", "error-resolution"], "reference": ["documentation", "api-reference", "manual", "specification"],
    "comparison": ["comparison", "analysis", "pros-cons", "evaluation"], "example": ["code-example", "sample", "demo", "implementation"], "general": ["comprehensive", "detailed", "explanation"],
}
# What a query word is expanded to.
EXPANSIONS = {
    "python": ["python3", "py", "python programming"], "javascript": ["js", "ecmascript", "node.js", "nodejs"], "react": ["reactjs", "react.js", "facebook react"], "vue": ["vuejs", "vue.js"], "angular": ["angularjs", "angular.js"],
    "machine learning": ["ML", "artificial intelligence", "AI", "deep learning"], "neural networks": ["neural nets", "deep learning", "CNN", "RNN"], "api": ["rest api", "restful", "web service", "endpoint"], "database": ["db", "sql", "nosql", "data storage"],
    "docker": ["containerization", "containers"], "kubernetes": ["k8s", "container orchestration"], "git": ["version control", "github", "gitlab"], "testing": ["unit tests", "integration tests", "TDD", "test-driven"], "debugging": ["troubleshooting", "error handling", "bug fixing"],
    "tutorial": ["guide", "how to", "step by step", "walkthrough"], "documentation": ["docs", "reference", "manual", "API docs"], "example": ["sample", "demo", "code example", "snippet"], "troubleshooting": ["error", "fix", "problem", "issue", "debug"], "best practices": ["patterns", "conventions", "standards"],
}
# Substrings by entity.
TECHNOLOGIES = {
    "python": ["python", "py", "python3"], "javascript": ["javascript", "js", "node", "nodejs"], "java": ["java", "jvm"], "react": ["react", "reactjs"], "vue": ["vue", "vuejs"], "angular": ["angular", "angularjs"], "docker": ["docker", "container"], "kubernetes": ["kubernetes", "k8s"],
    "aws": ["aws", "amazon web services"], "azure": ["azure", "microsoft azure"], "gcp": ["gcp", "google cloud"], "database": ["sql", "mysql", "postgresql", "mongodb", "redis"], "machine_learning": ["ml", "ai", "machine learning", "neural network", "tensorflow", "pytorch"],
}
LEVELS = {"beginner": ["beginner", "basic", "intro", "getting started", "fundamentals"], "intermediate": ["intermediate", "advanced basics"], "advanced": ["advanced", "expert", "professional", "production"]}
CONTENT = {"tutorial": ["tutorial", "guide", "how to", "walkthrough"], "documentation": ["docs", "documentation", "reference", "manual"], "example": ["example", "sample", "demo"], "course": ["course", "lesson", "training"], "book": ["book", "ebook", "pdf"], "video": ["video", "youtube", "watch"]}
# Common misspellings.
SPELLING = {"machien": "machine", "javscript": "javascript", "javascirpt": "javascript", "pytohn": "python", "databse": "database", "algoritm": "algorithm", "functon": "function", "funciton": "function"}


def intent_scores(query: Column) -> dict[str, Column]:
    q = F.lower(query)
    return {k: reduce(lambda a, b: a + b, [F.regexp_count(q, F.lit(p)) for p in v]) for k, v in INTENTS.items()}


def intent(query: Column) -> Column:
    """struct(intent, confidence, filters): the intent with most pattern hits (first one on ties), hits / 3 up to 1; general 0.5 without hits."""
    scores = intent_scores(query)
    best = F.greatest(*scores.values())
    name = F.when(best == 0, "general")
    for k, s in scores.items():
        name = name.when(s == best, k)
    filters = F.create_map(*[x for k, v in FILTERS.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))])
    return F.struct(name.alias("intent"), F.when(best == 0, 0.5).otherwise(F.round(F.least(best / 3, F.lit(1.0)), 3)).alias("confidence"), filters[name].alias("filters"))


def _named(query: Column, table: dict[str, list[str]]) -> Column:
    q = F.lower(query)
    hits = [F.when(reduce(lambda a, b: a | b, [q.contains(p) for p in v]), k) for k, v in table.items()]
    return F.array_compact(F.array(*hits))


def entities(query: Column) -> Column:
    return F.struct(_named(query, TECHNOLOGIES).alias("technologies"), _named(query, LEVELS).alias("levels"), _named(query, CONTENT).alias("content_types"))


def expansions(query: Column) -> Column:
    """All alternatives of the terms a query holds, in table order, without repeats."""
    q = F.lower(query)
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.when(q.contains(k), F.array(*[F.lit(x) for x in v])).otherwise(none) for k, v in EXPANSIONS.items()]))


def enhanced(query: Column) -> Column:
    """The query with its first three expansions as alternatives."""
    found = F.slice(expansions(query), 1, 3)
    clause = F.array_join(F.transform(found, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR ")
    return F.when(F.size(found) == 0, F.trim(query)).otherwise(F.concat(F.trim(query), F.lit(" OR ("), clause, F.lit(")")))


def suggestions(query: Column) -> Column:
    q = F.lower(query)
    has = lambda *words: reduce(lambda a, b: a | b, [q.contains(w) for w in words])
    add = lambda cond, text: F.when(cond, text)
    how, bad, tech = has("how", "tutorial", "guide"), has("error", "fix", "problem"), has("python", "javascript", "react", "vue")
    parts = [add(how, F.concat(query, F.lit(" for beginners"))), add(how, F.concat(query, F.lit(" step by step"))), add(bad, F.concat(F.lit("solve "), query)), add(bad, F.concat(F.lit("debug "), query)), add(tech, F.concat(query, F.lit(" best practices"))), add(tech, F.concat(query, F.lit(" examples")))]
    return F.slice(F.array_compact(F.array(*parts)), 1, 5)


def corrections(query: Column) -> Column:
    """original:suggestion for each misspelled word, in order."""
    table = F.create_map(*[F.lit(x) for kv in SPELLING.items() for x in kv])
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: table[w].isNotNull())
    return F.transform(words, lambda w: F.concat(w, F.lit(":"), table[w]))


def phrases(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit('"([^"]*)"'), 1)


def acronyms(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit(r"\b[A-Z]{2,}\b"), 0)


def confidence(query: Column) -> Column:
    e, c = F.size(expansions(query)), F.size(corrections(query))
    return F.least(F.round(0.5 + F.least(e * 0.1, F.lit(0.3)) + F.least(c * 0.2, F.lit(0.2)), 3), F.lit(1.0))


def valid(query: Column) -> Column:
    """Not empty, at most 500 characters, one letter or digit at least."""
    return F.coalesce((F.length(query) <= 500) & query.rlike("[a-zA-Z0-9]"), F.lit(False))
