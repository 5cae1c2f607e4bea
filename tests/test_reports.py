"""Chunk noise, batch search over postings and the reference order of metadata on small fixtures."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanery.functions import html as H
from gleanery.functions.extract import extract_page
from gleanery.operators import batch
from gleanery.operators import search as S
from gleanery.plans.reports import is_noise
from gleanery.session import cut


def written(spark):
    """Records that stages have written so far, to shuffles and files, by stage."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() + s.outputRecords() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages)}


def test_noise_of_chunks(spark):
    cases = {
        "The river rose over night and nobody in the village had expected it.": False,
        "a &nbsp; b in an otherwise plain sentence of several words": True,
        ".hlist li of a style sheet": True,
        "Retrieved from somewhere else in this plain sentence": True,
        "show hide options template": True,
        "[1] [2] [3] [4] [5] [6] and some plain words that follow them here in the text": True,
        "click here or read more": True,
        "ABCDE FGHIJ": True,
        "": False,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("noise", is_noise(F.col("t"))).collect()
    assert {r.t: r.noise for r in rows} == cases


def test_batch_search_equals_brute_force(spark):
    texts = {1: "red fox and red dog", 2: "blue fox", 3: None, 4: "", 5: "red", 6: "dog dog dog fox", 7: "blue fox"}
    queries = {1: "red fox", 2: "fox FOX", 3: "unknown", 4: "", 5: None}
    docs = spark.createDataFrame(list(texts.items()), "id int, text string")
    asked = spark.createDataFrame(list(queries.items()), "query_id int, query string")
    got = {(r.query_id, r.id): (r.score, r.place) for r in S.search_postings(S.postings(docs, "id", "text"), docs, "id", asked, 3).collect()}
    words = {k: (v or "").lower().split() for k, v in texts.items()}
    mean, want = sum(map(len, words.values())) / len(words), {}
    for q, text in queries.items():
        scores = {}
        for k, w in words.items():
            for t in set((text or "").lower().split()):
                df, tf = sum(t in x for x in words.values()), Counter(w)[t]
                if tf:
                    scores[k] = scores.get(k, 0) + math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
        for place, (k, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:3], 1):
            want[q, k] = (round(s, 6), place)
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 2e-6 and got[k][1] == want[k][1] for k in want)
    none = docs.limit(0)
    assert S.search_postings(S.postings(none, "id", "text"), none, "id", asked, 3).count() == 0


@pytest.mark.parametrize("rare", [0, 3, 30, 1000])
@pytest.mark.parametrize("sets", [4, 200_000])
def test_batch_search_by_blocks_equals_all_pairs(spark, rare, sets, monkeypatch):
    """Many queries over many documents with ties, against a join of all pairs; rare and frequent terms, several passes and small slices."""
    monkeypatch.setattr(batch, "PAIRS", 5)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["été", "x1"]
    text = lambda n: " ".join(words[min(int(rng.expovariate(0.15)), 41)] for _ in range(n))
    docs = spark.createDataFrame([(f"d{i:03}", None if i % 50 == 7 else text(rng.choice([0, 3, 3, 6, 40]))) for i in range(300)], "id string, text string").repartition(3)
    asked = spark.createDataFrame([(i, text(rng.choice([0, 1, 2, 3, 3, 5]))) for i in range(60)] + [(99, "unknown w1"), (98, "w1 W1")], "query_id int, query string")
    stored = cut(S.document_postings(docs, "id", "text"))
    got = {tuple(r) for r in S.search_postings(stored, docs, "id", asked, 4, sets, rare).collect()}
    docs.select("id", S.tokens(F.col("text")).alias("w")).createOrReplaceTempView("batch_t")
    asked.select("query_id", F.explode(S.tokens(F.col("query"))).alias("term")).distinct().createOrReplaceTempView("batch_q")
    want = spark.sql("""WITH s AS (SELECT count(*) AS n, avg(size(w)) AS mean FROM batch_t), e AS (SELECT id, size(w) AS length, explode(w) AS term FROM batch_t), p AS (SELECT term, id, count(*) AS tf, max(length) AS length FROM e GROUP BY term, id),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term), r AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score FROM batch_q JOIN p USING (term) JOIN f USING (term) CROSS JOIN s GROUP BY query_id, id)
SELECT query_id, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM r) WHERE place <= 4""").collect()
    assert got == {tuple(r) for r in want} and len(got) > 100


@pytest.mark.parametrize("index", ["postings", "document_postings"])
def test_batch_search_shuffles_no_hits(spark, index):
    """200 queries that all documents answer: 400,000 hits, of which only the best of each task may be written by a shuffle or a cut."""
    docs = spark.range(2000).select(F.col("id"), F.concat_ws(" ", F.lit("the of is"), F.repeat(F.lit("the "), (F.col("id") % 50).cast("int")), F.concat(F.lit("n"), F.col("id"))).alias("text")).repartition(4)
    asked = spark.range(200).select(F.col("id").alias("query_id"), F.concat(F.lit("the of n"), F.col("id")).alias("query"))
    stored = cut(getattr(S, index)(docs, "id", "text"))
    before = written(spark)
    got = S.search_postings(stored, docs, "id", asked, 10)
    assert got.count() == 2000
    assert sum(n for stage, n in written(spark).items() if stage not in before) < 50_000


def test_postings_by_document(spark):
    rows = [(1, "b a B é2"), (2, None), (3, " - "), (4, "a")]
    docs = spark.createDataFrame(rows, "id int, text string")
    plain = lambda df: sorted((r.id, r.length, sorted(zip(r.terms, r.tfs))) for r in df.collect())
    assert plain(S.document_postings(docs, "id", "text")) == [(1, 4, [("a", 1), ("b", 2), ("é2", 1)]), (4, 1, [("a", 1)])]
    twice = docs.union(spark.createDataFrame([(4, "a c c")], docs.schema))
    assert plain(S.document_postings(twice, "id", "text")) == plain(S.gathered_postings(S.postings(twice, "id", "text"), "id"))
    assert plain(S.document_postings(docs.limit(0), "id", "text")) == []


def test_the_first_name_present_decides(spark):
    page = '<title>T</title><h1>H</h1><meta property="og:title" content=" "><meta name="twitter:title" content="TW"><meta name="description" content="about">'
    r = spark.createDataFrame([(page,), ("<h1>H</h1>",), (None,)], "c string").select(H.title(F.col("c")).alias("t"), H.description(F.col("c")).alias("d")).collect()
    assert [(x.t, x.d) for x in r] == [(None, "about"), ("H", None), (None, None)]


def test_metadata_order():
    page = '<meta name="author" content="B"><meta property="article:author" content="A"><meta name="lastmod" content="2024-01-02"><meta name="datePublished" content="2024-01-01"><div class="story-content">A paragraph that is certainly long enough to be counted as main text.</div><figure>A caption that is long enough to count but is no main text at all.</figure>'
    x = extract_page(page, "https://a/")
    assert (x["author_name"], x["published_date"], x["modified_date"]) == ("A", "2024-01-01", "2024-01-02")
    assert x["main_content"] == "A paragraph that is certainly long enough to be counted as main text."
    ld = '<script type="application/ld+json">[{"publisher": {"name": "P"}}, {"author": "Q"}]</script>'
    assert extract_page(ld, "")["author_name"] == "P"
