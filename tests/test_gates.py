"""Language gates and summaries on fixed cases."""

from pyspark.sql import functions as F

from gleanery.functions import gates as G


def test_url_language(spark):
    cases = {"https://en.x.example/": "en", "https://de.x.com/": "non-en", "https://github.io/de/": "en", "https://x.example/en/a": "en", "https://x.example/fr/a": "non-en", "https://x.org/": "en", "https://x.example/": None, "": None, None: None, "https://x.co.uk:80/": "en"}
    rows = spark.createDataFrame([(k,) for k in cases], "u string").select("u", G.language_of_url(F.col("u")).alias("l")).collect()
    assert {r.u: r.l for r in rows} == cases


def test_language_info(spark):
    rows = [(1, '<html lang="DE-at">x', "https://x.example/"), (2, "der Hund und die Katze ist nicht mit den Vögeln", "https://x.example/"), (3, "zzz qqq", "https://x.example/"), (4, "x", "https://a.com/"), (5, None, "https://a.com/")]
    got = {r.i: r.x for r in spark.createDataFrame(rows, "i int, t string, u string").select("i", G.language_info(F.col("t"), F.col("u")).alias("x")).collect()}
    assert [(got[i].language, got[i].confidence) for i in range(1, 6)] == [("de", 0.8), ("de", 0.8), (None, 0.0), ("en", 0.95), (None, 0.0)]


def test_summary(spark):
    rows = [(1, "First", "a.example"), (2, "Second", "b.example"), (3, "Third", "a.example")]
    df = spark.createDataFrame(rows, "rank int, title string, site string")
    assert G.template_summary(df, "q").first().summary == "Found 3 relevant results for 'q'. Results span multiple sources including a.example, b.example. Top result: 'First'."
    assert G.template_summary(df.limit(0), "q").first().summary == "No results found."
    short = G.template_summary(df, "q", 50).first().summary
    assert len(short) <= 53 and short.endswith("...")
