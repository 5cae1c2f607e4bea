"""Readers, sinks and streams on small files."""

import json

from pyspark.sql import functions as F

from gleanery.operators.crawl import recrawl_schedule
from gleanery.sources import readers as R
from gleanery.sources import sinks as K
from gleanery.streaming import ingest, state


def page(**x):
    return json.dumps({"url": "https://a.example/page", "domain": "a.example", "content": "text", **x})


def test_read_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    lines = [page(), page(url=None), page(url="ftp://x"), page(url="http://a.b"), page(content=" "), "{broken", "", page(domain="", url="https://www.B.example/p")]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "sub" / "b.json").write_text("[" + page(url="https://c.example/1") + "," + page(url="https://c.example/2") + "]")
    pages = R.read_pages(spark, str(tmp_path)).cache()
    s = R.read_statistics(pages).first().asDict()
    assert s == {"rows": 9, "good": 4, "not_json": 1, "missing_url": 1, "bad_url": 2, "empty_content": 1, "files": 2}
    good = R.valid_pages(pages)
    assert {(r.url, r.domain) for r in good.collect()} >= {("https://www.B.example/p", "b.example"), ("https://c.example/1", "a.example")}
    files = spark.createDataFrame([("x",), ("y",)], "path string")
    assert [r.path for r in R.new_files(files, spark.createDataFrame([("x",)], "path string")).collect()] == ["y"]


def test_lists_and_configuration(spark, tmp_path):
    (tmp_path / "seeds.json").write_text('["https://a", "https://b"]')
    assert [r.value for r in R.read_string_array(spark, str(tmp_path / "seeds.json")).collect()] == ["https://a", "https://b"]
    (tmp_path / "feeds.json").write_text('[{"url": "u1", "priority": 9}, {"url": "u2"}, {"url": "u3", "priority": 8, "poll_interval": 1}]')
    assert {r.url: r.interval_minutes for r in R.read_feeds(spark, str(tmp_path / "feeds.json")).collect()} == {"u1": 5, "u2": 30, "u3": 10}
    (tmp_path / "feeds.txt").write_text("# c\nhttps://f 7\n\nhttps://g # x\nhttps://h soon\n")
    assert {r.url: r.interval_minutes for r in R.read_feeds(spark, str(tmp_path / "feeds.txt")).collect()} == {"https://f": 7, "https://g": 10, "https://h": 10}
    (tmp_path / "d.json").write_text('{"a": {"crawl_frequency": {"interval": "2d"}, "language_whitelist": ["en"], "enabled": false}, "b": {"crawl_frequency": {"interval": "30m"}}, "c": {}}')
    got = {r.domain: (r.interval_hours, r.enabled, r.language_whitelist) for r in R.read_domain_config(spark, str(tmp_path / "d.json")).collect()}
    assert got == {"a": (48.0, False, ["en"]), "b": (0.5, True, []), "c": (24.0, True, [])}
    text = spark.createDataFrame([('{"u": "https://x/y", /* a\nb */ "n": 1} // end',)], "t string").select(R.strip_comments(F.col("t")).alias("t")).first().t
    assert json.loads(text) == {"u": "https://x/y", "n": 1}


def test_feeds_and_sitemaps(spark):
    rss = "<rss><channel><title>x</title><item><title>T1</title><link>https://a/1</link><description>D</description><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item><item><title>none</title></item></channel></rss>"
    got = R.parse_rss(spark.createDataFrame([(1, rss), (2, None), (3, "broken <item>")], "id int, xml string")).collect()
    assert [(r.id, r.link, r.title, r.description) for r in got] == [(1, "https://a/1", "T1", "D")]
    atom = '<feed><entry><title>A</title><link rel="self" href="s"/><link rel="alternate" href="https://a/2"/><content>C</content><published>2024</published></entry></feed>'
    got = R.parse_atom(spark.createDataFrame([(1, atom)], "id int, xml string")).collect()
    assert [(r.link, r.description, r.published) for r in got] == [("https://a/2", "C", "2024")]
    index = spark.createDataFrame([("<sitemapindex><sitemap><loc> https://s/1.xml </loc></sitemap><sitemap><loc>https://s/2.xml</loc></sitemap></sitemapindex>",)], "xml string")
    assert [r.sitemap for r in R.parse_sitemap_index(index).collect()] == ["https://s/1.xml", "https://s/2.xml"]
    urls = spark.createDataFrame([("<urlset><url><loc>u1</loc><priority>7</priority></url><url><loc>u2</loc><changefreq>Daily</changefreq></url><url><priority>1</priority></url></urlset>",)], "xml string")
    assert {r.url: r.priority for r in R.parse_sitemap(urls).collect()} == {"u1": 1.0, "u2": 0.8}


def test_headers(spark):
    raw = "HTTP/1.1 200 OK\r\nETag: \"1\"\r\nContent-Type: a\r\nLast-Modified: Mon, 01 Jan 2024 00:00:00 GMT\r\netag: \"2\"\r\n"
    m = spark.createDataFrame([(raw,)], "t string").select(R.parse_headers(F.col("t")).alias("m")).first().m
    assert m == {"etag": '"2"', "content-type": "a", "last-modified": "Mon, 01 Jan 2024 00:00:00 GMT"}


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "t") for i in range(25)], "document_id string, title string").coalesce(1)
    chunks = spark.createDataFrame([("c1", "d1", "x")], "chunk_id string, document_id string, text_chunk string")
    K.write_tagged(docs, chunks, str(tmp_path / "t"), part=10)
    back = spark.read.json(str(tmp_path / "t"))
    assert back.groupBy("type").count().orderBy("type").collect()[1]["count"] == 25
    assert len(list((tmp_path / "t").glob("part-*"))) >= 3
    rows = spark.createDataFrame([(1, "a", 1, "2024-01-01"), (2, "a", 1, "2024-01-02"), (1, "b", 2, "2024-01-01"), (9, "n", 1, None)], "id int, v string, at int, day string")
    table = str(tmp_path / "table")
    K.upsert(spark, rows, table, ["id"], [F.desc("at")], "day")
    K.upsert(spark, spark.createDataFrame([(1, "c", 3, "2024-01-01"), (3, "z", 1, "2024-01-01")], rows.schema), table, ["id"], [F.desc("at")], "day")
    assert {(r.id, r.v) for r in spark.read.parquet(table).collect()} == {(1, "c"), (2, "a"), (3, "z")}
    assert [r.day for r in K.expired(rows.select("day").distinct().where("day IS NOT NULL"), "day", "2024-04-01").collect()] == ["2024-01-01"]
    urls = spark.createDataFrame([("u1", 0.5), ("u2", 0.9)], "url string, priority double")
    K.append_queue(urls, str(tmp_path / "q"))
    assert [r.url for r in K.load_queue(spark, str(tmp_path / "q"), 1).collect()] == ["u2"]
    m = spark.createDataFrame([("a b c d",), ("",), (None,)], "t string").select(K.message_stream(F.col("t")).alias("m")).collect()
    assert [r.m for r in m] == [["a b c", "d"], [], None]


def test_state_stream_equals_batch(spark, tmp_path):
    rows = [(f"u{i % 3}", 1000 * i * 60 % 700000 + i, "same" if i % 3 == 0 else f"h{i % 2}") for i in range(40)]
    history = spark.createDataFrame(rows, "url string, t double, h string") if False else spark.createDataFrame([(u, float(t), h) for u, t, h in rows], "url string, t double, h string")
    history.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(history.schema).parquet(str(tmp_path / "in"))
    out = []
    q = state.crawl_state(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, n: out.extend(df.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = recrawl_schedule(history.withColumn("ts", F.timestamp_seconds("t")), "url", "ts", "h").select("url", "crawls", "backoff", F.unix_timestamp("next_crawl").alias("next")).collect()
    assert {(r.url, r.crawls, r.backoff, int(r.next_crawl)) for r in out} == {(r.url, r.crawls, r.backoff, r.next) for r in batch}


def test_first_seen_stream(spark, small):
    s = ingest.table_stream(spark, small, "raw_pages").select("url", "received_at")
    got = ingest.run_to_table(ingest.first_seen(s, "url", "received_at", "3650 days"), "t").count()
    assert got == spark.read.parquet(f"{small}/raw_pages.parquet").select("url").distinct().count()
