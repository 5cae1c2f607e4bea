"""Operators against brute force on small fixtures."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gleanery.functions import query as I
from gleanery.functions import text as T
from gleanery.functions import url as U
from gleanery.operators.crawl import longest_runs, robots_decision, robots_rules
from gleanery.operators.ranking import distributed_row_number
from gleanery.operators.search import diversify, phrase_count
from gleanery.operators.similarity import similar_sets
from gleanery.session import build_session


def test_row_number_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randint(0, 5), i, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, id int, rank_ string").repartition(5)
    got = {r.id: r["rank"] for r in distributed_row_number(df, ["g"], [F.col("v").desc(), F.col("id").asc()]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = n
    assert got == want
    assert distributed_row_number(df.limit(0), ["g"], [F.col("id").asc()]).count() == 0


def brute_chunks(text, most, least):
    if text is None:
        return []
    size = lambda s: len(s.encode())
    if size(text) <= most:
        return [text] if size(text) >= least else []

    def pack(pieces):
        out, cur = [], ""
        for p in pieces:
            if size(cur) + size(p) + 1 > most:
                if size(cur) >= least:
                    out.append(cur.strip(" "))
                cur = p
            else:
                cur = f"{cur} {p}" if cur else p
        if size(cur) >= least:
            out.append(cur.strip(" "))
        return out

    return pack([s if s.endswith(".") else s + "." for s in text.split(". ")]) or pack(text.split())


def test_sentence_chunks(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9)))
    texts = [None, "", "short", "x" * 500, ". ".join(" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(40))]
    texts += [". ".join(" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 20))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.sentence_chunks(F.col("t"), 120, 20).alias("c"))
    got = {r.i: r.c for r in df.collect()}
    assert got == {i: brute_chunks(t, 120, 20) for i, t in enumerate(texts)}


def test_similar_sets(spark):
    rng = random.Random(3)
    sets = [(i, sorted(set(rng.choices("abcdefghijkl", k=rng.randint(1, 9))))) for i in range(150)] + [(150, []), (151, None)]
    got = {(r.a, r.b) for r in similar_sets(spark.createDataFrame(sets, "i int, s array<string>"), "i", "s", 0.6).collect()}
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(i, j) for i, a in sets[:150] for j, b in sets[:150] if i < j and jac(a, b) >= 0.6}
    assert got == want


def test_longest_runs_across_days(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b"]), 86400 * (n // 9) + n, n, rng.choice(["ok", "timeout", "timeout", "timeout", None])) for n in range(400)]
    df = spark.createDataFrame(rows, "g string, t bigint, id int, o string").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.g: r.longest for r in longest_runs(df, "g", ["ts", "id"], F.col("o") == "timeout", F.col("o").isNull(), F.to_date("ts")).collect()}
    for g in "ab":
        best = run = 0
        for r in sorted((r for r in rows if r[0] == g and r[3]), key=lambda r: r[1:3]):
            run = run + 1 if r[3] == "timeout" else 0
            best = max(best, run)
        assert got[g] == best


def test_robots(spark):
    robots = spark.createDataFrame([("a", "User-agent: x\nDisallow: /x\nUser-agent: *\r\nDisallow: /p # c\nAllow: /p/q\nDisallow:\n"), ("b", "User-agent: z\nDisallow: /\n"), ("c", None)], "domain string, content string")
    rules = robots_rules(robots)
    assert {(r.domain, r.allow, r.rule) for r in rules.collect()} == {("a", False, "/p"), ("a", True, "/p/q")}
    urls = spark.createDataFrame([(1, "a", "/p/q/1"), (2, "a", "/p/z"), (3, "a", "/"), (4, "d", "/"), (5, None, "/")], "i int, d string, path string")
    assert {r.i: r.verdict for r in robots_decision(urls, rules, "d", "path").collect()} == {1: "allowed", 2: "disallowed", 3: "allowed", 4: "deferred", 5: "deferred"}


def test_intents_named_by_the_scenarios(spark):
    q = [("python import error modulenotfound fix", "troubleshooting"), ("react hooks tutorial step by step", "tutorial"), ("python pandas api reference", "reference")]
    df = spark.createDataFrame(q, "q string, want string").select("want", I.intent(F.col("q")).alias("i"))
    assert all(r.want == r.i.intent for r in df.collect())
    r = spark.createDataFrame([("how to fix javascript error in react",)], "q string").select(I.intent(F.col("q")).alias("i")).first().i
    assert r.confidence == pytest.approx(0.667)


def test_url_normalisation_is_idempotent(spark):
    urls = ["HTTP://A.B/x//y/?utm_source=1&q=2#f", "a.b/c", "https://x.example", "https://x.example/", "", None, "http://h/p?ref", "http://H/p/?a=1&ref=2"]
    once = spark.createDataFrame([(u,) for u in urls], "u string").select(U.normalize(F.col("u")).alias("n"))
    rows = once.select("n", U.normalize(F.col("n")).alias("m")).collect()
    assert [r.n for r in rows] == ["http://a.b/x/y/?q=2", "http://a.b/c", "https://x.example", "https://x.example/", "", "", "http://h/p", "http://h/p/?a=1"]
    assert all(r.n == r.m for r in rows)


def test_clean_text_leaves_plain_text(spark):
    plain = "One plain sentence. Another one, with numbers 12."
    assert spark.createDataFrame([(plain,)], "t string").select(T.clean_text(F.col("t")).alias("c")).first().c == plain


def test_diversity_cap_and_refill(spark):
    rows = [(n, "a" if n <= 6 else "b" if n == 7 else "c") for n in range(1, 10)]
    got = [(r["rank"], r.g) for r in diversify(spark.createDataFrame(rows, "rank int, g string"), "g", "rank", 6).orderBy("place").collect()]
    assert got == [(1, "a"), (2, "a"), (7, "b"), (8, "c"), (9, "c"), (3, "a")]


def test_phrase_count(spark):
    texts = ["quick fox quick fox. Quick", "Quick\nFOX", "fox quick", None]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(phrase_count(F.col("t"), "quick fox").alias("n")).collect()]
    assert got == [len(re.findall("quick[^a-z]+fox", (t or "").lower())) for t in texts]


def test_session_keeps_the_shared_checkpoint_folder(spark):
    assert build_session("x").conf.get("spark.checkpoint.dir").startswith("file:")
