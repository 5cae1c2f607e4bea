"""Capping, near-duplicates, repeated lines, tokens, packing and truncation against brute force on small fixtures."""

import base64
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import capping, neardup, packing, repeated_lines, tokens, truncation


def test_matching_equals_greedy_by_quality(spark):
    rng = random.Random(5)
    records = {i: (rng.choice([None, float("nan"), 0.5, 0.5, 0.9, rng.random()]), sorted({rng.choice("hhhhabcd") for _ in range(rng.randint(1, 3))})) for i in range(160)}
    rows = [(f"r{i:03}", c, q, "clash") for i, (q, cs) in records.items() for c in cs] * 2
    df = spark.createDataFrame(rows, "record_id string, contributor string, quality double, rank string").repartition(3)
    got = {r.record_id: r.kept for r in capping.suitor_matching(df, 12).collect()}
    value = lambda q: -1.0 if q is None or q != q else q
    free, want = dict.fromkeys("habcd", 12), {}
    for i, (q, cs) in sorted(records.items(), key=lambda x: (-value(x[1][0]), f"r{x[0]:03}")):
        want[f"r{i:03}"] = all(free[c] > 0 for c in cs)
        if want[f"r{i:03}"]:
            for c in cs:
                free[c] -= 1
    assert got == want


def test_matching_edges(spark):
    schema = "record_id string, contributor string, quality double"
    assert capping.suitor_matching(spark.createDataFrame([], schema), 2).count() == 0
    rows = [("a", None, 0.1), ("b", None, 0.2), ("c", None, 0.3), ("d", "x", None), ("e", "x", None), ("f", "x", 0.0)]
    got = {r.record_id: r.kept for r in capping.suitor_matching(spark.createDataFrame(rows, schema), 1, single=True).collect()}
    assert got == {"a": True, "b": True, "c": True, "d": False, "e": False, "f": True}


def jaccard(a, b, width=3):
    grams = lambda t: {tuple(w[i : i + width]) for w in [re.findall(r"\w+", t.lower())] for i in range(len(w) - width + 1)}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_near_duplicates(spark):
    rng = random.Random(6)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 4) for _ in range(120)] for _ in range(25)]
    texts = []
    for words in base:
        for edits in (0, 0, 3, 12, 40):
            w = list(words)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"e{rng.random()}"
            texts.append(" ".join(w))
    texts += ["short text", "", None, texts[0].upper() + "!!"]
    df = spark.createDataFrame(list(enumerate(texts)), "rec_id bigint, text string")
    members, links = neardup.class_pairs(neardup.sign(df, "rec_id", "text"), df)
    cls = {r.rec_id: r.class_id for r in members.collect()}
    assert set(cls) == set(range(125)) | {128} and cls[128] == cls[1] == 0
    linked = {(r.class_a, r.class_b): r.similarity for r in links.collect()}
    want = {(i, j) for i in set(cls.values()) for j in set(cls.values()) if i < j and jaccard(texts[i], texts[j]) >= 0.5}
    assert set(linked) <= want and len(linked) >= 0.97 * len(want)
    assert all(abs(s - jaccard(texts[a], texts[b])) < 1e-9 for (a, b), s in linked.items())
    none = df.limit(0)
    assert [x.count() for x in neardup.class_pairs(neardup.sign(none, "rec_id", "text"), none)] == [0, 0]


def test_repeated_lines(spark):
    chunks = [(f"c{i}", f"d{i % 9}", f"Share  THIS {i} times\nunique {chr(97 + i)} line\n\n42\n" + ("only here" if i < 4 else "Other words")) for i in range(18)] + [("n", "d0", None), ("e", "d1", ""), ("u", "dx", "share this times")]
    docs = [(f"d{i}", f"https://www.s{i % 2}.example/{i}") for i in range(9)]
    c = spark.createDataFrame(chunks * 2, "chunk_id string, document_id string, text_chunk string").withColumn("source", F.lit("clash"))
    d = spark.createDataFrame(docs, "document_id string, url string")
    lines = repeated_lines.chunk_lines(c, d)
    flagged = repeated_lines.flag_lines(lines, repeated_lines.repeated_keys(lines, 4))
    got = {(r.chunk_id, r.line_no) for r in flagged.collect()}
    key = lambda s: re.sub(r"\s+", " ", re.sub(r"\d", "", s.lower())).strip()
    site, uses = {k: v.split("/")[2] for k, v in docs}, {}
    for _, doc, text in chunks:
        for line in (text or "").split("\n"):
            if key(line):
                uses.setdefault((site.get(doc), key(line)), set()).add(doc)
    want = {(cid, n) for cid, doc, text in chunks if text is not None for n, line in enumerate(text.split("\n")) if key(line) and len(uses[site.get(doc), key(line)]) >= 4}
    assert got == want and got
    clean = {r.chunk_id: r.text_chunk for r in repeated_lines.remove_lines(spark.createDataFrame(chunks, "chunk_id string, document_id string, text_chunk string"), flagged).collect()}
    assert clean["n"] is None and clean["e"] == "" and clean["c0"] == "unique a line\n\n42\nonly here"
    empty = repeated_lines.chunk_lines(c.limit(0), d)
    assert repeated_lines.flag_lines(empty, repeated_lines.repeated_keys(empty)).count() == 0


def test_log_likelihood_ratio(spark):
    df = spark.createDataFrame([(50.0, 100.0, 5.0, 1000.0), (5.0, 100.0, 50.0, 1000.0), (0.0, 10.0, 0.0, 10.0), (3.0, 3.0, 0.0, 0.0)], "a double, b double, c double, d double")
    g = [r.g for r in df.select(repeated_lines.log_likelihood_ratio(*map(F.col, "abcd")).alias("g")).collect()]
    p1, p2, p = 0.5, 0.005, 55 / 1100
    want = 2 * sum(k * np.log(a / b) for k, a, b in ((50, p1, p), (50, 1 - p1, 1 - p), (5, p2, p), (995, 1 - p2, 1 - p)))
    assert g[0] == pytest.approx(want) and g[1:] == [0.0, 0.0, 0.0]
    p = spark.range(1).select(repeated_lines.tail(F.lit(3.841459)).alias("p")).first().p
    assert p == pytest.approx(0.05, abs=1e-5)


def test_tokens_are_those_of_the_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tokens.encoder(tokens.ranks_path())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.ranks_path(), "rb"))}
    public = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    parts = ["the", "ing", " ", "\n", "é", "漢", "😀", "12", "don't", "﻿", "...", "ab", "   ", "\t", "Q", "<|endoftext|>", "‍"]
    texts = ["", None, " ", "a" * 20000, "hello world"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, "")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = tokens.encode(df, "doc_id", "text").collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r.ids == public.encode_ordinary(texts[r.doc_id] or "")
        assert public.decode(r.ids) == (texts[r.doc_id] or "")
    assert {r.doc_id: r.tokens for r in tokens.count_tokens(df, "doc_id", "text").collect()} == {r.doc_id: len(r.ids) for r in got}
    vocabulary = list(ranks)
    for _ in range(3000):
        piece = b"".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 4)))
        assert list(enc.encode(piece)) == public._encode_single_piece(piece)
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


def test_packing(spark):
    rng = random.Random(8)
    sizes = [rng.choice([0, None, 1, 7, 50, 64, 65, 200]) if rng.random() < 0.3 else rng.randint(1, 60) for _ in range(900)] + [33] * 400
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, tokens int").withColumn("size", F.lit("clash"))
    rows = packing.pack(df, "doc_id", "tokens", 64).collect()
    load, pieces = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        assert (r.container_id is None) == (r.length == 0)
        if r.length:
            load[r.container_id] = load.get(r.container_id, 0) + r.length
    assert set(pieces) == set(range(len(sizes))) and max(load.values()) <= 64 and set(load) == set(range(len(load)))
    for i, s in enumerate(sizes):
        own = sorted(pieces[i], key=lambda r: r.piece_no)
        assert sum(r.length for r in own) == (s or 0) and (len(own) == 1 or s > 64)
        assert [r.start for r in own] == [64 * k for k in range(len(own))]
    alone = sum(1 for r in rows if r.length > 32)
    assert len(load) <= 1.02 * max(sum(s or 0 for s in sizes) / 64, alone) + 2
    assert packing.pack(df.limit(0), "doc_id", "tokens", 64).count() == 0


def test_plan_covers_the_histogram():
    rng = np.random.default_rng(9)
    for _ in range(5):
        h = rng.integers(0, 30, 40) * (rng.random(40) < 0.5)
        plan = packing.solve(h.astype(np.int64), rounds=30)
        assert (sum((c * n for c, n in plan), np.zeros(40, np.int64)) == h).all()
        assert all((c * np.arange(1, 41)).sum() <= 40 for c, _ in plan)


def test_truncation(spark):
    rng = random.Random(10)
    nouns, verbs = "river garden engine letter market window doctor forest".split(), "carried followed watched moved built saw".split()
    sentence = lambda: f"The {rng.choice(nouns)} of the {rng.choice(nouns)} {rng.choice(verbs)} a {rng.choice(nouns)} over the bridge."
    rows, cut = [], set()
    for i in range(300):
        text = "\n".join(" ".join(sentence() for _ in range(3)) for _ in range(2)) + rng.choice(["", "\nPosted from my phone", "\n- one item (two)"])
        if i % 10 == 0:
            text, cut = text[: text.index(".", 150) + 16] + rng.choice(["", " [...]", "…"]), cut | {i}
        rows.append((i, "s", text))
    rows += [(1000, "s", None), (1001, None, ""), (1002, "s", " \n"), (1003, "s", "😀"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("open", F.lit("clash"))
    got = {r.doc_id: r.cut_off for r in truncation.truncated(df).collect()}
    assert len(got) == 304 and not any(got[i] for i in range(1000, 1004))
    found = {i for i, x in got.items() if x}
    assert found == cut
    assert truncation.truncated(df.limit(0)).count() == 0
