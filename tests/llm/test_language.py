"""Context trees against brute force, held-out accuracy, and the label and edge cases of language identification."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from gleanery.llm import language as L
from gleanery.llm.ppm import ContextTrees, fold

TEXTS = {"en": ["the cat sat on the mat", "a dog and the cat"], "de": ["die Katze saß auf der Matte", "ein Hund und die Katze"]}


def brute_bits(samples, text, order):
    counts = defaultdict(lambda: defaultdict(int))
    data = b"\0" * order + b"".join(fold(t) for t in samples)
    for i in range(order, len(data)):
        for k in range(order + 1):
            counts[data[i - k : i]][data[i]] += 1
    coded, bits = b"\0" * order + fold(text), 0.0
    for i in range(order, len(coded)):
        excluded = set()
        for k in range(order, -1, -1):
            seen = counts.get(coded[i - k : i])
            if not seen:
                continue
            rest = {s: n for s, n in seen.items() if s not in excluded}
            total, kinds = sum(rest.values()), len(rest)
            if coded[i] in rest:
                bits += np.log2(total + kinds) - np.log2(rest[coded[i]])
                break
            if kinds:
                bits += np.log2(total + kinds) - np.log2(kinds)
            excluded = set(seen)
        else:
            bits += np.log2(256 - len(excluded))
    return bits


def test_code_lengths_are_exact():
    for order in (0, 2, 5):
        trees = ContextTrees(TEXTS, order)
        lines = ["the dog sat", "", "die Katze", "x" * 300, "ñ 漢字 12", "the dog sat"]
        got = trees.line_costs(lines, block=16)
        for i, line in enumerate(lines):
            for j, lang in enumerate(trees.languages):
                assert abs(got[i, j] - brute_bits(TEXTS[lang], line, order)) < 1e-2


def test_held_out_accuracy(spark, small):
    rows = spark.read.parquet(f"{small}/lang_samples.parquet").collect()
    train, held = defaultdict(list), []
    for r in rows:
        (held.append((r.lang, r.sample_text)) if r.sample_id % 4 == 0 else train[r.lang].append(r.sample_text))
    trees = ContextTrees(train)
    best = trees.line_costs([t for _, t in held]).argmin(1)
    assert np.mean([trees.languages[b] == lang for b, (lang, _) in zip(best, held)]) >= 0.99


def test_label_spellings(spark):
    cases = {"en": "en", "EN": "en", "eng": "en", "English": "en", "en_GB": "en", "pt-BR": "pt", "русский": "ru", "Nederlands": "nl", "ger": "de", "es-MX": "es", "xx": None, "??": None, "": None, " ": None, "auto": None, "n/a": None, None: None, " fr ": "fr"}
    rows = spark.createDataFrame([(k,) for k in cases], "label string").select("label", L.language_of(F.col("label")).alias("code")).collect()
    assert {r.label: r.code for r in rows} == cases


def test_identify_mixed_and_empty(spark, small):
    trees = L.train(spark.read.parquet(f"{small}/lang_samples.parquet"))
    en = "The quiet festival explained the careful report, although nobody had copied the old garden during the trial."
    de = "Die Universität vergleicht den Vertrag, weil das Museum den Garten im Laufe der Woche beschreibt und ordnet."
    rows = [(1, [0, 2, 5], [en, de, en], None), (2, [], [], ["en"]), (3, [0], ["12345"], None), (4, [0], ["def f(x): return x;"], []), (None, [0], [de], None), (5, [0, 1], [de * 300, de], ["fr"])]
    df = spark.createDataFrame(rows, "rec_id bigint, body_no array<int>, body array<string>, whitelist array<string>")
    got = {r.rec_id: r for r in L.identify(df, trees).collect()}
    assert got[1].main == "en" and [(x.line_no, x.lang, x.foreign) for x in got[1].lines] == [(0, "en", False), (2, "de", True), (5, "en", False)]
    assert got[2].main is None and got[2].lines == []
    assert got[None].main == "de" and got[5].main == "de" and len(got[3].lines) == len(got[4].lines) == 1
    assert all(0 <= x.confidence <= 1 for r in got.values() for x in r.lines)
    assert L.identify(df.limit(0), trees).count() == 0


def test_whitelists(spark):
    df = spark.createDataFrame([("www.A.example", ["EN", "français", "??"]), ("b.example", []), ("c.example", None)], "domain string, language_whitelist array<string>")
    assert {(r.host, tuple(r.whitelist)) for r in L.whitelists(df).collect()} == {("a.example", ("en", "fr"))}
