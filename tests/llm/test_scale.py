"""What must not depend on size: templates of a host among many others, the ways of joining and bucketing, bounds of the packing."""

import random

import numpy as np
from pyspark.sql import functions as F

from gleanery.llm import neardup, packing, repeated_lines
from gleanery.llm.boilerplate import label
from gleanery.llm.pages import Page, distinct_pages, parse, template_keys, template_table
from gleanery.llm.residue import _NOTICE, _SPLIT, _sentences_of, has_notice, residue_pages
from gleanery.llm.truncation import truncated


def prose(rng, n):
    words = "river garden engine letter market window doctor forest camera bridge planet winter copper saddle lantern meadow".split()
    return " ".join(rng.choice(words) for _ in range(n)) + "."


def pages(hosts, each, seed, notice=None):
    rng, rows = random.Random(seed), []
    for h in range(hosts):
        for i in range(each):
            core = "".join(f"<p>The {prose(rng, 14)}</p>\n" for _ in range(4))
            own = f"<div class='n'>\n<p>{notice}</p>\n<p>Write to the desk</p>\n</div>\n" if notice else ""
            rows.append((seed * 100000 + h * 100 + i, f"https://h{seed}x{h}.example/{i}", f"<html><body>\n<div class='main'>\n<h1>On {prose(rng, 3)}</h1>\n{core}{own}</div>\n</body></html>"))
    return rows


def gone(spark, rows, ids, **how):
    parsed = parse(spark.createDataFrame(rows, "page_id bigint, url string, content string"), "page_id", "url", "content").cache()
    return {r.rec_id: tuple(r.boiler) for r in label(parsed, template_keys(parsed), **how).where(F.col("rec_id").isin(ids)).collect()}


def test_other_hosts_hide_no_template(spark):
    own = pages(1, 8, 1, "This house is kept by friends of the old harbour.")
    ids = [r[0] for r in own]
    alone, among = gone(spark, own, ids), gone(spark, own + pages(100, 8, 2), ids)
    assert alone == among and all(len(x) == 2 for x in alone.values())


def test_joined_templates_equal_broadcast_ones(spark):
    rows = pages(2, 8, 3, "This house is kept by friends of the old harbour.") + pages(3, 4, 4)
    ids = [r[0] for r in rows]
    assert gone(spark, rows, ids) == gone(spark, rows, ids, broadcast_rows=0)


def test_copies_count_once(spark):
    one = pages(1, 1, 5)[0][2]
    rows = [(i, f"https://{'abc'[i % 3]}.example/{i}", one.replace("On ", f"On {'x' * i} ")) for i in range(1, 13)]
    parsed = parse(spark.createDataFrame(rows, "page_id bigint, url string, content string"), "page_id", "url", "content")
    got = distinct_pages(parsed).collect()
    assert len(got) == 3 and sum(r.everywhere for r in got) == 1


def test_subtrees():
    p = Page("<body><ul><li>a\n<li>b\n</ul><div><div>c\nd</div></div>\n<p>e</p></body>")
    assert [t for _, t, *_ in p.lines] == ["a", "b", "cd"[0], "d", "e"] and (0, 2) in p.blocks and (2, 4) in p.blocks


def test_buckets_change_no_candidate(spark):
    rng = random.Random(6)
    base = [prose(rng, 60).split() for _ in range(6)]
    texts = []
    for w in base:
        for _ in range(20):
            v = list(w)
            for _ in range(4):
                v[rng.randrange(len(v))] = f"e{rng.random()}"
            texts.append(" ".join(v))
    df = spark.createDataFrame(list(enumerate(texts)), "rec_id bigint, text string")
    signed = neardup.sign(df, "rec_id", "text").cache()
    heads = signed.withColumnRenamed("rec_id", "class_id")
    found = [{tuple(r) for r in neardup.candidates(heads, n).collect()} for n in (1, 8, 1000)]
    assert found[0] == found[1] == found[2] and found[0]
    links = [{(r.class_a, r.class_b) for r in neardup.class_pairs(signed, df, deviations=z)[1].collect()} for z in (4.0, None)]
    assert links[0] == links[1]


def test_program_places_most_items_within_its_bound():
    rng = np.random.default_rng(7)
    h = np.bincount(np.clip(rng.lognormal(4, 0.8, 6000).astype(int), 1, 511), minlength=513)[1:513]
    plan, left, bound = packing.program(h)
    assert (sum(c * n for c, n in plan) + left == h).all() and left.sum() < 0.5 * h.sum()
    full = packing.solve(h)
    assert bound <= sum(n for _, n in full) <= 1.01 * bound + 2


def test_an_end_that_is_frequent_inside_only(spark):
    rng = random.Random(8)
    nouns = "river garden engine letter market window doctor forest".split()
    line = lambda: f"The keeper of the {rng.choice(nouns)} saw a {rng.choice(nouns)} near the bridge"
    rows = [(i, "s", f"{line()}.\n{line()}.\n{line()}.") for i in range(60)] + [(100 + i, "s", f"{line()}.\n{line()}.\nKind regards from Ann") for i in range(20)]
    rows += [(200, "s", f"{line()}.\nThe keeper of the"), (201, "s", f"{line()}.\nThe keeper of the gar"), (202, "s", f"{line()}.\n" + "x" * 5000 + " " + line() + "."), (203, "s", f"{line()}.\nKind regards from")]
    got = {r.doc_id for r in truncated(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).where("cut_off").collect()}
    assert {200, 201} <= got and not got & ({202} | set(range(60)) | set(range(100, 120)))


def test_removed_lines_leave_the_rest_in_order(spark):
    chunks = spark.createDataFrame([("a", "x\ny\nx", 1), ("b", "x", 2), ("c", None, 3), ("d", "z", 4)], "chunk_id string, text_chunk string, line_no int")
    flagged = spark.createDataFrame([("a", 0), ("a", 2), ("a", 2), ("b", 0)], "chunk_id string, line_no bigint")
    assert {r.chunk_id: r.text_chunk for r in repeated_lines.remove_lines(chunks, flagged).collect()} == {"a": "y", "b": "", "c": None, "d": "z"}


def test_ratios_decide_in_their_own_queries_only(spark, tmp_path, monkeypatch):
    chunks = [(f"c{i}", f"d{i}", 0, "Common to all\n" + ("Kept by the harbour" if i < 30 else f"line {chr(97 + i % 26)}{chr(97 + i // 26)}")) for i in range(300)]
    spark.createDataFrame(chunks, "chunk_id string, document_id string, chunk_index int, text_chunk string").write.parquet(f"{tmp_path}/doc_chunks.parquet")
    spark.createDataFrame([(f"d{i}", f"https://s{i // 30}.example/{i}") for i in range(300)], "document_id string, url string").write.parquet(f"{tmp_path}/site_docs.parquet")
    got = {(r.chunk_id, r.line_no) for r in repeated_lines.QUERIES["p7_peculiar"](spark, str(tmp_path)).collect()}
    assert got == {(f"c{i}", 1) for i in range(30)}
    clean = {r.chunk_id: r.text_chunk for r in repeated_lines.QUERIES["p7_peculiar_clean"](spark, str(tmp_path)).collect()}
    assert clean["c0"] == "Common to all" and clean["c30"] == chunks[30][3]
    monkeypatch.setattr(repeated_lines, "log_likelihood_ratio", None)  # p7_found computes nothing that its rows don't need
    found = {(r.chunk_id, r.line_no) for r in repeated_lines.p7_found(spark, str(tmp_path)).collect()}
    assert found == got | {(f"c{i}", 0) for i in range(300)}


def test_bodies_are_signed_while_labelled_and_in_groups(spark):
    rng = random.Random(9)
    texts = [prose(rng, rng.choice([2, 30, 50, 400])) for _ in range(60)] + ["", None, " ".join(["same"] * 50), prose(rng, 40_000)]
    together, alone = neardup.Signing(min_words=1)(texts), [neardup.Signing(min_words=1)([t]) for t in texts]
    assert [c.to_pylist() for c in together] == [[x[k][0].as_py() for x in alone] for k in range(4)]
    signer = neardup.Signer()
    words = texts[3].lower().rstrip(".").split()
    runs = signer.shingles(words)
    low = (runs[:, None] * signer.multiply + signer.add).min(0)
    assert together[2][3].as_py() == (low >> np.uint64(24)).astype(np.uint16).view(np.int16).tolist() and together[0][3].as_py() == neardup._whole(runs)
    rows = pages(2, 8, 10, "This house is kept by friends of the old harbour.") + [(1, "https://h10x0.example/x", "<html><body>\n<h1>Page not found</h1>\n</body></html>")]
    parsed = parse(spark.createDataFrame(rows, "page_id bigint, url string, content string"), "page_id", "url", "content").cache()
    found = template_keys(parsed).cache()
    labelled = label(parsed, found, then=neardup._BodySigning()).cache()
    plain = neardup.sign(label(parsed, found).select("rec_id", F.array_join("body", "\n").alias("text")), "rec_id", "text")
    columns = ["rec_id", *neardup.SIGNED_COLUMNS]
    assert sorted(labelled.where("same is not null").select(columns).collect()) == sorted(plain.select(columns).collect())
    assert {r.page_id for r in residue_pages(labelled).collect()} == {1}


def test_counts_of_hosts_are_computed_once(spark):
    columns = "h bigint, key bigint, type string, n bigint, wide bigint, out_n bigint, head_n bigint, item_n bigint, plain_n bigint, size bigint, wide_size bigint"
    rows = [(1, 10, "a", 8, 8, 0, 0, 0, 0, 10, 10), (2, 10, "a", 1, 1, 0, 0, 0, 0, 90, 90), (1, 11, "s", 3, 3, 0, 0, 0, 0, 10, 10), (2, 11, "s", 3, 3, 0, 0, 0, 0, 90, 90)]
    rows += [(0, 12, "a", 4, 4, 0, 0, 0, 0, 4, 4), (1, 13, "a", 3, 3, 0, 0, 0, 0, 10, 10), (3, 14, "a", 3, 3, 0, 0, 0, 0, 4, 4), (3, 15, "l", 6, 6, 6, 0, 0, 0, 6, 6), (3, 16, "a", 6, 6, 0, 6, 0, 0, 6, 6)]
    found = template_table(spark.createDataFrame(rows, columns))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(10, None, "B"), (10, 1, "B"), (11, 1, "S"), (14, 3, "B"), (15, None, "B"), (16, None, "H")], key=str)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_ways_without_patterns_equal_the_patterns():
    rng = random.Random(11)
    odd = ["Not Found", "ОШИБКА", "ΑΣ’ΑΣ", "İx", "ſ", "\u212a", "µ", "ß", "²", "LOG IN", "Não Encontrad", "не найдЁн", "…", "“a”", "\xa0", "_", "7.", "x!", "—", "’", "/", "|", ".", ",", "sorry"]
    texts = ["", *(rng.choice([" ", "\n", ""]).join(rng.choice(odd) for _ in range(rng.randrange(1, 9))) for _ in range(5000))]
    for text in texts:
        assert neardup.words_of(text) == neardup._WORD.findall(text.lower())
        assert has_notice(text) == bool(_NOTICE.search(text))
    for _ in range(5000):
        core = [line for line in (" ".join("".join(rng.choice(texts)).split()) for _ in range(rng.randrange(1, 4))) if line]
        assert [p for p in _sentences_of("\n".join(core), core) if p] == [p for x in core for p in _SPLIT.split(x) if p]
