"""Parsing, template counts, boilerplate and residue on hand-made sites."""

from pyspark.sql import functions as F

from gleanery.llm.boilerplate import label
from gleanery.llm.pages import Page, Templates, host_main_paths, line_keys, parse, template_keys
from gleanery.llm.residue import describe, residue_pages, template_of

WORDS = "river garden engine letter market window doctor forest camera bridge planet winter".split()


def body(n):
    a, b, c = WORDS[n % 12], WORDS[(n * 5 + 1) % 12], WORDS[(n * 7 + 3) % 12]
    return [f"The {a} of item {n} carried a {b} over the {c} without any trouble at all.", f"Nobody had expected that {b} number {n * 13} would follow the {a}, and {c} remained calm.", f"Later the {c} of the {a} was measured {n} times, which nobody in the whole {b} could explain before the evening came."]


def page(n, host, core=None):
    lines = ["<html><head><title>t</title><script>var x = 1;</script></head><body>", '<div class="menu">', "<li><a href='/a'>Home</a></li>", "<li><a href='/b'>News</a></li>", "</div>", '<div class="main">']
    lines += core or [f"<h1>Heading {WORDS[n % 12]} {n}</h1>", *[f"<p>{x}</p>" for x in body(n)], "<p>Share &middot; Save</p>"]
    lines += ["</div>", "<!-- hidden", "text -->", '<div class="foot">', f"<p>&copy; {host}</p>", "</div></body></html>"]
    return "\n".join(lines)


def site(spark, extra=()):
    rows = [(n, f"https://www.s{n % 2}.example/p{n}", page(n, f"s{n % 2}")) for n in range(1, 41)]
    return spark.createDataFrame(rows + list(extra), "page_id bigint, url string, content string")


def labelled(spark, df):
    parsed = parse(df, "page_id", "url", "content").cache()
    return label(parsed, Templates(template_keys(parsed).collect())).cache()


def test_line_numbers_and_visibility():
    p = Page("a &amp; b\n<script>\nx\n</script><p>c</p>\n<!-- \n -->\n<style>y</style>\n<noscript>\nz</noscript> d\n")
    assert [(no, text) for no, text, *_ in p.lines] == [(0, "a & b"), (3, "c"), (8, "d")]
    assert Page("").lines == [] and Page("<<<>>> <b").lines


def test_boilerplate_goes_and_body_stays(spark):
    odd = [(90, "https://s1.example/x", None), (91, "https://s1.example/y", "  "), (92, None, "plain text only, no markup at all here."), (93, "https://s0.example/z", "<p>" + "word " * 50000 + "</p>")]
    df = site(spark, odd)
    got = {r.rec_id: r for r in labelled(spark, df).collect()}
    content = {r.page_id: r.content for r in df.collect()}
    assert set(got) == set(range(1, 41)) | {92, 93}
    for n in range(1, 41):
        lines = content[n].split("\n")
        gone = {lines[i] for i in got[n].boiler}
        assert {"<li><a href='/a'>Home</a></li>", "<li><a href='/b'>News</a></li>", "<p>Share &middot; Save</p>", f"<p>&copy; s{n % 2}</p>"} <= gone
        assert list(got[n].body)[1:] == body(n)


def test_repeats_and_empty_input(spark):
    df = site(spark)
    assert labelled(spark, df.limit(0)).count() == 0
    assert host_main_paths(parse(df.limit(0), "page_id", "url", "content")).count() == 0
    extra = df.withColumn("rec_id", F.lit(7)).withColumn("host", F.lit("clash"))
    assert parse(extra, "page_id", "url", "content").select("rec_id").distinct().count() == 40


def test_copied_pages_are_no_templates(spark):
    copies = [(100 + n, f"https://c{n}.example/", page(3, "c")) for n in range(30)]
    got = {r.rec_id: list(r.body) for r in labelled(spark, site(spark, copies)).collect()}
    assert all(body(3)[0] in got[100 + n] for n in range(30))


def test_a_site_has_templates_of_its_own(spark):
    notice = "<p>This site is kept by volunteers of the harbour museum and lives on your gifts.</p>"
    core = lambda n, *more: [f"<h1>Heading {WORDS[n % 12]} {n}</h1>", *[f"<p>{x}</p>" for x in body(n)], *more]
    own = [(300 + n, "https://tail.example/", page(n, "tail", core(n, notice))) for n in range(4)]
    copies = [(400 + n, "https://copy.example/", page(5, "copy", core(5, "<p>Our harbour shop sends all of its ropes and sails by post.</p>"))) for n in range(4)]
    df = site(spark, own + copies)
    got = {r.rec_id: list(r.body) for r in labelled(spark, df).collect()}
    assert all(got[300 + n][1:] == body(n) for n in range(4))
    assert all(got[400 + n][1:4] == body(5) and len(got[400 + n]) == 5 for n in range(4))  # one page in four copies shows nothing
    texts = spark.createDataFrame([(n, f"https://{'tail' if n < 4 else 'copy'}.example/", "\n".join([*body(n if n < 4 else 5), notice[3:-4]])) for n in range(8)], "rec_id bigint, url string, text string")
    parsed = parse(texts, "rec_id", "url", "text", markup=False)
    got = {r.rec_id: list(r.body) for r in label(parsed, Templates([]), texts.selectExpr("rec_id", "CAST(NULL AS STRING) AS title")).collect()}
    assert all(got[n] == body(n) for n in range(4)) and all(len(got[n]) == 4 for n in range(4, 8))


def test_keys_mask_names_digits_and_the_site():
    a = line_keys("Edited by Anna Smith for Acme, 12 min", "acme")
    assert a[1] == line_keys("Edited by Bert Jones for ACME, 7 min", "acme")[1] or a[0] == line_keys("Edited by Bert Jones for ACME, 7 min", "acme")[0]
    assert line_keys("x", "")[1:] == (0, 0)


def test_residue(spark):
    error = lambda n: [f"<h1>{['Whoops', 'Page not found', 'Sorry'][n % 3]}</h1>", "<p>The page you asked for has moved or was removed.</p>", "<p>Share &middot; Save</p>"]
    cases = [(200 + n, f"https://s{n % 2}.example/e{n}", page(n, f"s{n % 2}", error(n))) for n in range(6)]
    cases += [(210, "https://s1.example/t", page(1, "s1", ["<h1>{{title}}</h1>", "<p>The %noun% of [INSERT DATE] was ${adjective} and more words.</p>"])), (211, "https://s1.example/l", page(1, "s1", ["<p>Lorem ipsum dolor sit amet lorem dolor.</p>"])), (212, "https://s1.example/u", page(1, "s1", ["<h1>undefined</h1>", "<p>undefined null</p>"]))]
    real = [(220, "https://s0.example/r", page(2, "s0", ["<h1>Why error 404 pages matter</h1>", *[f"<p>{x}</p>" for n in range(3) for x in body(n)], "<p>Write {{ title }} in the theme file.</p>"]))]
    got = {r.page_id for r in residue_pages(labelled(spark, site(spark, cases + real))).collect()}
    assert got == {200, 201, 202, 203, 204, 205, 210, 211, 212}
    assert residue_pages(labelled(spark, site(spark).limit(0))).count() == 0


def test_slots_of_a_recurring_template_are_none_of_a_quotation(spark):
    unfilled = [(500 + n, f"https://s{n % 2}.example/w", page(n, f"s{n % 2}", ["<h1>Welcome</h1>", "<p>We greet you in {{city}} and wish you a good stay.</p>"])) for n in range(6)]
    quotes = ["<p>Write {{ title }} in the theme file.</p>", "<p>Then put {{ author }} below the first line.</p>"]
    texts = [(520 + n, f"https://s{n % 2}.example/q", page(n, f"s{n % 2}", [f"<h1>Themes {n}</h1>", *[f"<p>{x}</p>" for k in (n, n + 5) for x in body(k)], *quotes])) for n in range(3)]
    got = {r.page_id for r in residue_pages(labelled(spark, site(spark, unfilled + texts))).collect()}
    assert got == set(range(500, 506))


def test_a_site_of_short_pages_hides_no_message_of_others(spark):
    lost = [(600 + n, f"https://s{n % 2}.example/l", page(n, f"s{n % 2}", [f"<h1>{WORDS[n].title()}</h1>", "<p>An otter ate this leaf of our book.</p>"])) for n in range(6)]
    short = [(700 + n, "https://short.example/", page(n, "short", [f"<h1>{WORDS[n % 12].title()} bread</h1>", f"<p>Bake {n} loaves for the {WORDS[n % 7]} in an hour.</p>"])) for n in range(40)]
    got = {r.page_id for r in residue_pages(labelled(spark, site(spark, lost + short))).collect()}
    assert got == set(range(600, 606))


def test_describe():
    words, text_words, sentences, slots, empty, dummy = describe([], [])
    assert (words, text_words, sentences, slots, empty, dummy) == (0, 0, [], [], 0, False)
    assert template_of("") == 0 and template_of("Hello 12 World") == template_of("hello 7 Moon")
    assert len(describe(["{{a}} and %b_c% or @@d@@"], [])[3]) == 3
