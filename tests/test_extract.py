"""Golden cases of the page extraction."""

from gleanery.functions.extract import extract, extract_page

PAGE = """<html><head><title>Title</title><meta property="og:title" content="OG"><meta name="twitter:title" content="TW"><meta property="og:description" content="  ">
<meta name="description" content="about"><meta property="article:tag" content="alpha"><meta property="article:tag" content="be"><meta property="article:tag" content="alpha">
<script type="application/ld+json">[{"@type": "NewsArticle", "author": [{"name": "Ann"}], "image": {"url": "i.png"}, "dateModified": "2024-02-02"}]</script>
<link rel="shortcut icon" href="/f.ico"><link rel="canonical" href="https://a/other"></head><body><nav>menu that is long enough to count</nav><h2>Second</h2><h1>First</h1>
<main><article><p>A paragraph that is certainly long enough to be counted as main text.</p><p class="shadow">dropped because of a part of its class name, as long as it may be</p><p>exactly 20 bytes txt</p></article></main>
<time datetime="2024-01-01">x</time></body></html>"""


def test_fields():
    x = extract_page(PAGE, "https://a/this")
    assert (x["title"], x["description"], x["keywords"], x["content_type"], x["primary_image"], x["favicon"]) == ("OG", None, ["alpha"], "newsarticle", "i.png", "/f.ico")
    assert (x["published_date"], x["modified_date"], x["author_name"], x["canonical_url"]) == ("2024-01-01", "2024-02-02", "Ann", "https://a/other")
    one = "A paragraph that is certainly long enough to be counted as main text."
    assert x["main_content"] == f"{one} {one}"
    assert [(h["level"], h["text"]) for h in x["headings"]] == [(1, "First"), (2, "Second")]


def test_fallbacks_and_edges(spark):
    rows = [(1, "u", "<body><p>No place for main text here, but a body that is long enough.</p></body>"), (2, "u", None), (3, None, ""), (4, "u", "<h3>" + "x" * 200 + "</h3><div><b>unclosed"), (5, "u", "<p>" * 3000 + "deep text that is long enough to be kept")]
    got = {r.id: r for r in extract(spark.createDataFrame(rows, "id int, u string, c string"), "id", "u", "c").collect()}
    assert got[1].main_content.startswith("No place") and got[2].main_content == "" and got[3].title is None and got[4].headings == [] and got[5].error is None
    assert extract_page("<title>T</title><h1>H</h1>", "")["title"] == "T" and extract_page("<h1>H</h1>", "")["title"] == "H"
