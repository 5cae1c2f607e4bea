"""Full page extraction by an element tree: one Arrow-batched pass gives all metadata, main text and headings of a page as one struct."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where the main text is looked for, in this order (tag, attribute, value).
MAIN_PLACES = [
    ("main", "", ""), ("article", "", ""), ("", "class", "content"), ("", "class", "post-content"), ("", "class", "entry-content"), ("", "id", "content"),
    ("", "class", "article-body"), ("", "class", "post-body"), ("", "class", "article-text"), ("", "role", "main"), ("", "class", "main-content"),
    ("", "class", "page-content"), ("", "class", "content-wrapper"), ("", "class", "story-content"), ("", "class", "article-wrapper"), ("", "class", "text-content"),
]
# Elements without main text, and parts of class and id names that mark noise.
SKIPPED = frozenset("script style noscript nav header footer aside menu menuitem figure figcaption button input select textarea form iframe".split())
NOISE = ("nav", "menu", "sidebar", "footer", "header", "ad", "popup", "banner")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MIN_NODE, MIN_MAIN, MAX_HEADING, MAX_KEYWORDS = 20, 50, 200, 15

EXTRACTED = (
    "title string, description string, keywords array<string>, content_type string, primary_image string, favicon string, published_date string, modified_date string, author_name string, "
    "canonical_url string, main_content string, headings array<struct<level:int,text:string>>, error string"
)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ("#", {}, [])
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        node = (tag, {k: v or "" for k, v in attrs}, [])
        self.stack[-1][2].append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1][2].append((tag, {k: v or "" for k, v in attrs}, []))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def walk(node):
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        if not isinstance(n, str):
            stack.extend(reversed(n[2]))


def whole_text(node) -> str:
    return "".join(n for n in walk(node) if isinstance(n, str)).strip()


def node_text(node) -> str:
    """Text of a subtree without skipped elements and noisy names, of text nodes over 20 bytes, joined by spaces."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            t = re.sub(r"\s+", " ", n).strip()
            if len(t.encode()) > MIN_NODE:
                out.append(t)
        elif n[0] not in SKIPPED and not any(x in (n[1].get("class", "") + " " + n[1].get("id", "")).lower() for x in NOISE):
            stack.extend(reversed(n[2]))
    return " ".join(out)


def _matches(node, place) -> bool:
    tag, attribute, value = place
    if isinstance(node, str) or (tag and node[0] != tag):
        return False
    held = node[1].get(attribute, "") if attribute else ""
    return not attribute or (value in held.split() if attribute == "class" else held == value)


def main_text(root) -> str:
    """Texts over 50 bytes of the first element of each place, nested ones repeated; without any the body's, then the page's."""
    found = []
    for place in MAIN_PLACES:
        node = next((n for n in walk(root) if _matches(n, place)), None)
        if node is not None and len((text := node_text(node)).encode()) > MIN_MAIN:
            found.append(text)
    if found:
        return " ".join(found)
    body = next((n for n in walk(root) if not isinstance(n, str) and n[0] == "body"), root)
    return node_text(body)


def _json_blocks(nodes) -> list[dict]:
    out = []
    for n in nodes:
        if n[0] == "script" and n[1].get("type", "").lower() == "application/ld+json":
            try:
                data = json.loads(whole_text(n))
            except ValueError:
                continue
            out += [x for x in (data if isinstance(data, list) else [data]) if isinstance(x, dict)]
    return out


def _name(value) -> str | None:
    if isinstance(value, list):
        value = value[0] if value else None
    if isinstance(value, dict):
        value = value.get("name") or value.get("url")
    return value if isinstance(value, str) and value.strip() else None


def extract_page(content: str, url: str) -> dict:
    """All fields of EXTRACTED for one page; a page that can't be parsed gives an error and nulls."""
    tree = _Tree()
    tree.feed(content)
    nodes = [n for n in walk(tree.root) if not isinstance(n, str)]
    meta: dict[str, str] = {}
    for n in nodes:
        if n[0] == "meta" and (key := n[1].get("property") or n[1].get("name")):
            meta.setdefault(key.lower(), n[1].get("content", ""))
    first = lambda *names: next((meta[k].strip() or None for k in names if k in meta), None)
    element = lambda tag: next((t for n in nodes if n[0] == tag and (t := whole_text(n))), None)
    data = _json_blocks(nodes)
    linked = lambda key: next((v for d in data if (v := _name(d.get(key)))), None)
    tags = [n[1]["content"] for n in nodes if n[0] == "meta" and n[1].get("property") == "article:tag" and n[1].get("content")]
    keywords = list(dict.fromkeys(k for k in (x.strip() for x in (tags or meta.get("keywords", "").split(","))) if len(k) >= 3))[:MAX_KEYWORDS]
    icon = next((n[1].get("href") for n in nodes if n[0] == "link" and "icon" in n[1].get("rel", "").lower().split()), None)
    canonical = next((n[1].get("href") for n in nodes if n[0] == "link" and n[1].get("rel", "").lower() == "canonical"), None)
    image = linked("image") or first("og:image") or next((s for n in nodes if n[0] == "img" and (s := n[1].get("src")) and not re.search("icon|logo", s, re.I)), None)
    stamp = next((n[1]["datetime"] for n in nodes if n[0] == "time" and n[1].get("datetime")), None)
    title = first("og:title", "twitter:title") or element("title") or element("h1")
    kind = next((d["@type"].lower() for d in data if isinstance(d.get("@type"), str)), None)
    by_block = next((v for d in data for key in ("author", "publisher") if (v := _name(d.get(key)))), None)
    by_class = next((t for n in nodes if re.search(r"\b(?:author|byline)\b", n[1].get("class", "")) and (t := whole_text(n)) and len(t) < 100), None)
    heads = sorted(((int(n[0][1]), i, whole_text(n)) for i, n in enumerate(nodes) if re.fullmatch("h[1-6]", n[0])), key=lambda x: x[:2])
    return {
        "title": title, "description": first("og:description", "twitter:description", "description"), "keywords": keywords, "content_type": kind, "primary_image": image, "favicon": icon,
        "published_date": first("article:published_time", "datepublished", "date") or linked("datePublished") or stamp, "modified_date": first("article:modified_time", "datemodified", "lastmod") or linked("dateModified"),
        "author_name": first("article:author", "author") or by_block or by_class, "canonical_url": canonical if canonical and canonical != url else None, "main_content": main_text(tree.root),
        "headings": [{"level": n, "text": t} for n, _, t in heads if t and len(t.encode()) < MAX_HEADING], "error": None,
    }


def _batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kinds = {"keywords": pa.list_(pa.string()), "headings": pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string())]))}
    names = [x.split(" ")[0] for x in re.sub(r"<[^()]*?>(?=,|$)", "", EXTRACTED).split(", ")]
    for batch in batches:
        rows = []
        for url, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            try:
                rows.append(extract_page(content or "", url or ""))
            except Exception as e:  # noqa: BLE001 - a broken page must not end the job; it is reported in its row
                rows.append(dict.fromkeys(names) | {"error": f"{type(e).__name__}: {e}"[:200]})
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names]], ["key", *names])


def extract(pages: DataFrame, key: str, url: str, content: str) -> DataFrame:
    """key and the fields of EXTRACTED for every row of pages; null contents give empty main text and nulls."""
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(content).alias("content")).mapInArrow(_batches, f"key {kind}, {EXTRACTED}").withColumnRenamed("key", key)


def unescape(text: str) -> str:
    return entities.unescape(text)
