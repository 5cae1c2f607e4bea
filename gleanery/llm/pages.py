"""Pages and extracted texts as lines with their place in the element tree, and the templates of sites.

The steps that problems 1, 2, 3 and 5 share:

1. `parse` (one Python pass): every page becomes its visible lines; each line has the path of its container, the kind of element it
   stands in and hashed keys (text with digits, site name and proper names masked). Every element that holds several lines is a
   subtree with a hash of its lines' keys; a line is the smallest subtree.
2. `host_main_paths`: containers counted per host; the container that holds the main text on most pages of a host.
3. `host_counts`: subtree hashes counted per host over its distinct pages. Of pages that are copies of each other one counts.
4. `template_table`: the subtrees that recur on a host's pages, and the lines that recur on the hosts that have them, pooled over those hosts:
   a small host's lines are known from other hosts that use the same. Neither depends on how many other hosts the corpus has.
5. `Templates` / `known_by_record`: how the verdicts reach the lines: by broadcast as long as their number, which is checked, allows it,
   else by joins of (record, hash) with the verdicts.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.sites import site_of
from gleanery.session import cut

#: A line is a template if it stands on so many distinct pages, and if its repeats on the hosts that have it are so many and this share of their pages.
MIN_PAGES, MIN_AGAIN, MIN_RATE = 5, 3, 0.001
#: Forms of headings and list items, and lines that stand outside main containers, are known from so many distinct pages by their places.
FORM_PAGES = 5
#: A site's own line template stands on at least so many distinct pages of the host, and on this share of them; its own subtrees of several lines likewise.
HOST_PAGES, HOST_SHARE, BLOCK_SHARE = 3, 0.5, 0.05
#: Lines of so many characters tell copies of a page, as short ones may be templates.
SIGNED_LENGTH = 60
#: Up to so many verdicts (17 bytes each) are sent to all tasks; beyond, they are joined.
BROADCAST_ROWS = 500_000

# Groups: what is skipped, (its tag,) a tag's slash, name and attributes, text.
_TOKEN = re.compile(r"(<!--.*?(?:-->|\Z)|<(script|style|noscript|head|template)\b[^>]*>.*?(?:</\2\s*>|\Z))|<(/?)([a-zA-Z][\w-]*)([^>]*)>|(<[!?][^>]*>)|([^<]+|<)", re.S | re.I)
#: Contents up to so many characters are taken apart in one go, longer ones token by token.
_WHOLE = 1 << 20
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SECTION = frozenset("html body div main article section aside nav header footer form table tbody thead tr td th ul ol dl".split())
_HEADING = frozenset(("h1", "h2", "h3"))
_CODE = frozenset(("pre", "code", "blockquote", "textarea"))
_SPACE = re.compile(r"\s+")
SENTENCE_END = re.compile(r"[.!?…。](?=[\"'»”)\]]*(?:\s|$))")
WORD = re.compile(r"\w+")
_DIGITS = re.compile(r"\d+")
_UPPER = r"A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĪİŁŃŇŌŐŒŘŚŞŠŤŪŮŰŹŻŽΑ-ΩЀ-Я"
_NAME = re.compile(rf"[{_UPPER}](?<![\w'’].)[\w'’\-]*")  # a capital first, then the look behind: so the scan skips to capitals
_LABEL = re.compile(r"^([^:|–—]{2,40}?)\s*(?:[:|–—])\s")
_FIRST = re.compile(r"[\w'’\-]+")
_MARK = re.compile(r"[^C0@\W]|[0@|:·•,.()–—\-/#&+↑↓°%<>›»]")


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def line_keys(text: str, brand: str) -> tuple[int, int, int]:
    """Keys of a line: (proper names masked but the first word, all names masked, its leading label). 0: no such key.

    brand: the site's own name in lower case, masked wherever it stands.
    """
    return _short_line_keys(text, brand) if len(text) <= 120 else _line_keys(text, brand)


def _line_keys(text: str, brand: str) -> tuple[int, int, int]:
    if brand and brand in text.lower():
        text = _brand_pattern(brand).sub("@", text)
    low = _DIGITS.sub("0", text)
    m = _FIRST.match(low)
    cut = m.end() if m else 1  # the first word stays as it is
    a = low[:cut] + _NAME.sub("C", low[cut:])
    b = _NAME.sub("C", a[:cut]) + a[cut:]
    key_a = _hash(a.lower())
    key_b = _hash("b:" + b) if b != a and _MARK.search(b) else 0
    label = _LABEL.match(a) if ":" in a or "|" in a or "–" in a or "—" in a else None
    key_l = _hash("l:" + label.group(1).lower()) if label and label.group(1).count(" ") < 4 else 0
    return key_a, key_b, key_l


_short_line_keys = lru_cache(1 << 16)(_line_keys)


@lru_cache(4096)
def _brand_pattern(brand: str) -> re.Pattern:
    return re.compile(rf"(?i)\b{re.escape(brand)}\b")


@lru_cache(65536)
def brand_of(host: str) -> str:
    """The name a site calls itself by: the longest label of its host but the last."""
    return max((host or "").lower().split(".")[:-1], key=len, default="")


class Page:
    """Visible lines of one page: text, line number, container path, kind of element, share of linked characters."""

    __slots__ = ("blocks", "lines", "main", "paths")

    def __init__(self, content: str):
        parent, tags, path_of, section = [-1], ["#"], [0], [0]
        self.paths: list[str] = ["#"]
        known, up_path = {"#": 0}, [0]
        stack, line, linked = [0], 0, 0
        found: dict[int, list] = {}
        tokens = _TOKEN.findall(content) if len(content) <= _WHOLE else (m.groups("") for m in _TOKEN.finditer(content))
        for skipped, _, closing, tag, attrs, mark, text in tokens:
            if text:
                if text.isspace():
                    line += text.count("\n")
                    continue
                for k, piece in enumerate(text.split("\n") if "\n" in text else (text,)):
                    line += k > 0
                    if piece and not piece.isspace():
                        shown = html.unescape(piece) if "&" in piece else piece
                        if shown is piece or not shown.isspace():
                            if line in found:
                                e = found[line]
                                e[0] += shown
                                e[1] += len(shown) if linked else 0
                            else:
                                found[line] = [shown, len(shown) if linked else 0, stack[-1]]
                continue
            if tag:
                tag = tag.lower()
                if closing:
                    if tags[stack[-1]] == tag and len(stack) > 1:
                        stack.pop()
                    else:
                        for k in range(len(stack) - 1, 0, -1):
                            if tags[stack[k]] == tag:
                                del stack[k:]
                                break
                    if tag == "a" and linked:
                        linked -= 1
                elif tag not in _VOID and not attrs.endswith("/"):
                    if tag in ("li", "p", "tr") and tags[stack[-1]] == tag:
                        stack.pop()
                    up = stack[-1]
                    parent.append(up)
                    tags.append(tag)
                    if tag in _SECTION:
                        path = self.paths[path_of[up]] + ">" + tag + (_SPACE.sub(" ", attrs) if attrs else "")
                        if path not in known:
                            known[path] = len(self.paths)
                            self.paths.append(path)
                            up_path.append(path_of[up])
                        path_of.append(known[path])
                        section.append(len(section))
                    else:
                        path_of.append(path_of[up])
                        section.append(section[up])
                    stack.append(len(tags) - 1)
                    linked += tag == "a"
                if attrs:
                    line += attrs.count("\n")
            else:
                line += (skipped or mark).count("\n")
        self.lines = []
        own = [0.0] * len(self.paths)
        spans: dict[int, list[int]] = {}
        for no, (text, link, node) in found.items():
            text = " ".join(text.split())
            if not text:
                continue
            kind, k, top = "P", node, False
            while k > 0 and (t := tags[k]) not in _SECTION:
                if t in _HEADING:
                    kind, top = "H", top or t == "h1"
                elif t in _CODE:
                    kind = "C"
                elif t == "li" and kind == "P":
                    kind = "L"
                k = parent[k]
            size = len(text)
            share = 1.0 if link >= size else link / size
            path = path_of[node]
            at = len(self.lines)
            self.lines.append((no, text, path, kind, share))
            span = spans.get(section[node])
            if span is None:
                spans[section[node]] = [at, at + 1]
            else:
                span[1] = at + 1
            if top:
                own[path] += 300.0
            if share < 0.5 and size > 20 and text.count(" ") >= 4 and SENTENCE_END.search(text):
                own[path] += size * (1 - share)
        # Weight of each path with all that it holds; a path that several blocks share (paragraphs in div) is no container of its own.
        blocks, weight = [0] * len(self.paths), own[:]
        for n in range(1, len(tags)):
            if tags[n] in _SECTION:
                blocks[path_of[n]] += 1
        inner: list[list[int]] = [[] for _ in self.paths]
        for j in range(len(self.paths) - 1, 0, -1):
            weight[up_path[j]] += weight[j]
            inner[up_path[j]].append(j)
        best = 0
        while weight[best] > 0:
            heavy = max(inner[best], key=lambda j: weight[j], default=None)
            if heavy is None or weight[heavy] < 0.7 * weight[best] or blocks[heavy] != 1:
                break
            best = heavy
        self.main = best
        # Elements of several lines, the outermost of equal extent; the whole page is none.
        for n in range(len(tags) - 1, 0, -1):
            if section[n] == n and n in spans:
                first, end = spans[n]
                up = section[parent[n]]
                if up in spans:
                    outer = spans[up]
                    outer[0], outer[1] = min(outer[0], first), max(outer[1], end)
                else:
                    spans[up] = [first, end]
        self.blocks = {(x, y) for n, (x, y) in spans.items() if y - x > 1 and y - x < len(self.lines)}


LINES = "array<struct<no:int,text:string,path:int,kind:string,link:float,inside:boolean,a:bigint,b:bigint,l:bigint>>"
PARSED = f"rec_id bigint, host string, h bigint, sig array<bigint>, main string, paths array<string>, lines {LINES}, blocks array<struct<start:int,end:int,key:bigint>>"


@lru_cache(65536)
def host_hash(host: str | None) -> int:
    return _hash("h:" + host) if host is not None else 0


def _emit(rows: list[tuple]):
    """Rows (rec_id, host, sig, main, paths, columns of lines, columns of blocks) as one Arrow batch."""
    import pyarrow as pa

    def offsets(of):
        out = [0]
        for x in of:
            out.append(out[-1] + x)
        return pa.array(out, pa.int32())

    def items(at, kinds):
        return pa.StructArray.from_arrays([pa.array([v for r in rows for v in r[at][k]], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    lines = [("no", pa.int32()), ("text", pa.string()), ("path", pa.int32()), ("kind", pa.string()), ("link", pa.float32()), ("inside", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("l", pa.int64())]
    blocks = [("start", pa.int32()), ("end", pa.int32()), ("key", pa.int64())]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.string()),
            pa.array([host_hash(r[1]) for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.list_(pa.int64())),
            pa.array([r[3] for r in rows], pa.string()),
            pa.ListArray.from_arrays(offsets(len(r[4]) for r in rows), pa.array([p for r in rows for p in r[4]], pa.string())),
            pa.ListArray.from_arrays(offsets(len(r[5][0]) for r in rows), items(5, lines)),
            pa.ListArray.from_arrays(offsets(len(r[6][0]) for r in rows), items(6, blocks)),
        ],
        ["rec_id", "host", "h", "sig", "main", "paths", "lines", "blocks"],
    )


def signature(keys) -> list[int]:
    """The keys that come first in three different orders: a copy with few changed lines keeps most of them."""
    if not keys:
        return [0, 0, 0]
    return [min(keys), max(keys), min(keys, key=lambda k: (k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)]


def inside_paths(paths: list[str], main: str) -> list[bool]:
    """Whether each container is the main one or within it."""
    return [p == main or p.startswith(main + ">") for p in paths]


def _parse_batches(batches: Iterator) -> Iterator:
    for batch in batches:
        rows = []
        for rec, host, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            page, brand = Page(content), brand_of(host)
            main = page.paths[page.main]
            within = inside_paths(page.paths, main)
            no, text, path, kind, link = zip(*page.lines) if page.lines else ((),) * 5
            inside = [within[p] for p in path]
            a, b, label = zip(*[line_keys(t, brand) for t in text]) if text else ((),) * 3
            blocks = [(x, y, _hash("s:" + repr(a[x:y]))) for x, y in page.blocks]
            sig = signature([k for k, i, t, e in zip(a, inside, text, kind) if i and e == "P" and len(t) >= SIGNED_LENGTH] or a)
            rows.append((rec, host, sig, main, page.paths, (no, text, path, kind, link, inside, a, b, label), tuple(zip(*blocks)) or ((),) * 3))
            if len(rows) >= 500:
                yield _emit(rows)
                rows = []
        if rows:
            yield _emit(rows)


def _plain_batches(batches: Iterator) -> Iterator:
    for batch in batches:
        rows = []
        for rec, host, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            brand = brand_of(host)
            lines = [(no, text) for no, raw in enumerate(content.split("\n")) if (text := " ".join(raw.split()))]
            n = len(lines)
            no, text = zip(*lines) if lines else ((), ())
            a, b, label = zip(*[line_keys(t, brand) for t in text]) if n else ((),) * 3
            rows.append((rec, host, signature([k for k, t in zip(a, text) if len(t) >= SIGNED_LENGTH] or a), "#", ["#"], (no, text, [0] * n, ["X"] * n, [0.0] * n, [True] * n, a, b, label), ((),) * 3))
            if len(rows) >= 500:
                yield _emit(rows)
                rows = []
        if rows:
            yield _emit(rows)


def parse(df: DataFrame, rec_id: str, url: str, content: str, markup: bool = True) -> DataFrame:
    """One row for each distinct (record, content) with visible text: rec_id, host, h (its hash), sig, main, paths, lines, blocks.

    Null, empty and blank contents give no row; exact repeats of a record give one; a null url gives a null host. Texts of any
    length are read whole. markup: the content may hold HTML (plain text then has the single container '#'); else it is plain.
    sig: three signatures of the main text, at least one of which copies with small edits share.
    """
    rows = df.select(F.col(rec_id).cast("long").alias("rec_id"), site_of(F.col(url)).alias("host"), F.col(content).alias("content")).where(F.col("content").rlike(r"\S"))
    if not markup:
        rows = rows.dropDuplicates(["rec_id", "content"])
    return rows.mapInArrow(_parse_batches if markup else _plain_batches, PARSED)


def host_main_paths(parsed: DataFrame) -> DataFrame:
    """(h, host_main): the container that is the main one on most pages of the host, where that is at least half of them."""
    each = parsed.where(F.col("host").isNotNull()).groupBy("h", "main").agg(F.count("*").alias("n"))
    best = each.groupBy("h").agg(F.max(F.struct("n", "main")).alias("best"), F.sum("n").alias("all"))
    return best.where(F.col("best.n") * 2 >= F.col("all")).select("h", F.col("best.main").alias("host_main"))


def distinct_pages(parsed: DataFrame) -> DataFrame:
    """(rec_id, h, everywhere) without copies on the same host: pages that are the first with most of their signatures; everywhere: on any host."""
    signed = parsed.select("h", "rec_id", F.posexplode("sig").alias("i", "sig"))
    on_host = signed.groupBy("h", "i", "sig").agg(F.min("rec_id").alias("rec_id"))
    first = on_host.groupBy("i", "sig").agg(F.min(F.struct("rec_id", "h")).alias("x")).select("i", "x.*")
    kept = on_host.select("i", "rec_id", "h", F.lit(0).alias("wide")).unionByName(first.withColumn("wide", F.lit(1)))
    return kept.groupBy("h", "rec_id").agg((F.count("*") - F.sum("wide")).alias("n"), (F.sum("wide") > 1).alias("everywhere")).where("n > 1").select("rec_id", "h", "everywhere")


def host_counts(parsed: DataFrame) -> DataFrame:
    """(h, key, type, n, wide, out_n, head_n, item_n, plain_n, size, wide_size): on how many distinct pages of each host each line or subtree stands, and in which places.

    type: a for a line, l its leading label, s subtree of several lines. out_n outside the main container, head_n as heading, item_n as list item
    or code, plain_n in plain texts; size: distinct pages of the host;
    wide and wide_size leave out copies of pages on other hosts. The rows are
    partly counted before they are shuffled, so a menu on all pages of a huge host is one row for each task.
    """
    pages = cut(distinct_pages(parsed), "distinct-pages")
    sizes = cut(pages.groupBy("h").agg(F.count("*").alias("size"), F.count_if("everywhere").alias("wide_size")), "host-sizes")
    slim = parsed.select("rec_id", "h", F.col("lines.a").alias("a"), F.col("lines.b").alias("b"), F.col("lines.l").alias("l"), F.col("lines.kind").alias("kind"), F.col("lines.inside").alias("inside"), F.col("blocks.key").alias("s"))
    slim = slim.join(pages.select("rec_id", F.col("everywhere").cast("int").alias("wide")), "rec_id")
    lines = slim.select("h", "wide", F.inline(F.arrays_zip("a", "b", "l", "kind", "inside")))
    each = lines.select("h", "wide", "kind", "inside", F.explode(F.array("a", "b", "l")).alias("key"), F.col("l").alias("__l")).where("key != 0")
    each = each.select("h", "wide", "key", F.when(F.col("key") == F.col("__l"), "l").otherwise("a").alias("type"), "kind", "inside")
    blocks = slim.select("h", "wide", F.explode("s").alias("key"), F.lit("s").alias("type"), F.lit("P").alias("kind"), F.lit(True).alias("inside"))
    is_ = lambda *kinds: F.sum((F.col("inside") & F.col("kind").isin(*kinds)).cast("int"))
    counted = each.unionByName(blocks).groupBy("h", "key", "type").agg(F.count("*").alias("n"), F.sum("wide").alias("wide"), F.sum((~F.col("inside")).cast("int")).alias("out_n"), is_("H").alias("head_n"), is_("L", "C").alias("item_n"), is_("X").alias("plain_n"))
    return counted.join(sizes, "h")


def template_table(counts: DataFrame, min_pages: int = MIN_PAGES, min_rate: float = MIN_RATE) -> DataFrame:
    """(key, h, kind) of the templates in host_counts; h is null for those of all hosts.

    kind: B boilerplate; N boilerplate seen mostly outside main containers (menus, labels of link lists); H heading form; L list form;
    S a subtree of several lines. A line is a template of all hosts if its repeats (uses after the first on a host) are min_rate of the
    pages of the hosts that have it; one use by chance on many other hosts counts against it. Lines that stand mostly outside main
    containers are told by that. On a single host it is one from
    HOST_PAGES pages that are HOST_SHARE of them; forms of headings and lists are none.
    """
    block = F.col("type") == "s"
    host_form = ((F.col("head_n") * 6 >= F.col("n")) & (F.col("head_n") > F.col("item_n"))) | (F.col("item_n") * 3 >= F.col("n"))
    own_line = (F.col("type") == "a") & ~host_form & (F.col("n") >= HOST_SHARE * F.col("size")) & (F.col("out_n") * 2 <= F.col("n"))
    own = (F.col("h") != 0) & (F.col("n") >= HOST_PAGES) & (own_line | (block & (F.col("n") >= BLOCK_SHARE * F.col("size"))))
    # A line counts for its key on all hosts (of: null), and a host's own template in a group of its own besides: so counts is computed once.
    everywhere = F.lit(None).cast("bigint")
    of = F.when(block & own, F.array("h")).when(block, F.array().cast("array<bigint>")).when(own, F.array(everywhere, "h")).otherwise(F.array(everywhere))
    again = F.greatest(F.col("wide") - 1, F.lit(0)).alias("again")
    rows = counts.select("key", "type", F.explode(of).alias("of"), "n", "wide", again, F.col("wide_size").alias("size"), "out_n", "head_n", "item_n", "plain_n")
    total = rows.groupBy("key", "type", "of").agg(*[F.sum(c).alias(c) for c in ("n", "wide", "again", "size", "out_n", "head_n", "item_n", "plain_n")])
    seen = F.col("n") - F.col("plain_n")
    main, P = seen - F.col("out_n"), seen - F.col("out_n") - F.col("head_n") - F.col("item_n")
    kind = (
        F.when(F.col("type") == "l", F.when((seen > 0) & (F.col("out_n") + P > 2 * (F.col("item_n") + F.col("head_n"))), "B").when(F.col("head_n") * 6 >= seen, "H").otherwise("L"))
        .when((F.col("head_n") * 6 >= seen) & (F.col("head_n") > F.col("item_n")) & (seen > 0), "H")
        .when((F.col("item_n") >= F.col("out_n")) & (F.col("item_n") * 3 >= main) & (seen > 0), "L")
        .when((F.col("out_n") * 2 > seen) & (seen > 0), "N")
        .otherwise("B")
    )
    told = kind.isin("H", "L", "N") & (F.col("wide") >= FORM_PAGES)
    shared = (F.col("wide") >= min(min_pages, FORM_PAGES)) & (told | ((F.col("wide") >= min_pages) & (F.col("again") >= F.greatest(F.lit(MIN_AGAIN), min_rate * F.col("size")))))
    verdict = F.when(F.col("of").isNotNull(), F.when(block, "S").otherwise("B")).when(shared, kind)
    return total.select("key", F.col("of").alias("h"), verdict.alias("kind")).where("kind is not null").distinct()


def template_keys(parsed: DataFrame, min_pages: int = MIN_PAGES, min_rate: float = MIN_RATE) -> DataFrame:
    """template_table of the counts of parsed."""
    return template_table(host_counts(parsed), min_pages, min_rate)


class Templates:
    """Kinds by key, as sorted arrays. A host's own templates have their key crossed with the host's hash."""

    def __init__(self, rows=()):
        import numpy as np

        found: dict[int, str] = {}
        for r in rows:
            key = r["key"] if r["h"] is None else r["key"] ^ r["h"]
            if found.get(key, "Z") > r["kind"]:  # B before H before L
                found[key] = r["kind"]
        order = sorted(found.items())
        self.keys = np.array([k for k, _ in order], dtype="int64")
        self.kinds = np.array([ord(v) for _, v in order], dtype="uint8")
        self._dict = None

    def get(self, key: int) -> str:
        if self._dict is None:
            self._dict = dict(zip(self.keys.tolist(), map(chr, self.kinds.tolist())))
        return self._dict.get(key, "")

    def of(self, a: int, b: int, label: int, h: int = 0) -> str:
        """The kind of a line by its keys and its host's hash, '' if it is no template."""
        return self.get(a) or (b and self.get(b)) or (h and (self.get(a ^ h) or (b and self.get(b ^ h)))) or (label and self.get(label)) or ""

    def many(self, keys):
        """Kinds (as characters' codes, 0: none) of an array of keys."""
        import numpy as np

        if not len(self.keys):
            return np.zeros(len(keys), np.uint8)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (keys != 0), self.kinds[at], 0)

    def lines(self, a, b, label, h):
        """of() for arrays."""
        import numpy as np

        out = self.many(a)
        for keys in (b, np.where(h != 0, a ^ h, 0), np.where((h != 0) & (b != 0), b ^ h, 0), label):
            rest = np.flatnonzero(out == 0)
            if len(rest):
                out[rest] = self.many(keys[rest])
        return out

    def __getstate__(self):
        return self.keys, self.kinds

    def __setstate__(self, state):
        self.keys, self.kinds = state
        self._dict = None


def known_by_record(parsed: DataFrame, found: DataFrame, parts) -> DataFrame:
    """(rec_id, known array of (key, h, kind)): the templates that a record's lines, their parts and its subtrees can meet.

    The way for more templates than are broadcast: (record, hash) pairs are joined with the verdicts. parts(text, brand) gives the keys
    within a line. A record's array is bounded by its own lines.
    """

    def keys_of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rec, key, hs = [], [], []
            for r, host, h, texts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                brand = brand_of(host)
                own = {k for t in texts for k in (*line_keys(t, brand), *parts(t, brand)) if k}
                rec += [r] * len(own)
                key += own
                hs += [h] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(rec, pa.int64()), pa.array(key, pa.int64()), pa.array(hs, pa.int64())], ["rec_id", "key", "__h"])

    keys = parsed.select("rec_id", "host", "h", F.col("lines.text").alias("texts")).mapInArrow(keys_of, "rec_id bigint, key bigint, __h bigint")
    keys = keys.unionByName(parsed.select("rec_id", F.explode("blocks.key").alias("key"), F.col("h").alias("__h")))
    met = keys.join(found, "key").where(F.col("h").isNull() | (F.col("h") == F.col("__h")))
    return met.groupBy("rec_id").agg(F.collect_set(F.struct("key", "h", "kind")).alias("known"))
