"""Problem 2: page boilerplate mixed with the main content.

Method: site template removal. The element subtrees of a page are hashed (pages.py), counted per host in Spark, and deleted where they
recur on many distinct pages of that host; a subtree of one line is also known from the other hosts that repeat it. What lies in the
container that holds the main text on most pages of the host and is no such subtree is the main body.
Plain texts have no elements; their lines are judged by the templates that the counts gave, and by their order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.pages import BROADCAST_ROWS, SENTENCE_END, Templates, brand_of, host_counts, host_main_paths, inside_paths, known_by_record, line_keys, parse, template_keys, template_table
from gleanery.llm.residue import BARE_WORDS, describe, residue_pages, surroundings
from gleanery.session import cut, discard, load

ABOUT = (
    "about struct<words:int,text_words:int,"
    "sentences:array<struct<template:bigint,parent:bigint,context:bigint,notice:boolean,text:boolean>>,nodes:array<bigint>,slots:array<bigint>,empty:int,dummy:boolean,page:bigint,full:boolean>"
)
LABELLED = f"rec_id bigint, host string, boiler array<int>, body_no array<int>, body array<string>, {ABOUT}"
_WORD = re.compile(r"[^\W\d_]+")
_CODE = re.compile(r"[;{}]\s*$|^\s*(?:def|class|import|from|return|const|let|var|func|if|for|while|SELECT|INSERT|UPDATE)\b.*[(){}=;<>|$]|^\s*(?:#!|//|>>>)|^\s*\$ |^\s*[\w.-]+:\s*(?:true|false|\d+)?\s*$|=>|\w\(.*\)\s*[;:{]?\s*$|\w+ = \w")
_BULLET = re.compile(r"^\s*(?:[*•‣◦·+-]|\d{1,2}[.)])\s")
_PART = re.compile(r"[/|·•›»>,#]|\s[–—-]\s")
_PARTS = re.compile(r"\s*[/|·•›»>,#]\s*|\s+[–—-]\s+")


def _sentences(text: str) -> int:
    return len(SENTENCE_END.findall(text))


def _paragraph(text: str) -> bool:
    """Running text: a sentence of five words or more, or twelve words."""
    n = len(_WORD.findall(text))
    return (n >= 5 and _sentences(text) > 0) or n >= 12


def _teaser(text: str, brand: str, templates: Templates) -> bool:
    """A heading form, a colon and a summary."""
    if ":" not in text:
        return False
    for m in re.finditer(r":\s", text):
        head = text[: m.start()]
        if len(_WORD.findall(head)) >= 3 and templates.of(*line_keys(head, brand)) == "H":
            return True
    return False


def _menu_parts(text: str) -> list[str]:
    """The parts of a short line that has separators."""
    if len(text) > 200 or not _PART.search(text):
        return []
    parts = [p for p in _PARTS.split(text) if p]
    return parts if len(parts) > 1 else []


def _menu(text: str, brand: str, templates: Templates) -> bool:
    """Several short parts of which most are menu entries."""
    parts = _menu_parts(text)
    others = 0
    for p in parts:
        if templates.of(*line_keys(p, brand)) not in ("N", "B"):
            others += 1
            if others * 3 > len(parts):  # whatever the rest is
                return False
    return bool(parts)


def part_keys(text: str, brand: str) -> list[int]:
    """The keys within a line that _menu and _teaser look up."""
    heads = [text[: m.start()] for m in re.finditer(r":\s", text)]
    return [k for p in _menu_parts(text) + heads for k in line_keys(p, brand)]


def label_page(brand: str, inside: list[bool], kinds: list[str], elements: list[str], link: list[float], texts: list[str], templates: Templates) -> list[bool]:
    """For each line of a page whether it belongs to the main body. kinds: B for lines of subtrees that recur on the host, too."""
    out = []
    for i, within in enumerate(inside):
        kind = kinds[i]
        if not within or kind in ("B", "N"):
            out.append(False)
        elif elements[i] in "HLC" or kind in ("H", "L"):
            out.append(not (link[i] > 0.8 and elements[i] != "L" and kind == "H"))
        else:
            out.append(not _menu(texts[i], brand, templates))
    # Blocks of links to other pages at the end of the main container: headings that no text follows.
    last = None
    for i in range(len(out) - 1, -1, -1):
        if out[i] and (elements[i] in "LC" or _paragraph(texts[i])) and not _teaser(texts[i], brand, templates):
            last = i
            break
    if last is not None:
        for i in range(last + 1, len(out)):
            if out[i] and (link[i] > 0.5 or _teaser(texts[i], brand, templates)):
                out[i] = False
    return out


def label_text(brand: str, title: str | None, found: list[str], texts: list[str], templates: Templates) -> list[bool]:
    """For each line of a plain text whether it belongs to the main body. found: the kinds of its lines."""
    n = len(texts)
    fold = lambda s: re.sub(r"\W+", " ", s).strip().lower()
    kinds, solid = [], []
    for kind, text in zip(found, texts):
        if kind in ("", "L") and _teaser(text, brand, templates) and _sentences(text) <= 2:
            kind = "T"
        elif kind == "" and _menu(text, brand, templates):
            kind = "N"
        elif kind in ("B", "N") and _CODE.search(text) and not _NAMED.search(text):
            kind = ""
        kinds.append(kind)
        solid.append(kind == "L" or (kind == "" and (_paragraph(text) or bool(_CODE.search(text)) or bool(_BULLET.match(text)) or _sentences(text) > 0)))
    start, wanted = 0, fold(title or "")
    if wanted:
        start = next((i for i in range(n) if fold(texts[i]) == wanted), 0)
    elif any(solid):
        first = solid.index(True)
        start = next((i for i in range(first) if kinds[i] == "H"), first)
    last = max((i for i in range(n) if solid[i]), default=-1)
    out, teasers = [], False
    for i in range(n):
        kind, ok = kinds[i], True
        if i < start or kind in ("B", "N"):
            ok = False
            teasers = teasers or (kind == "N" and i > start)
        elif kind == "T":
            ok = False
        elif kind == "H":
            ok = i <= last and not (teasers and not solid[min(i + 1, n - 1)]) or i == start
        elif solid[i]:
            teasers = teasers and _sentences(texts[i]) < 2
        elif i > last and i != start:
            ok = False
        out.append(ok)
    return out


_NAMED = re.compile(r"@|©")


def _about(inside: list[bool], kinds: list[str], elements: list[str], link: list[float], texts: list[str], ok: list[bool]) -> dict:
    """What residue.py needs to know of a page's main area: that is all of the main container but menus and link lists."""
    core, running = [], []
    for i, y in enumerate(ok):
        if inside[i] and link[i] < 0.8 and (y or kinds[i] in ("B", "H") or (kinds[i] == "N" and SENTENCE_END.search(texts[i]))):
            core.append(texts[i])
            if y and elements[i] != "H":
                running.append(texts[i])
    about = dict(zip(("words", "text_words", "sentences", "slots", "empty", "dummy"), describe(core, running)))
    bare = about["text_words"] < BARE_WORDS
    page, full = surroundings(core, running) if about["slots"] else (0, False)
    return about | {"sentences": about["sentences"] if bare else [], "nodes": [] if bare else about["sentences"], "page": page, "full": full}


def _labeller(sent: Templates | None, plain: bool, describing: bool, then=None):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        longs, ints, strings = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())
        sentence = pa.struct([("template", pa.int64()), ("parent", pa.int64()), ("context", pa.int64()), ("notice", pa.bool_()), ("text", pa.bool_())])
        kind_of_about = pa.struct([("words", pa.int32()), ("text_words", pa.int32()), ("sentences", pa.list_(sentence)), ("nodes", longs), ("slots", longs), ("empty", pa.int32()), ("dummy", pa.bool_()), ("page", pa.int64()), ("full", pa.bool_())])
        names = {i: chr(i) if i else "" for i in range(256)}
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                known = sent if sent is not None else Templates(x for r in col["known"].to_pylist() for x in r or ())
                rec, host, title = (col[n].to_pylist() for n in ("rec_id", "host", "title"))
                flat, sizes = col["lines"].flatten(), np.diff(col["lines"].offsets.to_numpy()[: batch.num_rows + 1])
                h = np.repeat(col["h"].to_numpy(), sizes)
                kinds = [names[k] for k in known.lines(*(flat.field(x).to_numpy() for x in "abl"), h).tolist()]
                listed = lambda x: flat.field(x).to_numpy(zero_copy_only=False).tolist()
                no, texts = listed("no"), listed("text")
                ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                if not plain:
                    elements, link, inside, path = map(listed, ("kind", "link", "inside", "path"))
                    main, other, paths = (col[n].to_pylist() for n in ("main", "host_main", "paths"))
                    spans, many = col["blocks"].flatten(), np.diff(col["blocks"].offsets.to_numpy()[: batch.num_rows + 1])
                    recurs = (known.many(spans.field("key").to_numpy() ^ np.repeat(col["h"].to_numpy(), many)) == ord("S")).tolist()
                    first, end = spans.field("start").to_pylist(), spans.field("end").to_pylist()
                    upto = np.concatenate([[0], np.cumsum(many)]).tolist()
                boiler, numbers, body, about = [], [], [], []
                for i in range(len(rec)):
                    x, y = ends[i], ends[i + 1]
                    brand, mine, own = brand_of(host[i]), kinds[x:y], texts[x:y]
                    if plain:
                        ok = label_text(brand, title[i], mine, own, known)
                    else:
                        within, at_main = inside[x:y], main[i]
                        if other[i] and other[i] != at_main and other[i] in paths[i]:
                            at_main = other[i]
                            in_path = inside_paths(paths[i], at_main)
                            within = [in_path[p] for p in path[x:y]]
                        if at_main == "#":
                            ok = label_text(brand, None, mine, own, known)
                        else:
                            for j in range(upto[i], upto[i + 1]):
                                if recurs[j]:
                                    mine[first[j] : end[j]] = [k if k in ("B", "N") else "B" for k in mine[first[j] : end[j]]]
                            ok = label_page(brand, within, mine, elements[x:y], link[x:y], own, known)
                        if describing:
                            about.append(_about(within, mine, elements[x:y], link[x:y], own, ok))
                    lines = no[x:y]
                    boiler.append([n for n, good in zip(lines, ok) if not good])
                    numbers.append([n for n, good in zip(lines, ok) if good])
                    body.append([t for t, good in zip(own, ok) if good])
                abouts = pa.array(about, kind_of_about) if about else pa.nulls(len(rec), kind_of_about)
                if then is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(rec, pa.int64()), pa.array(host, pa.string()), abouts, *then(body)], ["rec_id", "host", "about", *[c.split()[0] for c in then.schema.split(", ")]])
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(rec, pa.int64()), pa.array(host, pa.string()), pa.array(boiler, ints), pa.array(numbers, ints), pa.array(body, strings), abouts], ["rec_id", "host", "boiler", "body_no", "body", "about"])

    return run


def label(parsed: DataFrame, templates: Templates | DataFrame, titles: DataFrame | None = None, own: DataFrame | None = None, broadcast_rows: int = BROADCAST_ROWS, describing: bool = True, then=None) -> DataFrame:
    """rec_id, host, boiler (numbers of the lines outside the main body), body_no and body (its lines), for each parsed record.

    templates: a template_table, which is broadcast up to broadcast_rows rows and joined beyond. Collected Templates are taken as they are,
    together with own (key, h, kind), by default the hosts' own templates of parsed. titles (rec_id, title) marks plain texts; null titles
    are allowed. describing: fill about, which residue.py needs. then: makes the columns then.schema of a list of
    bodies; they stand in place of boiler, body_no and body. No record is dropped.
    """
    if isinstance(templates, Templates):
        own = template_keys(parsed).where("h is not null") if own is None else own
        shared = [{"key": k, "h": None, "kind": chr(v)} for k, v in zip(templates.keys.tolist(), templates.kinds.tolist())]
        templates = own.select("key", "h", "kind")
        if shared:
            templates = templates.unionByName(parsed.sparkSession.createDataFrame([(r["key"], None, r["kind"]) for r in shared], "key bigint, h bigint, kind string"))
    templates = cut(templates, "templates")
    rows = parsed
    if titles is None:
        rows = rows.join(cut(host_main_paths(parsed), "host-paths"), "h", "left").withColumn("title", F.lit(None).cast("string"))
    else:
        rows = rows.join(titles.groupBy("rec_id").agg(F.max("title").alias("title")), "rec_id", "left").withColumn("host_main", F.lit(None).cast("string"))
    sent, columns = None, ["rec_id", "host", "h", "main", "host_main", "title", "paths", "lines", "blocks"]
    if templates.count() <= broadcast_rows:
        sent = Templates(templates.collect())
    else:
        rows, columns = rows.join(known_by_record(parsed, templates, part_keys), "rec_id", "left"), [*columns, "known"]
    return rows.select(*columns).mapInArrow(_labeller(sent, titles is not None, describing, then), LABELLED if then is None else f"rec_id bigint, host string, {ABOUT}, {then.schema}")


def corpus(spark: SparkSession, sf_dir: str, texts: bool = True) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Parsed raw_pages, parsed processed_docs, and the template table of the pages."""
    pages = cut(parse(load(spark, sf_dir, "raw_pages"), "page_id", "url", "content"), "pages")
    docs = cut(parse(load(spark, sf_dir, "processed_docs"), "proc_id", "url", "main_content", markup=False), "texts") if texts else None
    return pages, docs, cut(template_keys(pages), "page-templates")


def labelled_texts(spark: SparkSession, sf_dir: str, docs: DataFrame, found: DataFrame) -> DataFrame:
    """Labelled processed_docs: by the templates of the pages, and by those of the texts where the pages know none."""
    own = template_keys(docs).join(found, ["key"], "left_anti")
    titles = load(spark, sf_dir, "processed_docs").select(F.col("proc_id").alias("rec_id"), "title")
    return label(docs, found.unionByName(own), titles)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines outside the main body, of raw_pages (but for those that p3_found lists) and of processed_docs."""
    pages, docs, found = corpus(spark, sf_dir)
    labelled = cut(label(pages, found).select("rec_id", "host", "boiler", "about"), "labelled-pages")
    discard(pages)
    bad = cut(residue_pages(labelled), "residue")
    raw = labelled.join(bad, labelled.rec_id == bad.page_id, "left_anti").select(F.lit("raw_pages").alias("src"), "rec_id", F.explode(F.col("boiler").cast("array<bigint>")).alias("line_no"))
    text = labelled_texts(spark, sf_dir, docs, found).select(F.lit("processed_docs").alias("src"), "rec_id", F.explode(F.col("boiler").cast("array<bigint>")).alias("line_no"))
    return raw.unionByName(text)


QUERIES = {"p2_found": p2_found}
