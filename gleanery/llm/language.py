"""Problem 1: missing or wrong document language labels.

Method: prediction by partial matching (ppm.py). Trees are trained on the clean reference texts, then frozen; every body line of
every document gets its exact code length under each language. The language with the shortest code is the line's, with the posterior
probability as its confidence; the document's main language is that of most of its body text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.boilerplate import _CODE, corpus, labelled_texts
from gleanery.llm.ppm import ContextTrees
from gleanery.session import discard, load

# Codes and names of the languages of the reference texts.
LANGUAGE_NAMES = {
    "en": "eng english englisch anglais inglés inglese inglês engels английский",
    "de": "deu ger german deutsch allemand alemán tedesco alemão duits немецкий",
    "fr": "fra fre french français francais französisch francés francese francês frans французский",
    "es": "spa spanish español espanol castellano spanisch espagnol spagnolo espanhol spaans испанский",
    "it": "ita italian italiano italienisch italien italiaans итальянский",
    "pt": "por portuguese português portugues portugiesisch portugais portugués portoghese portugees португальский",
    "nl": "nld dut dutch nederlands vlaams flemish niederländisch néerlandais neerlandés olandese holandês нидерландский",
    "ru": "rus russian русский russkij russisch russe ruso russo russisch",
}
#: A line counts as foreign if its own language is so many bits, and bits per byte, shorter than the main one.
MIN_BITS, MIN_BITS_PER_BYTE = 20.0, 0.35
#: Bits by which a language of the site's whitelist is preferred for a whole document.
WHITELIST_BITS = 4.0

_TWO_LETTERS = re.compile(r"[^\W\d_].*?[^\W\d_]")

SEGMENTS = "rec_id bigint, main string, confidence double, lines array<struct<line_no:int,lang:string,confidence:double,bits:double,margin:double,foreign:boolean>>"


def language_of(name: Column) -> Column:
    """Two-letter code that a label means, whatever its spelling, case, region or code; null for others, null and blank."""
    word = F.lower(F.regexp_extract(F.trim(name), r"^([\p{L}]+)(?:[-_][\w-]+)?$", 1))
    table = {w: code for code, words in LANGUAGE_NAMES.items() for w in [code, *words.split()]}
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[word]


def train(samples: DataFrame, order: int = 5, max_rows: int = 5000) -> ContextTrees:
    """Trees of the reference texts: of at most max_rows rows (smallest sample_id first), a documented bound on the training sample."""
    rows = samples.where(F.col("sample_text").isNotNull() & F.col("lang").isNotNull()).select("sample_id", language_of(F.col("lang")).alias("lang"), "sample_text").where("lang is not null").orderBy("sample_id").limit(max_rows).collect()
    texts: dict[str, list[str]] = {}
    for r in rows:
        texts.setdefault(r.lang, []).append(r.sample_text)
    return ContextTrees(texts, order)


def _scorer(trees: ContextTrees, min_bits: float, min_rate: float):
    import numpy as np

    names = trees.languages

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        line_type = pa.struct([("line_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("bits", pa.float64()), ("margin", pa.float64()), ("foreign", pa.bool_())])
        for batch in batches:
            recs, numbers, bodies, white = (batch.column(i).to_pylist() for i in range(4))
            flat = [x for b in bodies for x in b]
            costs = trees.line_costs(flat)
            sizes = np.array([len(x.encode()) for x in flat], np.float64)
            prose = np.array([bool(_TWO_LETTERS.search(x)) and not _CODE.search(x) for x in flat], bool)
            out, at = [], 0
            for rec, no, wl in zip(recs, numbers, white):
                c, size, ok = costs[at : at + len(no)], sizes[at : at + len(no)], prose[at : at + len(no)]
                at += len(no)
                if not len(no) or not ok.any():
                    ok = np.ones(len(no), bool)
                if not len(no) or not names:
                    out.append((rec, None, None, []))
                    continue
                first = c.argmin(1)
                shares = np.bincount(first[ok], weights=size[ok], minlength=len(names))
                # Short lines are unsure: the languages of at least a fifth of the text compete by the whole text's code length.
                rivals = np.flatnonzero(shares >= 0.2 * shares.sum())
                bonus = np.array([WHITELIST_BITS if n in (wl or ()) else 0.0 for n in names])
                near = [i for i in rivals if shares[i] >= 0.8 * shares.max()]
                main = min(near, key=lambda i: (c[ok][:, i].sum() - bonus[i], i)) if len(near) > 1 else int(shares.argmax())
                best = c.min(1)
                odds = np.exp2(best[:, None] - c)
                conf = 1 / odds.sum(1)
                total = c[ok & ((first == main) | (c[:, main] - best < min_bits))].sum(0)
                overall = 1 / np.exp2(np.clip(total[main] - total, -500, 500)).sum() if len(total) else 0.0
                margin = c[:, main] - best
                foreign = ok & (first != main) & (margin >= min_bits) & (margin >= min_rate * size)
                out.append((rec, names[main], float(overall), [{"line_no": int(n), "lang": names[f if x else main], "confidence": float(q if x or f == main else 1 - q), "bits": float(b), "margin": float(m), "foreign": bool(x)} for n, f, q, b, m, x in zip(no, first, conf, best, margin, foreign)]))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.list_(line_type))], ["rec_id", "main", "confidence", "lines"])

    return run


def identify(bodies: DataFrame, trees: ContextTrees, min_bits: float = MIN_BITS, min_rate: float = MIN_BITS_PER_BYTE) -> DataFrame:
    """rec_id, main language with confidence, and each body line with its language, confidence and bits.

    bodies: rec_id, body_no, body (as boilerplate.label gives them) and whitelist (array of codes or null). A record without body
    lines gets a null language. Lines of code and lines without letters take the main language. Nothing is dropped or cut.
    """
    return bodies.select("rec_id", "body_no", "body", "whitelist").mapInArrow(_scorer(trees, min_bits, min_rate), SEGMENTS)


def whitelists(config: DataFrame) -> DataFrame:
    """(host, whitelist): the languages a site lists, spellings resolved; null and empty lists give none."""
    host = F.regexp_replace(F.lower(F.trim("domain")), r"^www\.", "")
    each = config.select(host.alias("host"), F.explode("language_whitelist").alias("x")).select("host", language_of(F.col("x")).alias("lang")).where("lang is not null")
    return each.groupBy("host").agg(F.sort_array(F.collect_set("lang")).alias("whitelist"))


def identified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify() over the main bodies of processed_docs."""
    pages, docs, found = corpus(spark, sf_dir)
    discard(pages)
    bodies = labelled_texts(spark, sf_dir, docs, found).join(whitelists(load(spark, sf_dir, "domain_config")), "host", "left")
    return identify(bodies, train(load(spark, sf_dir, "lang_samples")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language of records whose label is missing or wrong (line_no -1), and foreign lines."""
    labels = load(spark, sf_dir, "processed_docs").select(F.col("proc_id").alias("rec_id"), language_of(F.col("lang_label")).alias("label")).distinct()
    found = identified_documents(spark, sf_dir).where("main is not null").join(labels, "rec_id")
    wrong = F.when(F.col("label").isNull() | (F.col("label") != F.col("main")), F.array(F.struct(F.lit(-1).alias("line_no"), F.col("main").alias("lang")))).otherwise(F.array().cast("array<struct<line_no:int,lang:string>>"))
    lines = F.transform(F.filter("lines", lambda x: x["foreign"]), lambda x: F.struct(x["line_no"].alias("line_no"), x["lang"].alias("lang")))
    return found.select(F.col("rec_id").alias("proc_id"), F.explode(F.concat(wrong, lines)).alias("x")).select("proc_id", F.col("x.line_no").cast("long").alias("line_no"), "x.lang").distinct()


QUERIES = {"p1_found": p1_found}
