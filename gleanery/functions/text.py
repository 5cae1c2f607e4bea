"""Cleaning, chunking, keywords and signatures of texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of site interfaces that are cut out of texts.
INTERFACE = r"\b(?:diffhist|contribs|mobile\s+edit|visual\s+edit|android\s+app|ios\s+app|hidden\s+tag|wikiedu|dashboard|assignment\s+wizard|wikiloop|battlefield|user\s+creation|antivandal|rollback|manual\s+revert)\b"
# Patterns of addresses, entities and punctuation that are cut out or shortened.
URLS, EMAILS, ENTITIES = r"https?://\S+", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", r"&[a-zA-Z0-9#]+;"
ESCAPES = r"\\u003[cC]|\\u003[eE]|\\u0026|\\u0022|\\u0027|\\u003[aA]|\\u003[dD]"
# English words that are no keywords.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from is are was were be been have has had do does did will would should could can may might must shall it its this that these those i you he she we they me him her us them "
    "my your his their one two three first second last next more most some all any each every no not only just also very much many now then here there when where how what who why"
).split()


def clean_text(text: Column) -> Column:
    """Interface words, addresses, entities and escapes out, three or more end marks as '...', white space single. Null stays null."""
    t = F.regexp_replace(text, r"\s?vte\s", " ")
    for pattern in (INTERFACE, URLS, EMAILS, ENTITIES, ESCAPES):
        t = F.regexp_replace(t, pattern, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[.!?]{3,}", "..."), r"\s+", " "))


def clean_description(text: Column, limit: int = 300) -> Column:
    """Without entities, single spaces; over the limit cut behind the last full stop, else before the last space with '...'."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, ENTITIES, " "), r"\s+", " "))
    head = F.substring(t, 1, limit)
    stop, space = F.length(head) - F.locate(".", F.reverse(head)) + 1, F.length(head) - F.locate(" ", F.reverse(head)) + 1
    cut = F.when(head.contains("."), F.substr(head, F.lit(1), stop)).when(head.contains(" "), F.concat(F.substr(head, F.lit(1), space - 1), F.lit("..."))).otherwise(F.concat(F.substring(head, 1, limit - 3), F.lit("...")))
    return F.when(F.length(t) > limit, cut).otherwise(t)


def sentence_chunks(text: Column, max_size: int = 2500, min_size: int = 50) -> Column:
    """Chunks of whole sentences up to max_size bytes; chunks under min_size are dropped; one text that fits is one chunk.

    An ordered fold over the sentences: no UDF. If no sentence chunk is long enough, words are packed the same way.
    """

    def packed(pieces: Column) -> Column:
        empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

        def step(acc: Column, piece: Column) -> Column:
            full = F.octet_length(acc["open"]) + F.octet_length(piece) + 1 > max_size
            done = F.when(full & (F.octet_length(acc["open"]) >= min_size), F.concat(acc["done"], F.array(F.trim(acc["open"])))).otherwise(acc["done"])
            return F.struct(done.alias("done"), F.when(full | (acc["open"] == ""), piece).otherwise(F.concat(acc["open"], F.lit(" "), piece)).alias("open"))

        return F.aggregate(pieces, empty, step, lambda acc: F.when(F.octet_length(acc["open"]) >= min_size, F.concat(acc["done"], F.array(F.trim(acc["open"])))).otherwise(acc["done"]))

    sentences = F.transform(F.split(text, r"\. "), lambda s: F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit("."))))
    none = F.array().cast("array<string>")
    by_sentence = packed(sentences)
    long = F.when(F.size(by_sentence) > 0, by_sentence).otherwise(packed(F.filter(F.split(text, r"\s+"), lambda w: w != "")))
    return F.when(text.isNull(), none).when(F.octet_length(text) <= max_size, F.when(F.octet_length(text) >= min_size, F.array(text)).otherwise(none)).otherwise(long)


def terms(text: Column, least: int = 3) -> Column:
    """Lower-case runs of a-z and digits of at least `least` characters."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda t: F.length(t) >= least)


def clean_query(query: Column) -> Column:
    """Single spaces; only word characters, spaces and - . ? ! stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(query), r"\s+", " "), r"[^\p{L}\p{N}_\s\-.?!]", ""))


def preview(text: Column, limit: int = 300) -> Column:
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), ENTITIES, " "))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(F.coalesce(t, F.lit("")))


def highlight(text: Column, words: list[str], limit: int = 300) -> Column:
    """An excerpt from 100 characters before the first of the words, with '...' where it was cut; else the beginning."""
    at = F.array_min(F.filter(F.array(*[F.locate(w.lower(), F.lower(text)) for w in words]), lambda p: p > 0))
    start = F.greatest(F.lit(1), at - 100)
    end = F.least(F.length(text), start + limit - 1)
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substr(text, start, end - start + 1), F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at.isNull(), F.substring(text, 1, limit)).otherwise(cut)


def signature(title: Column, text: Column) -> Column:
    """md5 of title and text in lower case with single white space."""
    joined = F.trim(F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))))
    return F.md5(F.regexp_replace(joined, r"\s+", " "))


def frequent_keywords(docs: DataFrame, key: str, text: str, top: int = 10) -> DataFrame:
    """(key, keyword, n): of a text's `top` most frequent alphabetic words over three letters, no stop words, those that occur twice."""
    words = docs.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]{4,}"), 0)).alias("keyword")).where(~F.col("keyword").isin(*STOP_WORDS))
    counted = words.groupBy(key, "keyword").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "keyword"))
    return counted.withColumn("r", rank).where((F.col("r") <= top) & (F.col("n") >= 2)).drop("r")


def phrase_keywords(docs: DataFrame, key: str, text: str, top: int = 10) -> DataFrame:
    """(key, keyword, score): words by (degree + frequency) / frequency over the phrases between stop words (rapid keyword extraction)."""
    stops = r"\b(?:" + "|".join(STOP_WORDS) + r")\b"
    phrases = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z\s]", "|"), stops, "|"), r"\|"), lambda p: F.trim(p) != "")
    words = docs.select(key, F.explode(phrases).alias("p")).select(key, F.filter(F.split(F.trim("p"), r"\s+"), lambda w: w != "").alias("w"))
    each = words.select(key, (F.size("w") - 1).alias("degree"), F.explode("w").alias("keyword"))
    scored = each.groupBy(key, "keyword").agg(((F.sum("degree") + F.count("*")) / F.count("*")).alias("score")).where(F.length("keyword") > 2)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "keyword"))
    return scored.withColumn("r", rank).where(F.col("r") <= top).drop("r")
