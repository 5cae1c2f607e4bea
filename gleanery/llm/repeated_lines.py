"""Problem 7: lines repeated across one site's documents.

p7_found and p7_clean: the definition asks for the document frequency of each line within its source alone, so frequent_keys decides; the
repeated lines are anti-joined and each document is put together again by position.

p7_peculiar, p7_peculiar_clean: that frequency is compared with that of lines outside by Dunn's log-likelihood ratio, with false-discovery
control over all candidate lines. Two ratios are kept: against the same line in all other sources (is the line peculiar to this source?), which
decides, and against an average line (is it repeated at all?), which is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions.sites import site_of
from gleanery.session import cut, load

MIN_DOCUMENTS, FALSE_DISCOVERY = 5, 0.01
_SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]+"


def line_key(line: Column) -> Column:
    """What counts of a line: lower case, digits left out, runs of white space as one, ends ignored."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{Nd}+", ""), _SPACE, " "))


def _xlogx(k: Column, rate: Column) -> Column:
    return F.when(k > 0, k * F.log(rate)).otherwise(0.0)


def log_likelihood_ratio(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """G2 of k1 of n1 against k2 of n2, 0 where the first rate isn't the higher one or a side is empty."""
    p1, p2, p = k1 / n1, k2 / n2, (k1 + k2) / (n1 + n2)
    g = 2 * (_xlogx(k1, p1 / p) + _xlogx(n1 - k1, (1 - p1) / (1 - p)) + _xlogx(k2, p2 / p) + _xlogx(n2 - k2, (1 - p2) / (1 - p)))
    return F.when((n1 > 0) & (n2 > 0) & (p1 > p2), g).otherwise(0.0)


def tail(g: Column) -> Column:
    """Probability that chi-square with one degree of freedom exceeds g (complementary error function, error below 2e-7)."""
    x = F.sqrt(g / 2)
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def significant_from(candidates: DataFrame, g: str, alpha: float) -> DataFrame:
    """One row: the least g that passes the step-up rule at level alpha (null: none does).

    The ranks come from a histogram of g in steps of 1/8 up to 1000, so nothing but its 8001 rows is ever sorted.
    """
    step = F.least(F.floor(F.col(g) * 8), F.lit(8000))
    histogram = candidates.groupBy(step.alias("step")).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0))
    all_ = F.sum("n").over(Window.partitionBy())
    low = F.col("step") / 8
    return histogram.select("step", (tail(low) <= alpha * above / all_).alias("passes")).agg(F.min(F.when(F.col("passes"), low)).alias("__from"))


def chunk_lines(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, document_id, source, keys): hashed keys of a chunk's lines in order, null for lines without letters or signs.

    documents (document_id, url) gives the source by the site of the url; a document listed with several sites counts with the smallest,
    an unlisted one and a null url give the source null. Null texts give no lines. Exact repeats of a chunk give one row.
    """
    key = F.transform(F.split("text_chunk", "\n"), lambda x: F.when(line_key(x) != "", F.struct(F.xxhash64(line_key(x)).alias("a"), F.hash(line_key(x)).alias("b"))))
    keyed = chunks.where(F.col("text_chunk").isNotNull()).select("chunk_id", "document_id", key.alias("keys")).distinct()
    sources = documents.groupBy("document_id").agg(F.min(site_of(F.col("url"))).alias("source"))
    return keyed.join(sources, "document_id", "left")


def _line_counts(lines: DataFrame) -> DataFrame:
    """(source, a, b, documents) of every line."""
    in_source = lines.select("source", "document_id", F.explode(F.array_distinct("keys")).alias("k")).where("k is not null").select("source", "document_id", "k.*").distinct()
    return in_source.groupBy("source", "a", "b").agg(F.count("*").alias("documents"))


def frequent_keys(lines: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(source, a, b, documents) of every line in min_documents documents of one source or more."""
    return _line_counts(lines).where(F.col("documents") >= min_documents)


def repeated_keys(lines: DataFrame, min_documents: int = MIN_DOCUMENTS, alpha: float = FALSE_DISCOVERY) -> DataFrame:
    """(source, a, b, documents, outside, peculiar, significant) of every line in min_documents documents of one source or more.

    peculiar: its excess over all other sources passes the false-discovery control; significant: that over an average line does.
    """
    per_source = cut(_line_counts(lines), "line-counts")
    everywhere = per_source.groupBy("a", "b").agg(F.sum("documents").alias("everywhere"))
    sizes = lines.groupBy("source").agg(F.countDistinct("document_id").alias("size"))
    total = per_source.agg(F.sum("documents").alias("uses"), F.count("*").alias("kinds"))
    docs = lines.agg(F.countDistinct("document_id").alias("all_size"))
    often = per_source.where(F.col("documents") >= min_documents).join(everywhere, ["a", "b"])
    often = often.join(sizes, often.source.eqNullSafe(sizes.source)).drop(sizes.source).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(docs))  # one row each
    k, n = F.col("documents"), F.col("size")
    outside = F.col("everywhere") - k
    often = often.withColumn("g_source", log_likelihood_ratio(k, n, outside, F.col("all_size") - n)).withColumn("g_line", log_likelihood_ratio(k, n, F.col("uses") / F.col("kinds"), F.col("all_size").cast("double")))
    often = cut(often.withColumn("outside", outside), "frequent-lines")
    for g, name in (("g_source", "peculiar"), ("g_line", "significant")):
        least = significant_from(often, g, alpha)
        often = often.crossJoin(F.broadcast(least)).withColumn(name, F.coalesce(F.col(g) >= F.col("__from"), F.lit(False))).drop("__from")  # one row
    return often.select("source", "a", "b", "documents", "outside", "peculiar", "significant")


def flag_lines(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(chunk_id, line_no, key columns of repeated_keys) for every line of a chunk that is in keys."""
    each = lines.select("chunk_id", "source", F.posexplode("keys").alias("line_no", "k")).where("k is not null").select("chunk_id", "source", F.col("line_no").cast("long").alias("line_no"), "k.a", "k.b")
    found = each.alias("l").join(keys.alias("k"), (F.col("l.a") == F.col("k.a")) & (F.col("l.b") == F.col("k.b")) & F.col("l.source").eqNullSafe(F.col("k.source")))
    return found.select("l.chunk_id", "l.line_no", *[F.col(f"k.{c}") for c in keys.columns if c not in ("source", "a", "b")])


def remove_lines(chunks: DataFrame, flagged: DataFrame) -> DataFrame:
    """chunks with text_chunk put together again by position without the flagged lines; chunks that lose none stay as they are.

    Only chunks that lose lines are taken apart: their lines are anti-joined with the flagged ones and joined again in order. A chunk that
    loses all is empty. Repeated chunk_ids with different texts lose the same line numbers. Columns of chunks are kept.
    """
    gone = flagged.select("chunk_id", "line_no").distinct()
    hit = chunks.join(gone.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "text_chunk").distinct()
    lines = hit.select("chunk_id", "text_chunk", F.posexplode(F.split("text_chunk", "\n")).alias("line_no", "__line")).withColumn("line_no", F.col("line_no").cast("long"))
    left = lines.join(gone, ["chunk_id", "line_no"], "left_anti").groupBy("chunk_id", "text_chunk").agg(F.sort_array(F.collect_list(F.struct("line_no", "__line"))).alias("__left"))
    rest = F.array_join(F.transform("__left", lambda x: x["__line"]), "\n")
    again = hit.join(left, ["chunk_id", "text_chunk"], "left").select("chunk_id", "text_chunk", F.coalesce(rest, F.lit("")).alias("__rest"))
    return chunks.join(again, ["chunk_id", "text_chunk"], "left").withColumn("text_chunk", F.coalesce("__rest", "text_chunk")).drop("__rest").select(*chunks.columns)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(chunk_lines(load(spark, sf_dir, "doc_chunks"), load(spark, sf_dir, "site_docs")), "chunk-lines")


def _frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return flag_lines(lines, frequent_keys(lines))


def _peculiar(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return flag_lines(lines, repeated_keys(lines).where("peculiar"))


def _clean(spark: SparkSession, sf_dir: str, flagged: DataFrame) -> DataFrame:
    return remove_lines(load(spark, sf_dir, "doc_chunks").select("chunk_id", "document_id", "chunk_index", "text_chunk").distinct(), flagged)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that occur in at least 5 distinct documents of their site."""
    return _frequent(spark, sf_dir).select("chunk_id", "line_no").distinct()


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk without its repeated lines."""
    return _clean(spark, sf_dir, _frequent(spark, sf_dir))


def p7_peculiar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of p7_found whose excess over all other sites passes the false-discovery control; significant: that over an average line does."""
    return _peculiar(spark, sf_dir).select("chunk_id", "line_no", "documents", "outside", "significant").distinct()


def p7_peculiar_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk without the lines of p7_peculiar."""
    return _clean(spark, sf_dir, _peculiar(spark, sf_dir))


QUERIES = {"p7_found": p7_found, "p7_clean": p7_clean, "p7_peculiar": p7_peculiar, "p7_peculiar_clean": p7_peculiar_clean}

_P7 = r"""
WITH s AS (SELECT document_id, min(regexp_replace(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#\s]+)', 1)), '^www\.', '')) AS site FROM site_docs GROUP BY document_id),
c AS (SELECT DISTINCT chunk_id, document_id, chunk_index, text_chunk FROM doc_chunks),
l AS (SELECT chunk_id, document_id, unnest(range(len(string_split(text_chunk, chr(10))))) AS line_no, unnest(string_split(text_chunk, chr(10))) AS line FROM c),
k AS (SELECT chunk_id, l.document_id, line_no, site, trim(regexp_replace(regexp_replace(lower(line), '\p{Nd}+', '', 'g'), '[\s\p{Z}\x{85}\x{1c}-\x{1f}]+', ' ', 'g')) AS key FROM l LEFT JOIN s ON l.document_id = s.document_id),
f AS (SELECT site, key FROM k WHERE key <> '' GROUP BY site, key HAVING count(DISTINCT document_id) >= 5),
found AS (SELECT DISTINCT chunk_id, CAST(line_no AS BIGINT) AS line_no FROM k JOIN f ON k.key = f.key AND k.site IS NOT DISTINCT FROM f.site)
"""
SQL = {
    "p7_found": _P7 + "SELECT chunk_id, line_no FROM found",
    "p7_clean": _P7
    + """, t AS (SELECT l.chunk_id, string_agg(line, chr(10) ORDER BY l.line_no) AS rest FROM l WHERE NOT EXISTS (SELECT 1 FROM found WHERE found.chunk_id = l.chunk_id AND found.line_no = l.line_no) GROUP BY l.chunk_id)
SELECT c.chunk_id, c.document_id, c.chunk_index, CASE WHEN c.text_chunk IS NULL THEN NULL ELSE coalesce(t.rest, '') END AS text_chunk FROM c LEFT JOIN t ON c.chunk_id = t.chunk_id""",
}
