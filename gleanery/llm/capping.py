"""Problem 4: capping records per dominant contributor.

Method: distributed suitor b-matching. Every record proposes to all contributors it lists; a contributor holds its best proposals up to
its capacity and displaces the weakest; a displaced record withdraws everywhere, which may free places for others. As all contributors
order the records alike, the outcome is unique: it is reached here in rounds in which every record that ranks within the free capacity
of all its contributors is held for good, and every record with a full contributor is displaced for good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.sites import site_of
from gleanery.operators.ranking import distributed_row_number
from gleanery.session import cut, discard, load


def quality_order(quality: str, record: str) -> list[Column]:
    """Best quality first; null and NaN last; then the record's id, ascending by bytes."""
    q = F.when(~F.isnan(quality), F.col(quality))
    return [q.desc_nulls_last(), F.col(record).asc()]


def suitor_matching(proposals: DataFrame, capacity: Column | int, record: str = "record_id", contributor: str = "contributor", quality: str = "quality", single: bool = False) -> DataFrame:
    """(record, kept): whether each record holds a place with all contributors it lists.

    proposals: one row for each record and contributor; repeats of a pair count once, a record's best quality counts. capacity: places
    of each contributor, a number or a column of proposals. A null contributor sets no limit. Ties of quality go by record id. single
    promises that each record lists one contributor: then the first proposals settle all, and nothing needs to be written in between.
    Records without any proposal are not in the result.
    """
    open_ = proposals.select(F.col(record).alias("r"), F.col(contributor).alias("c"), F.col(quality).cast("double").alias("q"), (capacity if isinstance(capacity, Column) else F.lit(capacity)).cast("bigint").alias("cap"))
    open_ = open_.groupBy("r", "c").agg(F.max(F.when(~F.isnan("q"), F.col("q"))).alias("q"), F.min("cap").alias("cap"))
    if not single:
        best = open_.groupBy("r").agg(F.max("q").alias("q"))
        open_ = open_.drop("q").join(best, "r")
    settled = None
    while True:
        ranked = distributed_row_number(open_, ["c"], quality_order("q", "r"), "place")
        within = (F.col("place") <= F.col("cap")) | F.col("c").isNull()
        if single:
            return ranked.groupBy("r").agg(F.min(within).alias("kept")).select(F.col("r").alias(record), "kept")
        held = cut(ranked.groupBy("r").agg(F.min(within).alias("all_within")).where("all_within").select("r"), "held")
        taken = open_.join(held, "r", "left_semi").groupBy(F.col("c").alias("tc")).agg(F.count("*").alias("taken"))
        rest = open_.join(held, "r", "left_anti").join(taken, F.col("c").eqNullSafe(F.col("tc")), "left").select("r", "c", "q", (F.col("cap") - F.coalesce("taken", F.lit(0))).alias("cap"))
        out = rest.groupBy("r").agg(F.max((F.col("cap") <= 0) & F.col("c").isNotNull()).alias("full"))
        out = cut(out.where("full").select("r"), "displaced")
        verdicts = held.withColumn("kept", F.lit(True)).unionByName(out.withColumn("kept", F.lit(False)))
        settled = verdicts if settled is None else settled.unionByName(verdicts)
        before, open_ = open_, cut(rest.join(out, "r", "left_anti"), "open")
        discard(before)
        if open_.isEmpty():
            return settled.select(F.col("r").alias(record), "kept")


def site_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct documents of site_docs: record_id, contributor (site of the url), quality (content_quality_score of processed_docs)."""
    docs = load(spark, sf_dir, "site_docs").groupBy("document_id").agg(F.min(site_of(F.col("url"))).alias("contributor"))
    score = F.when(~F.isnan("content_quality_score"), F.col("content_quality_score"))
    scores = load(spark, sf_dir, "processed_docs").groupBy("document_id").agg(F.max(score).alias("quality"))
    return docs.join(scores, "document_id", "left").withColumnRenamed("document_id", "record_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents beyond the first max(3, N / 100) of their site by quality."""
    docs = site_documents(spark, sf_dir)
    n = load(spark, sf_dir, "site_docs").select("document_id").distinct().count()
    kept = suitor_matching(docs, max(3, n // 100))
    return kept.where(~F.col("kept")).select(F.col("record_id").alias("document_id"))


def p4_sites_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, kept) where a document needs a place with its site and with each of its authors, max(3, N / 100) places each."""
    docs = site_documents(spark, sf_dir)
    n = load(spark, sf_dir, "site_docs").select("document_id").distinct().count()
    names = F.filter(F.transform(F.split("author_name", r"\s*[,;&]\s*|\s+and\s+"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    authors = load(spark, sf_dir, "site_docs").select(F.col("document_id").alias("record_id"), F.explode(names).alias("name")).distinct()
    listed = docs.withColumn("contributor", F.concat(F.lit("site:"), "contributor"))
    listed = listed.unionByName(authors.join(docs.select("record_id", "quality"), "record_id").select("record_id", F.concat(F.lit("author:"), "name").alias("contributor"), "quality"))
    return suitor_matching(listed, max(3, n // 100)).select(F.col("record_id").alias("document_id"), "kept")


QUERIES = {"p4_found": p4_found, "p4_sites_authors": p4_sites_authors}

SQL = {
    "p4_found": r"""
WITH d AS (SELECT document_id, min(regexp_replace(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#\s]+)', 1)), '^www\.', '')) AS site FROM site_docs GROUP BY document_id),
s AS (SELECT document_id, max(CASE WHEN NOT isnan(content_quality_score) THEN content_quality_score END) AS q FROM processed_docs GROUP BY document_id),
n AS (SELECT greatest(3, count(*) // 100) AS places FROM d),
r AS (SELECT d.document_id, row_number() OVER (PARTITION BY site ORDER BY q DESC NULLS LAST, d.document_id) AS place FROM d LEFT JOIN s ON d.document_id = s.document_id)
SELECT document_id FROM r, n WHERE place > places
"""
}
