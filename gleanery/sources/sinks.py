"""Writers: page batches, tagged JSON lines, keyed upserts by partition, retention, queue shards, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARDS = 16


def write_pages(df: DataFrame, path: str, batch: int = 100) -> None:
    """Raw pages as JSON lines, `batch` rows in a file."""
    df.write.mode("append").option("maxRecordsPerFile", batch).json(path)


def tagged(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents and chunks as one relation with `type`."""
    return documents.withColumn("type", F.lit("document")).unionByName(chunks.withColumn("type", F.lit("chunk")), allowMissingColumns=True)


def write_tagged(documents: DataFrame, chunks: DataFrame, path: str, part: int = 1000) -> None:
    tagged(documents, chunks).write.mode("append").option("maxRecordsPerFile", part).json(path)


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: what an upsert by id leaves. Keys with null are kept as one key each."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(spark: SparkSession, new: DataFrame, path: str, key: list[str], order: list[Column], partition: str) -> None:
    """Merge new rows into a parquet table by key, rewriting only the partitions that new touches.

    The merged rows are written beside the table and then replace its touched partitions (dynamic partition overwrite), so a lost executor
    repeats its tasks without losing rows. Rows of unknown partitions (null) are dropped, as an index without a date can't take them.
    """
    new = new.where(F.col(partition).isNotNull())
    try:
        old = spark.read.parquet(path)
    except Exception:  # noqa: BLE001 - no table yet
        latest(new, key, order).write.partitionBy(partition).parquet(path)
        return
    touched = new.select(partition).distinct()
    merged = old.join(F.broadcast(touched) if touched.count() < 10000 else touched, partition, "left_semi").unionByName(new, allowMissingColumns=True)
    from gleanery.session import cut

    cut(latest(merged, key, order), "upsert").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def expired(partitions: DataFrame, date: str, as_of: str, days: int = 90) -> DataFrame:
    """The daily partitions that are older than `days`."""
    return partitions.where(F.col(date) < F.date_sub(F.to_date(F.lit(as_of)), days))


def shard(url: Column) -> Column:
    """Shard of the disk queue a URL belongs to."""
    return F.pmod(F.xxhash64(url), F.lit(SHARDS)).cast("int")


def append_queue(urls: DataFrame, path: str) -> None:
    urls.withColumn("shard", shard(F.col("url"))).write.mode("append").partitionBy("shard").parquet(path)


def load_queue(spark: SparkSession, path: str, limit: int) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.desc("priority"), "url").limit(limit)


def message_stream(text: Column, words: int = 3) -> Column:
    """A text as the messages of a word stream, `words` words in each."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(words))
    return F.when(text.isNull(), None).when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(w, i, words), " ")))
