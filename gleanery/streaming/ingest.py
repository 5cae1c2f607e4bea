"""Structured Streaming: directory ingestion, first-seen URLs, windows over events, crawl state."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.session import checkpoint_dir


def table_stream(spark: SparkSession, sf_dir: str, table: str, files_per_trigger: int = 4) -> DataFrame:
    """A table of a data directory as a file stream, newest files first, a few files in a micro-batch (the back-pressure)."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("latestFirst", True)
    if os.path.isfile(path):  # a file source wants a directory
        return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def first_seen(stream: DataFrame, key: str, time: str, delay: str = "30 days") -> DataFrame:
    """Each key once within the delay: state is dropped behind the watermark, so it stays bounded."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Rows by event-time window and keys; rows later than the delay are left out once their window is closed."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, delay).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))


def session_counts(stream: DataFrame, time: str, key: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now (trigger availableNow) and return what it wrote to the shared folder."""
    spark = stream.sparkSession
    base = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    out, marks = f"{base}/table", f"{base}/marks"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
    else:

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", marks).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
