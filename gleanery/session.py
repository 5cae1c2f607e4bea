"""Session builder, table access and lineage cuts shared by all plans."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gleanery", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow on; cluster settings given outside win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data directory. Column pruning and pushdown happen in the scan."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; set here only where it is unset (local runs and tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="gleanery-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder as parquet and read it back.

    Like checkpoint(), but columnar: later scans prune columns and push filters, lost executors cost no recomputation,
    and a plan that is used twice is evaluated once (so sampled range partitions and monotonic ids stay the same).
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.parquet(path)
    kept._cut_path = path
    return kept


def discard(df: DataFrame) -> None:
    """Delete what cut() wrote, once all that was derived from it has been written itself."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
