"""Session defaults (UTC, adaptive execution, small Arrow batches for large binaries) and folders that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(app: str = "leafpress", **settings: str) -> SparkSession:
    """The active session, or a new one with the defaults; keyword names use __ for dots."""
    build = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        build = build.config(key, value)
    return build.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new folder name inside spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="leafpress-"))
    return f"{context.getCheckpointDir().get()}/leafpress-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that it is computed once and survives lost executors."""
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
