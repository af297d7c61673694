"""Tables written to the session's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The session's shared folder: spark.checkpoint.dir, else the context's checkpoint folder, else, on a local master only, a
    temporary one that becomes the context's.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="semrank-"))
        at = sc._jsc.sc().getCheckpointDir().get()
    return at.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: several readers compute it once, and lost executors don't lose it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
