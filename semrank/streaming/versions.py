"""The item table as versions that share files: copy on write by bucket of sources.

A version is a manifest, a row per bucket with the folder that holds it. Folding a batch of entries into version n rewrites the
buckets of the batch's sources and names the old folders for all others, so a batch costs what its own sources hold. The fold is
a function of (version n, batch n): one that runs again after a failure writes version n + 1 again, and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from semrank.operators import store
from semrank.sources.scratch import written

BUCKETS = 16
MANIFEST = "bucket int, made int, rows long, last_id long"


def bucket(buckets: int = BUCKETS) -> Column:
    """All entries of a source meet in one bucket, as their ids and urls are compared within it."""
    return F.pmod("source_id", F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, root: str, n: int) -> DataFrame:
    """(bucket, made, rows, last_id) of version n: the version whose files hold the bucket, its rows and largest id."""
    return spark.read.schema(MANIFEST).parquet(f"{root}/versions/n={n}")


def _schema(rows: DataFrame) -> StructType:
    return StructType([f for f in rows.schema if f.name != "bucket"])


def _publish(rows: DataFrame, root: str, n: int, others: DataFrame | None) -> None:
    """rows (with bucket) as files of version n, and its manifest, with the buckets of others where they were. Each task writes the
    rows that it holds: texts don't move again, and no task holds a bucket.
    """
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/n={n}")
    made = rows.sparkSession.read.schema(rows.schema).parquet(f"{root}/data/n={n}").groupBy("bucket").agg(F.lit(n).alias("made"), F.count("*").alias("rows"), F.max("id").alias("last_id"))
    made = made.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in MANIFEST.split(", "))])
    (made if others is None else made.unionByName(others)).write.mode("overwrite").parquet(f"{root}/versions/n={n}")


def create(items: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """items as version 0."""
    _publish(items.withColumn("bucket", bucket(buckets)), root, 0, None)


def read(spark: SparkSession, root: str, n: int, schema: StructType, only: list[int] | None = None) -> DataFrame:
    """Rows of version n, of all buckets or of those given."""
    wanted = manifest(spark, root, n)
    wanted = wanted if only is None else wanted.where(F.col("bucket").isin(only))
    paths = [f"{root}/data/n={r.made}/bucket={r.bucket}" for r in wanted.select("bucket", "made").collect()]  # at most a row per bucket
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def fold(batch: DataFrame, root: str, n: int, now: Column, schema: StructType, buckets: int = BUCKETS) -> None:
    """Version n + 1: the entries of a batch folded into version n."""
    spark = batch.sparkSession
    entries = written(batch, "entries")
    touched = [r.bucket for r in entries.select(bucket(buckets).alias("bucket")).distinct().collect()]  # at most a row per bucket
    before = manifest(spark, root, n)
    last = before.agg(F.coalesce(F.max("last_id"), F.lit(-1))).first()[0]
    after = store.upsert(read(spark, root, n, schema, touched), entries, now, F.lit(last)).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    _publish(after.withColumn("bucket", bucket(buckets)), root, n + 1, before.where(~F.col("bucket").isin(touched)))


def drop_old(spark: SparkSession, root: str, n: int, keep: int = 2) -> None:
    """Deletes versions before the last `keep` up to n, and the files that no version left names."""
    used = {r.made for k in range(max(0, n - keep + 1), n + 1) for r in manifest(spark, root, k).select("made").distinct().collect()}
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for part, kept in (("versions", set(range(max(0, n - keep + 1), n + 1))), ("data", used)):
        for status in files.listStatus(hadoop(f"{root}/{part}")):
            if int(status.getPath().getName().split("=")[1]) <= n and int(status.getPath().getName().split("=")[1]) not in kept:
                files.delete(status.getPath(), True)


def upserted(entries: DataFrame, root: str, checkpoint: str, now: Column, schema: StructType, buckets: int = BUCKETS):
    """Folds a stream of entries into versions of the table under root; batch n makes version n + 1."""
    step = lambda batch, n: fold(batch, root, n, now, schema, buckets)
    return entries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
