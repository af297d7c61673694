"""Shared Spark pieces of the operators: written tables, Arrow mapping, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semrank.sources.scratch import folder


#: Shuffle files of a finished write are deleted at once, not when the driver's garbage collector finds them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: its lineage ends there and lost executors don't lose it."""
    spark = df.sparkSession
    path = folder(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def forget(df: DataFrame) -> None:
    """Deletes a table of stored() that nothing will read any more."""
    spark, path = df.sparkSession, df._stored_at
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def text_key() -> Column:
    """Tells the texts of one doc_id apart: 60 bits of a cryptographic digest."""
    return F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 15), 16, 10).cast("long")


def repeated_ids(docs: DataFrame) -> DataFrame:
    """The doc_ids, but for null, that several rows have; a written table."""
    return stored(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")


def released(task: Callable) -> Callable:
    """task, a function of mapInArrow, that ends with its worker's free memory given back: workers outlive their tasks, and the
    allocators of Arrow and of C else keep what the largest task of any stage before needed.
    """

    def run(batches):
        yield from task(batches)
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()

    return run


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Each record batch of df through f."""

    def run(batches):
        for batch in batches:
            yield from f(batch)

    return df.mapInArrow(released(run), schema)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) if not isinstance(x, (pa.Array, pa.ChunkedArray)) else x for x in columns.values()], names=list(columns))


def lookup(left: DataFrame, right: DataFrame, on: list[str], size: str = "n", how: str = "inner", most: int = 1000) -> DataFrame:
    """left with the columns of right, which has one row per key; its column `size`, which is dropped, counts the rows of left
    with that key. Keys of more than 1/most of these rows, so fewer than `most` keys, are broadcast and their rows stay where
    they are; the others meet by shuffle. right is read three times and left twice: both are written tables or cheap.
    """
    each = (right.agg(F.sum(size)).first()[0] or 0) / most
    values = [c for c in right.columns if c not in on and c != size]
    hot = right.where(F.col(size) > each).select(*on, F.struct(F.lit(True).alias("_is"), *values).alias("_hot"))
    marked = left.join(F.broadcast(hot), on, "left")
    here = marked.where("_hot is not null").select(*left.columns, *[F.col(f"_hot.{c}").alias(c) for c in values])
    there = marked.where("_hot is null").select(*left.columns).join(right.where(F.col(size) <= each).select(*on, *values), on, how)
    return here.unionByName(there.select(*left.columns, *values))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable from each id of the edges.

    Alternates large-star and small-star steps on written edge tables until nothing changes; each step is two aggregations
    with map-side combine and one join of 16-byte rows with one row per node. A hub's rows are streamed through that join,
    never collected; where they make a partition skewed, adaptive execution splits it.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    now = stored(edges.select(lo.alias("v"), hi.alias("u")).where("v < u").distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # u: the node, v: its neighbour. Larger neighbours go to the smallest of the neighbourhood.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("v"), F.col("v").alias("u")).where("v < u").distinct()
        # Each node and its smaller neighbours go to the smallest of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("m"), F.explode(F.array("u", "v")).alias("u")).where("m < u").select(F.col("m").alias("v"), "u").distinct()
        after = stored(small, "edges")
        forget(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("component"))
    return roots.select(F.col("u").alias("id"), "component").unionByName(roots.select(F.col("component").alias("id"), "component").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal edge sets."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.bit_xor(F.hash("v", "u")), F.lit(0))).first())
