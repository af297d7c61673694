"""Operator 13: a corpus in random order over shards, by a two-pass external shuffle, DataFrame functions only.

1. Scatter: each row goes to one of many buckets by a seeded hash of its place in the input and its doc_id, so uniformly, also
   where rows repeat. The number of buckets follows from the bytes, such that a bucket fits in a task's memory. Spark's shuffle
   is the external store of this pass.
2. Shuffle: a bucket's rows are gathered, put into an order that doesn't depend on how they came, and exchanged by Fisher and
   Yates' method, which is what shuffle() does; then they are written, with their places in the bucket.
3. The buckets' sizes, one row per bucket, give each bucket its first place in the whole order. Shards are consecutive parts of
   it whose numbers of rows differ by at most one (law `rows`), slots are places in the shard.

A shard's rows so lie in few files of the second pass, and writing shards moves nothing again.

Memory: a task holds a bucket, of about bucket_bytes or of one longer text. There are at most `most_buckets` buckets (beyond
that, they grow), so the table of first places, which is broadcast, has a bound: 16 bytes each. Repeats: with one seed, one
input layout and one number of partitions the order is the same.

Recovery: places in the input are those of a scan, so docs should be read from storage (a table, files); a task that runs again
deals its rows alike, and after the second pass everything is a written table.

Defined results: null text counts as empty with size 1. Rows that repeat a doc_id or all of a row are dealt like others. All
columns are kept, but for those named shard or slot, which are replaced. Without rows there is no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semrank.llm.common import stored

LAW = "rows"


@dataclass(frozen=True)
class Sharding:
    shards: int = 16
    seed: int = 11
    bucket_bytes: int = 8 << 20
    most_buckets: int = 1 << 20


def size(text: Column) -> Column:
    """Bytes of a record: its text's in UTF-8 and one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shuffled(docs: DataFrame, p: Sharding = Sharding()) -> DataFrame:
    """(row, bucket, at): the rows of docs as structs, each with its place in its bucket; a written table."""
    total = docs.agg(F.sum(size(F.col("text")))).first()[0] or 0
    buckets = min(p.most_buckets, max(1, -(-total // p.bucket_bytes)))
    # The place in the input, hashed with the seed: the bucket, and the order before the exchange.
    tie = F.xxhash64(F.lit(p.seed), F.monotonically_increasing_id(), "doc_id")
    dealt = docs.select(F.struct(*docs.columns).alias("row"), tie.alias("tie")).withColumn("bucket", F.pmod(F.hash(F.lit(p.seed), "tie"), F.lit(buckets)))
    gathered = dealt.repartition(buckets, "bucket").groupBy("bucket").agg(F.collect_list(F.struct("tie", "row")).alias("rows"))
    ordered = F.array_sort("rows", lambda a, b: F.when(a["tie"] < b["tie"], -1).when(a["tie"] > b["tie"], 1).otherwise(0))
    mixed = gathered.select("bucket", F.shuffle(ordered, p.seed).alias("rows"))
    return stored(mixed.select("bucket", F.posexplode("rows").alias("at", "x")).select("x.row", "bucket", "at"), "shuffled")


def shards(docs: DataFrame, p: Sharding = Sharding()) -> DataFrame:
    """docs with shard (0 to p.shards - 1) and slot (0, 1, 2 ... in the shard)."""
    mixed = shuffled(docs, p)
    sizes = mixed.groupBy("bucket").agg(F.count("*").alias("n"))
    n = stored(sizes, "buckets")
    total = n.agg(F.sum("n")).first()[0] or 0
    first = n.select("bucket", F.expr("coalesce(sum(n) over (order by bucket rows between unbounded preceding and 1 preceding), 0)").alias("first"))
    each, more = divmod(total, p.shards)
    # The first `more` shards have a row more.
    place, large = F.col("first") + F.col("at"), more * (each + 1)
    in_large = place < large
    rest = place - large
    shard = F.when(in_large, F.floor(place / (each + 1))).otherwise(more + F.floor(rest / max(each, 1)))
    slot = F.when(in_large, F.pmod(place, F.lit(each + 1))).otherwise(F.pmod(rest, F.lit(max(each, 1))))
    rows = mixed.join(F.broadcast(first), "bucket")  # at most p.most_buckets rows
    keep = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    return rows.select(*keep, shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write(docs: DataFrame, path: str, p: Sharding = Sharding()) -> None:
    """docs as a folder of Parquet files per shard, each in the order of its slots."""
    shards(docs, p).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
