"""Operator 12: importance resampling towards a target distribution, with hashed n-gram features, in DataFrame functions only.

Words are those of operator 8. A feature is a run of 1 to `most` consecutive words, joined by one space; its bucket is the crc32
of its bytes modulo `buckets`. A bucket's gain is the log ratio of its smoothed share of the target's features to that of the
corpus, in thousandths. A document's weight is the mean gain of its features; weight plus Gumbel noise, which a seeded hash of
its doc_id gives, orders the documents, and the highest are drawn: without replacement, with odds in proportion to the weights.

1. Each text is read and hashed once: its features' buckets are written as an array of two-byte numbers. Both sides' arrays are
   exploded and counted per bucket; each task adds up its own before the shuffle, so a very frequent word costs no more than a
   rare one.
2. The gains are a table of `buckets` rows, however large the corpus is; it is broadcast and joined to the exploded features,
   whose gains are summed per row of documents, again in the task before the shuffle.
3. The draw sorts documents by range of score; ranks are positions within a partition plus the sizes of those before
   (operators.ranks). Texts are never shuffled.

Defined results: null, empty and wordless texts have no features and weight 0. Rows that repeat a doc_id are scored and drawn
each for itself; among equal ones any may come first. A null doc_id counts as an empty one in the hash and comes first among
ties. Without a target, or without features in it, t and T are 0. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semrank.llm.common import forget, stored
from semrank.llm.decontamination import words
from semrank.operators.ranks import numbered


@dataclass(frozen=True)
class Resampling:
    most: int = 2
    buckets: int = 10_000
    #: Documents of fewer words are not drawn.
    least_words: int = 20
    percent: int = 25
    seed: int = 7


def hashed(rows: DataFrame, p: Resampling) -> DataFrame:
    """rows (with column text) with the number of `words` and the array `buckets`, one element per feature, instead of the text."""
    keep = [c for c in rows.columns if c != "text"]
    split = rows.select(*keep, F.coalesce(words(F.col("text")), F.array()).alias("w"))

    def runs(n: int) -> Column:
        """All runs of n words: of the words from each to the last but n - 1."""
        run = lambda x, i: F.concat_ws(" ", x, *[F.get("w", i + k) for k in range(1, n)])
        return F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(0))), run)

    bucket = lambda x: F.pmod(F.crc32(x.cast("binary")), F.lit(p.buckets)).cast("short" if p.buckets < 1 << 15 else "int")
    grams = F.concat(*[runs(n) if n > 1 else F.col("w") for n in range(1, p.most + 1)])
    return split.select(*keep, F.size("w").cast("long").alias("words"), F.transform(grams, bucket).alias("buckets"))


def _counts(sides: DataFrame, name: str) -> DataFrame:
    return sides.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame, p: Resampling = Resampling()) -> DataFrame:
    """(bucket, gain) of all buckets that docs has; both sides are results of hashed()."""
    counts = stored(_counts(docs, "s").join(_counts(target, "t"), "bucket", "full"), "buckets")  # at most p.buckets rows each
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("all_t"))
    ratio = (F.coalesce("t", F.lit(0)).cast("double") + 1) * (F.col("all_s") + p.buckets) / ((F.col("s").cast("double") + 1) * (F.col("all_t") + p.buckets))
    return counts.join(F.broadcast(total)).where("s is not null").select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))  # total: one row


def weights(docs: DataFrame, gain: DataFrame) -> DataFrame:
    """(doc_id, row, n_words, n_features, weight) per row of docs (doc_id, row, words, buckets)."""
    rows = docs.select("doc_id", "row", "words", F.explode_outer("buckets").alias("bucket"))
    found = rows.join(F.broadcast(gain), "bucket", "left")  # at most p.buckets rows
    sums = found.groupBy("doc_id", "row", "words").agg(F.count("bucket").alias("n_features"), F.sum("gain").alias("gain"))
    mean = F.expr("(gain - pmod(gain, n_features)) div n_features")  # floored, in whole numbers
    return sums.select("doc_id", "row", F.col("words").alias("n_words"), "n_features", F.when(F.col("n_features") > 0, mean).otherwise(F.lit(0)).cast("long").alias("weight"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the hash of seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, p: Resampling = Resampling()) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_features, weight, score, rank (1, 2, 3 ... of the drawn, null for the others)."""
    every = stored(hashed(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), p), "features")
    scored = weights(every, gains(every, hashed(target.select("text"), p), p)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), p.seed))
    scored = stored(scored, "scores")
    forget(every)
    able = F.col("n_words") >= p.least_words
    drawn = scored.where(able).count() * p.percent // 100
    ranked = numbered(scored.where(able), [F.col("score").desc(), "doc_id", "row"], name="rank").withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long"))).drop("row")


def sample(docs: DataFrame, target: DataFrame, p: Resampling = Resampling()) -> DataFrame:
    """The rows of docs that are drawn, by doc_id: of rows that repeat one, all where any is drawn."""
    ids = resample(docs, target, p).where("rank is not null").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(ids.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
