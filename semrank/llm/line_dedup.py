"""Operator 4: line-level deduplication by overlapping windows of three lines.

Lines are the text split at line feeds; blank ones (white space only) take no part and are kept. Each three consecutive lines
of a document are a window, compared by a 128-bit hash. Of the occurrences of a window, the one with the smallest
(doc_id, position) stays and all later ones are covered; a line goes if a covered window holds it, so overlapping windows
merge.

Skew: windows are aggregated to their first occurrence with map-side combine, and each occurrence joins one row; the
occurrences of a very common window stay where they are and its row is broadcast (common.lookup).

Defined results: a null text stays null and has no lines; texts of fewer than three lines keep all. Rows that repeat a doc_id
with its text keep and lose the same lines; several texts of one doc_id are documents of their own, in the order of a digest.
Rows with a null doc_id keep all lines. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semrank.llm.common import lookup, repeated_ids, stored, text_key

WINDOW = 3


def _lines(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, k, lines, full: the indexes of the lines that aren't blank; and the columns keep."""
    lines = docs.select("doc_id", "k", *[F.col(c).alias(f"keep_{c}") for c in keep], F.split("text", "\n").alias("lines"))
    return lines.withColumn("full", F.array_compact(F.transform("lines", lambda x, i: F.when(x.rlike(r"[^\x09-\x0D\x20]"), i))))


def _told_apart(docs: DataFrame) -> DataFrame:
    """docs with k, which tells the texts of one doc_id apart; 0 where no doc_id repeats."""
    return docs.withColumn("k", F.lit(0).cast("long") if repeated_ids(docs).isEmpty() else text_key())


def _repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, k, pos): windows, by the index of their first line among the document's full lines, that came before."""
    line = lambda i, k: F.get("lines", F.get("full", i + k))
    window = lambda i: F.struct(i.alias("pos"), F.xxhash64(*[line(i, k) for k in range(WINDOW)]).alias("k1"), F.xxhash64(*[line(i, k) for k in reversed(range(WINDOW))], F.lit(7)).alias("k2"))
    rows = _lines(docs).where((F.size("full") >= WINDOW) & F.col("doc_id").isNotNull())
    rows = rows.select("doc_id", "k", F.explode(F.transform(F.sequence(F.lit(0), F.size("full") - WINDOW), window)).alias("w")).select("doc_id", "k", "w.*")
    rows = stored(rows, "line_windows")
    first = rows.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "k", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stored(first, "windows")
    return lookup(rows, first, ["k1", "k2"]).where(F.struct("doc_id", "k", "pos") > F.col("first")).select("doc_id", "k", "pos")


def deduplicate_lines(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_removed, n_left (lines that aren't blank), text (what is left), and the columns
    keep of docs.
    """
    docs = _told_apart(docs.select("doc_id", "text", *keep))
    covered = _repeated_windows(docs).groupBy("doc_id", "k").agg(F.collect_set("pos").alias("starts"))
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + (WINDOW - 1)))))
    # The hint keeps one plan at every size: texts are shuffled, never sorted.
    rows = _lines(docs, keep).join(covered.hint("shuffle_hash"), ["doc_id", "k"], "left")
    lost = F.coalesce(F.transform(gone, lambda i: F.get("full", i)), F.array().cast("array<int>"))
    rows = rows.withColumn("lost", lost)
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")
    return rows.select(
        "doc_id", F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"), F.size("lost").cast("long").alias("n_removed"),
        F.coalesce(F.size("full") - F.size("lost"), F.lit(0)).cast("long").alias("n_left"),
        F.when(F.col("lines").isNotNull(), F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")).alias("text"),
        *[F.col(f"keep_{c}").alias(c) for c in keep],
    )
