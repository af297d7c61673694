"""Operator 8: benchmark decontamination, DataFrame functions only.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. The windows of a benchmark item are its `window`
consecutive words, or all of its words if it has fewer. Their 64-bit hashes go to every task as one hash set; a document's
window hashes are built by doubling over its array of word hashes, in the row, so that no window is shuffled. A hit is
verified by the words themselves. Words inside a verified occurrence are hit.

The benchmark's windows are a set of fixed size that doesn't grow with the corpus; that is checked: beyond `max_windows`
rows (an item's window each) the hash set becomes an equi-join on the hash instead, whose matches go back to their documents.

Defined results: null, empty and wordless texts have no words and no hits; so do items without words. Rows that repeat a
doc_id with the same text count as one document. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semrank.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Decontamination:
    window: int = 10
    max_windows: int = 200_000


def words(text: Column) -> Column:
    """Array of the normalised words; null for null."""
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.filter(F.split(low, GAPS), lambda w: w != "")


def with_windows(df: DataFrame, sizes) -> DataFrame:
    """df (with array column words) with columns h<n>, for each n of sizes: the hash of each n consecutive words."""
    df = df.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    have = {1}

    def build(n: int, df: DataFrame) -> DataFrame:
        if n in have:
            return df
        high = 1 << (n.bit_length() - 1)
        a, b = (high // 2, high // 2) if n == high else (high, n - high)
        df = build(b, build(a, df))
        have.add(n)
        starts = F.slice(f"h{a}", F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(0)))
        return df.withColumn(f"h{n}", F.transform(starts, lambda x, i: F.xxhash64(x, F.get(F.col(f"h{b}"), i + a))))

    for n in sizes:
        df = build(n, df)
    return df


def benchmark_windows(items: DataFrame, p: Decontamination) -> DataFrame:
    """(item_id, n, h, w): size, hash and words of each distinct window of each item."""
    parts = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    sizes = range(1, p.window + 1)
    n = F.least(F.size("words"), F.lit(p.window))
    hashed = with_windows(parts, sizes).withColumn("n", n)
    h = F.coalesce(*[F.when(F.col("n") == k, F.col(f"h{k}")) for k in sizes])
    one = hashed.select("item_id", "words", "n", F.posexplode(h).alias("i", "h"))
    return one.select("item_id", "n", "h", F.slice("words", F.col("i") + 1, F.col("n")).alias("w")).distinct()


def _windows_at(df: DataFrame, positions: dict[int, Column]) -> DataFrame:
    """df with array column hits: struct(n, i, h, w) of the windows at the positions of each size."""
    def at(n):
        return F.transform(positions[n], lambda i: F.struct(F.lit(n).alias("n"), i.alias("i"), F.get(F.col(f"h{n}"), i).alias("h"), F.slice("words", i + 1, n).alias("w")))

    return df.withColumn("hits", F.concat(*[at(n) for n in positions]))


def _positions(n: int, wanted: list[int]) -> Column:
    """Starts of the windows of n words whose hash is in the set."""
    return F.array_compact(F.transform(f"h{n}", lambda h, i: F.when(h.isin(wanted), i)))


def hits(docs: DataFrame, items: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """(doc_id, key, n_words, n, i, item_id): verified occurrences of items' windows, at least one row per document."""
    bench = stored(benchmark_windows(items, p), "windows")
    found = bench.select("n", "h").distinct()
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.coalesce(words(F.col("text")), F.array()).alias("words"))
    sizes = [r.n for r in found.select("n").distinct().collect()]  # at most `window` sizes
    if not sizes:
        return rows.select("doc_id", "key", F.size("words").alias("n_words"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("int").alias("i"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"))
    rows = with_windows(rows, sizes)
    small = bench.count() <= p.max_windows  # rows of bench: an item's window each, also where items share windows
    if small:
        sets = {n: [] for n in sizes}
        for r in found.collect():
            sets[r.n].append(r.h)
        marked = _windows_at(rows, {n: _positions(n, sets[n]) for n in sizes})
    else:
        each_window = lambda n: F.transform(f"h{n}", lambda h, i: F.struct(F.lit(n).alias("n"), i.alias("i"), h.alias("h")))
        every = rows.select("doc_id", "key", F.explode(F.concat(*[each_window(n) for n in sizes])).alias("x")).select("doc_id", "key", "x.*")
        matched = every.join(found, ["n", "h"]).groupBy("doc_id", "key").agg(*[F.collect_set(F.when(F.col("n") == n, F.col("i"))).alias(f"at{n}") for n in sizes])
        back = matched.withColumnRenamed("doc_id", "same_id").withColumnRenamed("key", "same_key")
        none = F.array().cast("array<int>")
        marked = _windows_at(rows.join(back, F.col("doc_id").eqNullSafe(F.col("same_id")) & (F.col("key") == F.col("same_key")), "left"), {n: F.coalesce(f"at{n}", none) for n in sizes})
    each = marked.select("doc_id", "key", F.size("words").alias("n_words"), F.explode_outer("hits").alias("x")).select("doc_id", "key", "n_words", "x.*")
    return each.join(F.broadcast(bench) if small else bench, ["n", "h", "w"], "left").select("doc_id", "key", "n_words", "n", "i", "item_id")


def contamination(docs: DataFrame, items: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and hit_words: the positions of the hit words."""
    found = hits(docs, items, p)
    span = F.when(F.col("item_id").isNotNull(), F.expr("sequence(i, i + n - 1)"))
    by_doc = found.groupBy("doc_id", "key", "n_words").agg(F.array_distinct(F.flatten(F.collect_set(span))).alias("hit_words"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    n_hit = F.size("hit_words").cast("long")
    return by_doc.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "hit_words",
    )


def remove_documents(docs: DataFrame, items: DataFrame, most_share: float = 0.0, p: Decontamination = Decontamination()) -> DataFrame:
    """docs without those of whose words more than the share most_share are hit."""
    bad = contamination(docs, items, p).where((F.col("n_hit") > 0) & (F.col("n_hit") > most_share * F.col("n_words"))).select("doc_id").distinct()
    return docs.join(bad.hint("shuffle_hash"), "doc_id", "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """doc_id, text: the normalised words that are not hit, joined by one space."""
    found = contamination(docs, items, p).select("doc_id", "hit_words").groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("hit_words"))).alias("hit_words"))
    rows = docs.select("doc_id", F.coalesce(words(F.col("text")), F.array()).alias("words")).join(found, "doc_id", "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("words") - 1), F.coalesce("hit_words", F.array().cast("array<int>")))
    kept = F.when(F.size("words") > 0, F.transform(left, lambda i: F.get("words", i))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", F.array_join(kept, " ").alias("text"))
