"""Corpus pipeline: toxicity, line dedup, near dedup, benchmark decontamination, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents that it keeps, the last one
the packed pieces. run() applies them to the documents table, each stage written to the shared folder before the next; a
stage's input is deleted when its output is written.

Defined results: stages but the last return those of the columns doc_id, text, lang, source, n_chars that their input has; other columns are
dropped, so their names don't matter. A null text has no words, lines or tokens: it is kept, and packed as its end id. Rows
without doc_id are kept by the first four stages. Rows that repeat a doc_id stay and go together in stages 1, 3 and 4, and keep their own lines
in stage 2, as line_dedup says, also where their texts differ. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semrank.llm import decontamination, line_dedup, minhash, packing, toxicity
from semrank.llm.common import forget, stored
from semrank.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[c for c in COLUMNS if c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all their labels, scores under 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, labels)
    return toxicity.keep(_columns(docs), model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of repeated windows; those that lose all their lines go."""
    docs = _columns(docs)
    more = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    done = line_dedup.deduplicate_lines(docs, keep=more)
    done = done.where((F.col("n_removed") == 0) | (F.col("n_left") > 0))
    if "n_chars" in more:
        done = done.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return done.select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate class."""
    docs = _columns(docs)
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = _columns(docs)
    return decontamination.remove_documents(docs, items).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: Neither the classifier nor the tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
