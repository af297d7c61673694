"""Queries of the evaluation: labelled relevance, and two runs of arithmetic probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from semrank.operators import evaluate
from semrank.plans.base import query
from semrank.sources.tables import table

RUNS = "WITH r AS (SELECT doc_id, lang, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS a, (doc_id * 7919 % 1000 + doc_id * 271 % 300) / 1300.0::DOUBLE AS b FROM documents)"
LABELED = f"{RUNS}, l AS (SELECT lang, a AS p, quality = 1 AS relevant FROM r JOIN labels USING (doc_id))"


def _runs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", (F.col("doc_id") * 7919 % 1000 / 1000.0).alias("a"), ((F.col("doc_id") * 7919 % 1000 + F.col("doc_id") * 271 % 300) / 1300.0).alias("b"))


def _labeled(spark, sf):
    return _runs(spark, sf).join(table(spark, sf, "labels"), "doc_id").select("lang", F.col("a").alias("p"), (F.col("quality") == 1).alias("relevant"))


@query("precision_recall", f"""{LABELED}, t AS (SELECT lang, t::DOUBLE AS threshold, count(*) FILTER (p >= t::DOUBLE) AS found, count(*) FILTER (p >= t::DOUBLE AND relevant) AS good, count(*) FILTER (relevant) AS rel FROM l, (VALUES (0.5), (0.6), (0.7), (0.75)) v(t) GROUP BY lang, t)
  SELECT lang, threshold, found, CASE WHEN found > 0 THEN round(good / found, 9) ELSE 0 END AS precision, CASE WHEN rel > 0 THEN round(good / rel, 9) ELSE 0 END AS recall FROM t""")  # fmt: skip
def precision_recall(spark, sf):
    return evaluate.precision_recall(_labeled(spark, sf), "lang", (0.5, 0.6, 0.7, 0.75))


@query("accuracy_by_band", f"{LABELED} SELECT least(floor(abs(p - 0.5::DOUBLE) * 2 * 4), 3)::BIGINT AS band, count(*) AS n, round(count(*) FILTER ((p >= 0.5::DOUBLE) = relevant) / count(*), 9) AS accuracy FROM l GROUP BY band")
def accuracy_by_band(spark, sf):
    return evaluate.accuracy_by_certainty(_labeled(spark, sf))


@query("spearman", f"""{RUNS}, k AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY a, doc_id) - row_number() OVER (PARTITION BY lang ORDER BY b, doc_id) AS d FROM r)
  SELECT lang, count(*) AS n, round(1 - 6 * sum(d * d) / (count(*) * (count(*) * count(*) - 1)), 9) AS rho FROM k GROUP BY lang""")  # fmt: skip
def spearman(spark, sf):
    return evaluate.spearman(_runs(spark, sf), "lang", "doc_id")


@query("topk_overlap", f"""{RUNS}, k AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY a DESC, doc_id) AS x, row_number() OVER (PARTITION BY lang ORDER BY b DESC, doc_id) AS y FROM r)
  SELECT lang, count(*) FILTER (x <= 20 AND y <= 20) AS shared FROM k GROUP BY lang""")  # fmt: skip
def topk_overlap(spark, sf):
    return evaluate.topk_overlap(_runs(spark, sf), "lang", "doc_id", 20)


_DRIFT = f"{RUNS} SELECT lang, count(*) FILTER ((a >= 0.5::DOUBLE) <> (b >= 0.5::DOUBLE)) AS flips, round(count(*) FILTER ((a >= 0.5::DOUBLE) = (b >= 0.5::DOUBLE)) / count(*), 9) AS agreement, round(avg(abs(a - b)), 6) AS drift FROM r GROUP BY lang"


@query("drift_agreement", _DRIFT)
def drift_agreement(spark, sf):
    return evaluate.drift(_runs(spark, sf), "lang")


@query("threshold_flips", f"SELECT lang, flips FROM ({_DRIFT})")
def threshold_flips(spark, sf):
    return evaluate.drift(_runs(spark, sf), "lang").select("lang", "flips")


@query("length_percentiles", "SELECT lang, min(length(text)) AS shortest, round(quantile_cont(length(text), 0.5), 6) AS p50, round(quantile_cont(length(text), 0.9), 6) AS p90, max(length(text)) AS longest FROM documents GROUP BY lang")
def length_percentiles(spark, sf):
    n = F.length("text").cast("long")
    of = table(spark, sf, "documents").withColumn("n", n).groupBy("lang")
    return of.agg(F.min("n").alias("shortest"), F.round(F.percentile("n", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("n", F.lit(0.9)), 6).alias("p90"), F.max("n").alias("longest"))


@query("outcome_histogram", "WITH o AS (SELECT CASE WHEN length(text) >= 600 THEN 'ready' WHEN length(text) >= 100 THEN 'short' ELSE 'empty' END AS outcome FROM documents) SELECT outcome, count(*) AS n, round(count(*) / (SELECT count(*) FROM o), 9) AS share FROM o GROUP BY outcome")
def outcome_histogram(spark, sf):
    outcome = F.when(F.length("text") >= 600, "ready").when(F.length("text") >= 100, "short").otherwise("empty")
    counts = table(spark, sf, "documents").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("outcome", "n", evaluate.share(F.col("n"), F.col("total")).alias("share"))  # total: one row
