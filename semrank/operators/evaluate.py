"""Evaluation of judgments against labels and of two runs against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semrank.operators.ranks import numbered


def share(part, whole) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 9)


def precision_recall(rows: DataFrame, group: str, thresholds) -> DataFrame:
    """rows (group, p, relevant): precision, recall and number found at each threshold."""
    at = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    found = F.col("p") >= F.col("threshold")
    sums = at.groupBy(group, "threshold").agg(F.count_if(found).alias("found"), F.count_if(found & F.col("relevant")).alias("right"), F.count_if("relevant").alias("relevant"))
    return sums.select(group, "threshold", "found", share(F.col("right"), F.col("found")).alias("precision"), share(F.col("right"), F.col("relevant")).alias("recall"))


def accuracy_by_certainty(rows: DataFrame, steps: int = 4) -> DataFrame:
    """rows (p, relevant): accuracy at 0.5 by bands of certainty 2|p - 0.5|."""
    band = F.least(F.floor(F.abs(F.col("p") - 0.5) * 2 * steps), F.lit(steps - 1))
    right = (F.col("p") >= 0.5) == F.col("relevant")
    return rows.groupBy(band.alias("band")).agg(F.count("*").alias("n"), share(F.count_if(right), F.count("*")).alias("accuracy"))


def spearman(rows: DataFrame, group: str, key: str) -> DataFrame:
    """rows (group, key, a, b): rank correlation of each group by 1 - 6 sum d^2 / n(n^2 - 1); ties rank by key."""
    both = numbered(numbered(rows, ["a", key], [group], "_a"), ["b", key], [group], "_b")
    d = both.withColumn("d", F.col("_a") - F.col("_b")).groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("d")).alias("dd"))
    return d.select(group, "n", F.round(1 - F.try_divide(6 * F.col("dd"), F.col("n") * (F.col("n") * F.col("n") - 1)), 9).alias("rho"))


def topk_overlap(rows: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """How many of each group's k highest by a are among its k highest by b; ties rank by key.

    A rank that is compared with k is limited in each task before the shuffle: no task meets more than k rows a group and task.
    """

    def best(c):
        by = Window.partitionBy(group).orderBy(F.col(c).desc(), key)
        return rows.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= k)

    marks = best("a").select(group, key, F.lit(1).alias("m")).unionByName(best("b").select(group, key, F.lit(2).alias("m")))
    return marks.groupBy(group, key).agg(F.sum("m").alias("m")).groupBy(group).agg(F.count_if(F.col("m") == 3).alias("shared"))


def drift(rows: DataFrame, group: str) -> DataFrame:
    """Agreement at 0.5, mean absolute difference, and flips of two runs."""
    flip = (F.col("a") >= 0.5) != (F.col("b") >= 0.5)
    return rows.groupBy(group).agg(F.count_if(flip).alias("flips"), share(F.count_if(~flip), F.count("*")).alias("agreement"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 6).alias("drift"))
