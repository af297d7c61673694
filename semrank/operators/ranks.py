"""Positions and running sums over groups of any size.

Rows are dealt by range of (group, order), so that a group which holds most rows lies in many partitions; each partition
numbers or sums its own rows, and what the partitions before hold is added from one row per partition (and group). No task
holds more than its share, whatever the groups' sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semrank.sources.scratch import written

#: Groups of more than this share of all rows are fewer than 1,000: their rows stay where they are, and their starts are broadcast.
HOT_SHARE = 0.001


def _dealt(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """rows, sorted within partitions by range, as a written table with their place `_at`: partition * 2^33 + row."""
    by = [*[F.col(c) for c in group], *order]
    return written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ranks")


def _same(left: DataFrame, right: DataFrame, group: list[str]) -> Column:
    """Join condition of equal groups, null being one."""
    out = F.lit(True)
    for c in group:
        out = out & left[c].eqNullSafe(right[f"_{c}"])
    return out


def numbered(rows: DataFrame, order: list, group: list[str] = (), name: str = "position") -> DataFrame:
    """rows with `name`: their place 0, 1, 2 ... in their group in the order given (columns or names).

    The order should tell rows apart: rows that are equal in it meet in one task, and any of them may come first. rows are read
    twice (the ranges are estimated first), so they are cheap or a written table. Null is a group of its own.
    """
    group, order = list(group), [F.col(c) if isinstance(c, str) else c for c in order]
    placed = _dealt(rows, group, order)
    part = F.shiftright("_at", 33)
    # One row per partition.
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("_at", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before")
    if not group:
        return placed.withColumnRenamed("_at", name)
    starts = written(placed.groupBy(*[F.col(c).alias(f"_{c}") for c in group]).agg(F.min("_at").alias("_start"), F.count("*").alias("_n")), "groups")
    groups, total = starts.agg(F.count("*"), F.sum("_n")).first()
    columns = [*rows.columns, (F.col("_at") - F.col("_start")).alias(name)]
    most = -1 if groups <= 1 / HOT_SHARE else total * HOT_SHARE
    hot = starts.where(F.col("_n") > most)
    near = placed.join(F.broadcast(hot), _same(placed, hot, group), "left")
    out = near.where("_start is not null").select(*columns)
    if most < 0:
        return out
    cold = starts.where(F.col("_n") <= most)
    far = near.where("_start is null").select(*placed.columns)
    return out.unionByName(far.join(cold, _same(far, cold, group)).select(*columns))


def running(rows: DataFrame, order: list, value: str, group: list[str] = (), name: str = "before") -> DataFrame:
    """rows with `name`: the sum of `value` over the rows before in their group in the order given; 0 for the first.

    As for numbered(), the order should tell rows apart and rows are read twice. Null values count as 0.
    """
    group, order = list(group), [F.col(c) if isinstance(c, str) else c for c in order]
    placed = _dealt(rows, group, order).withColumn("_part", F.shiftright("_at", 33))
    here = Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_here", F.coalesce(F.sum(value).over(here), F.lit(0)))
    # One row per partition and group.
    sums = placed.groupBy("_part", *group).agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_part").alias("_of"), *[F.col(c).alias(f"_{c}") for c in group], F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    joined = summed.join(sums, (F.col("_part") == F.col("_of")) & _same(summed, sums, group))
    return joined.select(*rows.columns, (F.col("_before") + F.col("_here")).alias(name))
