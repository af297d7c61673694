"""Structured Streaming: deduplication, daily totals, sticky saturation.

Each query also runs as a batch; a stream with the availableNow trigger gives the batch's rows. State is bounded: ids within
the watermark, one row per day, one flag per article.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Ids that share a row of state; a power of two.
BLOCK = 256


def fed(spark: SparkSession, batches: list[DataFrame], path: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Runs a stream over each batch in turn: the batch's files are added to the folder, the stream goes on from its checkpoint and
    takes them as one micro-batch, however many they are.
    """
    for batch in batches:
        batch.write.mode("append").parquet(path)
        start(spark.readStream.schema(batch.schema).parquet(path)).awaitTermination()


def deduplicated(events: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the delay."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def daily_totals(events: DataFrame, ts: str, value: Column, delay: str = "1 day", zone: str = "UTC") -> DataFrame:
    """Sum per local day of the zone (ts in UTC); a day is final when the watermark has passed it."""
    rows = events.withColumn(ts, F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone))
    rows = rows.withWatermark(ts, delay) if events.isStreaming else rows
    return rows.groupBy(F.window(ts, "1 day").alias("w")).agg(F.sum(value).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "total")


def sticky_saturation(judged: DataFrame, share: float, least: int) -> DataFrame:
    """judged (item_id, found boolean) as a stream: item_id, checked, found, saturated; once saturated, an article stays so.

    The state of BLOCK neighbouring ids is one row, so that Python counts them at once and isn't called for every article.
    """

    def step(key, frames, state: GroupState):
        sums = np.zeros((3, BLOCK), np.int64)  # checked, found, saturated by the id's place in its block
        if state.exists:
            places, *known = state.get
            sums[:, list(places)] = np.array([list(x) for x in known])
        came = np.zeros(BLOCK, bool)
        for pdf in frames:
            place, found = pdf["place"].to_numpy(), pdf["found"].fillna(False).to_numpy(bool)
            came[place] = True
            sums[0] += np.bincount(place, minlength=BLOCK)
            sums[1] += np.bincount(place[found], minlength=BLOCK)
        # Judged once a micro-batch, not once a frame of it.
        checked, found, saturated = sums
        saturated |= (checked >= least) & (found > share * checked)
        known, now = np.flatnonzero(checked), np.flatnonzero(came)
        state.update((known.tolist(), *sums[:, known].tolist()))
        ids = [None] * len(now) if key[0] is None else key[0] * BLOCK + now
        yield pd.DataFrame({"item_id": ids, "checked": checked[now], "found": found[now], "saturated": saturated[now] > 0})

    out, kept = "item_id long, checked long, found long, saturated boolean", "places array<int>, checked array<long>, found array<long>, saturated array<long>"
    block = F.shiftright(F.col("item_id").cast("long"), BLOCK.bit_length() - 1).alias("block")
    rows = judged.select(block, F.coalesce(F.pmod("item_id", F.lit(BLOCK)), F.lit(0)).cast("int").alias("place"), "found")
    return rows.groupBy("block").applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.NoTimeout)
