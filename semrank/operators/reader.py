"""Passages of an article: sections, caps, saturation, hits, marks, order of checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semrank.constants import PASSAGE_COUNT, SATURATION_CHECKED, SATURATION_SHARE
from semrank.functions.judge import FOUND, NOTHING, UNSURE, passage_band
from semrank.functions.text import collapse


def in_order(*more) -> Window:
    return Window.partitionBy("item_id", *more).orderBy("idx")


def from_plain_text(df: DataFrame, text: str) -> DataFrame:
    """item_id, idx, text: paragraphs are separated by blank lines, single line feeds are hard wraps."""
    parts = F.filter(F.transform(F.split(text, r"\n[ \t\r]*\n"), collapse), lambda x: x != "")
    return df.select("item_id", F.posexplode(parts).alias("idx", "text")).select("item_id", F.col("idx").cast("long").alias("idx"), "text")


def sections(passages: DataFrame) -> DataFrame:
    """With the nearest heading above each passage, '' before the first; a heading's own section is the one before it."""
    above = F.last(F.when(F.col("level").isNotNull(), F.col("text")), ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    return passages.withColumn("section", F.coalesce(above, F.lit("")))


def without_empty_sections(passages: DataFrame, levels: int = 6) -> DataFrame:
    """Headings without body text before the next heading of their level or a higher one go."""
    # Read from the end, so that frames only grow: one that shrinks is summed up anew for every row.
    below = Window.partitionBy("item_id").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    body = F.min(F.when(F.col("level").isNull(), F.col("idx"))).over(below)
    ends = F.lit(None).cast("long")
    for n in range(levels, 0, -1):
        ends = F.when(F.col("level") == n, F.min(F.when(F.col("level") <= n, F.col("idx"))).over(below)).otherwise(ends)
    rows = passages.withColumn("_body", body).withColumn("_end", ends)
    return rows.where(F.col("level").isNull() | (F.col("_body").isNotNull() & (F.col("_end").isNull() | (F.col("_body") < F.col("_end"))))).drop("_body", "_end")


def capped(passages: DataFrame) -> DataFrame:
    """The first PASSAGE_COUNT passages of each article."""
    return passages.withColumn("_n", F.row_number().over(in_order())).where(F.col("_n") <= PASSAGE_COUNT).drop("_n")


def saturation(passages: DataFrame) -> DataFrame:
    """Per article of judged passages (p null where unchecked): judgeable, checked, found, unsure, saturated."""
    band = passage_band(F.col("p"))
    counts = passages.groupBy("item_id").agg(F.count("*").alias("judgeable"), F.count("p").alias("checked"), F.count_if(band == FOUND).alias("found"), F.count_if(band == UNSURE).alias("unsure"))
    enough = (F.col("checked") > 0) & (F.col("checked") >= F.least(F.lit(SATURATION_CHECKED), F.col("judgeable")))
    return counts.withColumn("saturated", enough & (F.col("found") > SATURATION_SHARE * F.col("checked")))


def marks(passages: DataFrame, articles: DataFrame) -> DataFrame:
    """mark of each passage (found, unsure, none, unchecked; none for headings and in saturated articles)."""
    band = passage_band(F.col("p"))
    rows = passages.join(articles.select("item_id", "saturated"), "item_id", "left")
    mark = F.when(F.col("level").isNotNull(), "none").when(F.col("p").isNull(), "unchecked").when(F.coalesce("saturated", F.lit(False)) | (band == NOTHING), "none").when(band == FOUND, "found").otherwise("unsure")
    return rows.withColumn("mark", mark)


def hits(marked: DataFrame) -> DataFrame:
    """Found and unsure passages in reading order: hit number, the next hit (the first one after the last) and the one before."""
    rows = marked.where(F.col("mark").isin("found", "unsure"))
    first, last = (f("idx").over(Window.partitionBy("item_id")) for f in (F.min, F.max))
    rows = rows.withColumn("hit", F.row_number().over(in_order()).cast("long"))
    return rows.withColumns({"next_idx": F.coalesce(F.lead("idx").over(in_order()), first), "previous_idx": F.coalesce(F.lag("idx").over(in_order()), last)})


def viewport_first(passages: DataFrame, first: Column, last: Column, chunk: int) -> DataFrame:
    """Order of checking: what is on screen, then the rest, in chunks of `chunk`."""
    order = Window.partitionBy("item_id").orderBy(~F.col("idx").between(first, last), "idx")
    rows = passages.withColumn("position", F.row_number().over(order).cast("long"))
    return rows.withColumn("chunk", F.floor((F.col("position") - 1) / chunk))
