"""Judging and ranking: windows, the cache of judgments, orders of requests, bands, pins.

Sentences are parameters of a query: at most PINS of them, so they are joined by broadcast. Judgments are rows
(text_hash, frame_hash, model, p); p is the raw answer, caps apply when a row is shown. An unchecked pair has no p, not 0.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semrank.constants import FIRST_WINDOW, LIST_UNSURE, LOAD_LIMIT, OLDER_WINDOW, PINS, RANK_STEPS
from semrank.functions import sentence as S
from semrank.functions.judge import FOUND, capped_for_list, list_band, overlap_judge
from semrank.functions.text import overlap, terms


def framed(spark: SparkSession, texts) -> DataFrame:
    """pin_id, sentence (cleaned), frame, frame_hash, unjudgeable (reason or null) of at most PINS sentences."""
    if len(texts) > PINS:
        raise ValueError(f"at most {PINS} sentences")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "pin_id long, raw string").coalesce(1)
    rows = rows.select("pin_id", S.clean(F.col("raw")).alias("sentence")).withColumn("frame", S.frame(F.col("sentence")))
    return rows.withColumn("frame_hash", S.frame_hash(F.col("frame"))).withColumn("unjudgeable", S.unjudgeable("sentence"))


def judged_text(repo="repo_name", title="title", snippet="snippet") -> Column:
    return F.concat_ws(" ", repo, title, snippet)


def by_date(df: DataFrame) -> list[Column]:
    return [F.col("sort_date").desc(), F.col("id").desc()]


def window(items: DataFrame, older: int = 0) -> DataFrame:
    """The newest items that a search judges, widened `older` times."""
    return items.orderBy(*by_date(items)).limit(FIRST_WINDOW + OLDER_WINDOW * older)


def loaded(items: DataFrame, older: int = 0) -> DataFrame:
    """What a pin's list loads: LOAD_LIMIT of the newest items or its window, and whether a row is in the window (judged)."""
    rows = items.orderBy(*by_date(items)).limit(max(LOAD_LIMIT, FIRST_WINDOW + OLDER_WINDOW * older))
    place = F.row_number().over(Window.orderBy(F.col("sort_date").desc(), F.col("id").desc()))  # at most the rows of the limit
    return rows.withColumn("judged", place <= FIRST_WINDOW + OLDER_WINDOW * older)


def matching(items: DataFrame, **wanted) -> DataFrame:
    """Items that meet every condition given: source_id (one or several), read, since, until, words (all of them in the title)."""
    date = F.col("sort_date")
    tests = {
        "source_id": lambda v: F.col("source_id").isin(list(v) if isinstance(v, list | tuple | set) else [v]), "read": lambda v: F.col("read") == v, "since": lambda v: date >= F.lit(v),
        "until": lambda v: date < F.lit(v), "words": lambda v: reduce(and_, (F.contains(F.lower("title"), F.lit(w)) for w in v.lower().split()), F.lit(True)),
    }
    return items.where(reduce(and_, (tests[k](v) for k, v in wanted.items() if v is not None), F.lit(True)))


def pairs(items: DataFrame, sentences: DataFrame) -> DataFrame:
    return items.join(F.broadcast(sentences))  # at most PINS rows


def judge(rows: DataFrame) -> DataFrame:
    """rows of pairs() with p of the overlap judge."""
    return rows.withColumn("p", overlap_judge(judged_text(), F.col("sentence")))


def missing(rows: DataFrame, judgments: DataFrame, model: str) -> DataFrame:
    """The pairs (text_hash, frame_hash) without an answer of the current model."""
    known = judgments.where(F.col("model") == model).select("text_hash", "frame_hash")
    return rows.join(known, ["text_hash", "frame_hash"], "left_anti")


def requests(rows: DataFrame) -> DataFrame:
    """One request per text, with only the frames that miss an answer."""
    return rows.groupBy("text_hash").agg(F.sort_array(F.collect_set("frame_hash")).alias("frames"))  # at most PINS frames


def with_answers(rows: DataFrame, judgments: DataFrame, model: str) -> DataFrame:
    """p of each pair where the current model has answered."""
    known = judgments.where(F.col("model") == model).select("text_hash", "frame_hash", "p")
    return rows.join(known, ["text_hash", "frame_hash"], "left")


def read_your_writes(stored: DataFrame, buffer: DataFrame) -> DataFrame:
    """Stored judgments under those still in the buffer."""
    both = stored.withColumn("_late", F.lit(0)).unionByName(buffer.withColumn("_late", F.lit(1)))
    return both.groupBy("text_hash", "frame_hash", "model").agg(F.max_by("p", "_late").alias("p"))


def banded(rows: DataFrame) -> DataFrame:
    """With the capped probability and its band."""
    capped = capped_for_list(F.col("p"), F.col("unjudgeable").isNotNull())
    return rows.withColumn("shown", capped).withColumn("band", list_band(F.col("shown")))


def ranked(rows: DataFrame) -> DataFrame:
    """A search's list: probability in steps of 0.05, then date; position from 1. rows: banded pairs of one sentence's window."""
    order = Window.orderBy(F.round(F.col("shown") * RANK_STEPS).desc(), F.col("sort_date").desc(), F.col("id").desc())  # a window's rows
    return rows.where(F.col("shown") >= LIST_UNSURE).withColumn("position", F.row_number().over(order).cast("long"))


def pin_lists(rows: DataFrame) -> DataFrame:
    """Each pin's found rows by date, with position and whether they came since the pin was viewed. rows: banded, with viewed."""
    order = Window.partitionBy("pin_id").orderBy(F.col("sort_date").desc(), F.col("id").desc())
    found = rows.where(F.col("band") == FOUND).withColumn("position", F.row_number().over(order).cast("long"))
    return found.withColumn("fresh", F.col("sort_date") > F.coalesce("viewed", F.expr("timestamp_ntz'0001-01-01'")))


def badges(pins: DataFrame, lists: DataFrame) -> DataFrame:
    """New found rows of each pin, 0 included."""
    fresh = lists.where("fresh").groupBy("pin_id").agg(F.count("*").alias("n"))
    return pins.select("pin_id").join(fresh, "pin_id", "left").select("pin_id", F.coalesce("n", F.lit(0)).cast("long").alias("fresh"))


def last_new(lists: DataFrame) -> DataFrame:
    """The row under which each pin's separator goes: the last that is new."""
    return lists.where("fresh").groupBy("pin_id").agg(F.max_by("id", "position").alias("id"))


def hits_first(items: DataFrame, hits: DataFrame, since: Column) -> DataFrame:
    """All items by date, this week's hits (ids that any pin found) before the others."""
    marked = items.join(hits.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    marked = marked.withColumn("marked", F.coalesce("_hit", F.lit(False)) & (F.col("sort_date") > since)).drop("_hit")
    return marked.withColumn("position", F.row_number().over(Window.orderBy(F.col("marked").desc(), F.col("sort_date").desc(), F.col("id").desc())).cast("long"))


def round_robin(items: DataFrame) -> DataFrame:
    """A window's items, the nth of each source in turn, sources by their first item; position from 1."""
    turn = F.row_number().over(Window.partitionBy("source_id").orderBy(*by_date(items)))
    place = F.row_number().over(Window.orderBy(*by_date(items)))  # a window's rows
    rows = items.withColumn("_place", place).withColumn("turn", turn.cast("long")).withColumn("_first", F.min("_place").over(Window.partitionBy("source_id")))
    return rows.withColumn("position", F.row_number().over(Window.orderBy("turn", "_first")).cast("long")).drop("_place", "_first")


def likeliest_first(rows: DataFrame, asked: Column) -> DataFrame:
    """rows of round_robin(), those that share more of the asked words first; unchanged if fewer than two words are asked."""
    shared = F.when(F.size(F.array_distinct(terms(asked))) >= 2, overlap(judged_text(), asked)).otherwise(0)
    rows = rows.withColumn("shared", shared.cast("long"))
    return rows.withColumn("position", F.row_number().over(Window.orderBy(F.col("shared").desc(), "position")).cast("long"))


def append_below(shown: DataFrame, update: DataFrame) -> DataFrame:
    """Rows on screen keep their places; those that are new come below them in their own order."""
    fresh = update.join(shown.select("id"), "id", "left_anti").withColumn("_part", F.lit(1))
    both = shown.withColumn("_part", F.lit(0)).unionByName(fresh)
    return both.withColumn("position", F.row_number().over(Window.orderBy("_part", "position")).cast("long")).drop("_part")


def hide_read(items: DataFrame, kept: DataFrame) -> DataFrame:
    """Unread items, and those that were unread when the list was asked for."""
    frozen = kept.select("id").withColumn("_kept", F.lit(True))
    return items.join(frozen, "id", "left").where(~F.col("read") | F.col("_kept").isNotNull()).drop("_kept")
