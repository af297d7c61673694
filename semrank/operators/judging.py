"""Answers of a judge over rows: the wire's JSON, partial answers, how a pass ended, prejudging, pins over changed items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semrank.constants import FAILURES_IN_A_ROW, JUDGEABLE, PREJUDGED_ITEMS, PREJUDGED_PASSAGES
from semrank.operators import rank
from semrank.operators.ranks import numbered
from semrank.sources.scratch import written


def request_body(model: str, state: Column, frames: Column) -> Column:
    """JSON of one request: the state, and a question q0, q1, ... for each frame."""
    questions = F.map_from_entries(F.transform(frames, lambda f, i: F.struct(F.concat(F.lit("q"), i.cast("string")), F.struct(F.lit("noul").alias("type"), f.alias("instructions")))))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.struct(state.alias("text")).alias("state"), questions.alias("questions")))


def answer(body: Column, position: int) -> Column:
    """The probability that a response holds for a question: a JSON number from 0 to 1, never a string or a boolean; else null."""
    parsed, at = F.try_parse_json(body), f"$.answers.q{position}"
    kind = F.schema_of_variant(F.try_variant_get(parsed, f"{at}.noul", "variant"))
    p = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(parsed, f"{at}.noul", "double"))
    return F.when((F.try_variant_get(parsed, f"{at}.type", "string") == "noul") & p.between(0.0, 1.0), p)


def answers(responses: DataFrame, frames: int) -> DataFrame:
    """responses (id, body): id, frame, p, failed. A missing or invalid answer leaves its frame unchecked; a response without any
    usable one, or without a model and a whole number of tokens, has failed.
    """
    parsed = F.try_parse_json(F.col("body"))
    tokens = F.try_variant_get(parsed, "$.usage.input_tokens", "double")
    whole = (F.coalesce(F.try_variant_get(parsed, "$.model", "string"), F.lit("")) != "") & (tokens >= 0) & (tokens == F.floor(tokens))
    each = F.array(*[F.when(F.coalesce(whole, F.lit(False)), answer(F.col("body"), k)) for k in range(frames)])
    rows = responses.select("id", each.alias("ps")).withColumn("failed", F.forall("ps", lambda p: p.isNull()))
    return rows.select("id", "failed", F.posexplode("ps").alias("frame", "p"))


def refused(batch: DataFrame) -> DataFrame:
    """Of judgments (batch_id, p), all rows of the batches without a bad probability: one bad row refuses its whole batch."""
    bad = batch.groupBy("batch_id").agg(F.max(~F.coalesce(~F.isnan("p") & F.col("p").between(0.0, 1.0), F.lit(False))).alias("bad"))
    return batch.join(bad.where("NOT bad").select("batch_id"), "batch_id", "left_semi")


#: How a request that wasn't answered ends its pass.
ENDINGS = {"missing": "missingKey", "unauthorized": "keyRejected", "budget": "dailyLimit", "cancel": "cancelled"}


def outcomes(requests: DataFrame) -> DataFrame:
    """requests (pass_id, position, status: answered, unreachable, refused or a key of ENDINGS): pass_id, outcome, requests used.
    The first request that ends a pass decides; so does the tenth failure in a row: offline if all ten were unreachable.
    """
    order = Window.partitionBy("pass_id").orderBy("position")
    fails = F.col("status").isin("unreachable", "refused")
    ending = F.coalesce(*[F.when(F.col("status") == k, v) for k, v in ENDINGS.items()])
    last = order.rowsBetween(1 - FAILURES_IN_A_ROW, 0)
    streak = (F.sum(F.when(fails, 1).otherwise(0)).over(last) == FAILURES_IN_A_ROW)
    alone = F.sum(F.when(F.col("status") == "unreachable", 1).otherwise(0)).over(last) == FAILURES_IN_A_ROW
    ended = requests.withColumn("ends", F.coalesce(ending, F.when(streak, F.when(alone, "offline").otherwise("stopped"))))
    ends = F.when(F.col("ends").isNotNull(), F.struct("position", "ends"))
    out = ended.groupBy("pass_id").agg(F.min(ends).alias("e"), F.max("position").alias("last"))
    return out.select("pass_id", F.coalesce("e.ends", F.lit("completed")).alias("outcome"), F.coalesce("e.position", "last").alias("used"))


#: A judge: requests (text_hash, position, state, frames: array of text) to (text_hash, position, status, ps: array of answers by
#: frame, null where there is none). It may call a service in mapInPandas, or be an expression of Columns.
Judge = Callable[[DataFrame], DataFrame]
CACHE = "text_hash string, frame_hash string, model string, p double"


def cache(spark: SparkSession, root: str) -> DataFrame:
    """Judgments under root, one of each text, frame and model."""
    return spark.read.schema(CACHE).parquet(root).dropDuplicates(["text_hash", "frame_hash", "model"])


def judge_pass(pairs: DataFrame, root: str, judge: Judge, model: str, wave: int = 256) -> str:
    """Asks the judge for what pairs (text_hash, state, position, frame_hash, frame) miss in the judgments under root, and returns how
    the pass ended.

    One request per text, with only the frames that miss an answer, in the order of position, in waves. The answers of a wave are
    exploded back to rows and committed before the next wave is asked, so what was answered is never asked again, by this pass or by
    one after a failure; frames without a usable answer stay missing. The pass ends early as outcomes() says.
    """
    spark = pairs.sparkSession
    missing = rank.missing(pairs, cache(spark, root), model)
    asked = missing.groupBy("text_hash").agg(F.min("position").alias("first"), F.min_by("state", "position").alias("state"), F.array_sort(F.collect_set(F.struct("frame_hash", "frame"))).alias("f"))  # at most PINS frames
    asked = written(numbered(written(asked, "asked"), ["first", "text_hash"], name="place"), "requests")
    n, seen, ended = asked.count(), None, "completed"
    for at in range(0, n, wave):
        now = asked.where(F.col("place").between(at, at + wave - 1))
        replies = judge(now.select("text_hash", F.col("place").alias("position"), "state", F.col("f.frame").alias("frames")))
        replies = written(replies.select("text_hash", "position", "status", "ps"), "replies")
        each = replies.where("status = 'answered'").join(now.select("text_hash", F.col("f.frame_hash").alias("hashes")), "text_hash")
        rows = each.select("text_hash", F.explode(F.arrays_zip("hashes", "ps")).alias("x")).select("text_hash", F.col("x.hashes").alias("frame_hash"), F.lit(model).alias("model"), F.col("x.ps").cast("double").alias("p"))
        rows.where(F.col("p").between(0.0, 1.0) & ~F.isnan("p")).write.mode("append").parquet(root)
        # A response without any usable answer has failed; the last ones of the waves before count in a row.
        status = F.when((F.col("status") == "answered") & ~F.exists("ps", lambda p: F.coalesce(p.between(0.0, 1.0), F.lit(False))), "refused").otherwise(F.col("status"))
        told = replies.select(F.lit(0).alias("pass_id"), "position", status.alias("status"))
        told = told if seen is None else seen.unionByName(told)
        ended = outcomes(told).first()["outcome"]
        if ended != "completed":
            break
        seen = spark.createDataFrame(told.orderBy(F.desc("position")).limit(FAILURES_IN_A_ROW - 1).collect(), told.schema)
    return ended


def prejudged(found: DataFrame, passages: DataFrame) -> DataFrame:
    """The first judgeable passages (item_id, idx) of the first found items of a list (id, position)."""
    first = found.where(F.col("position") <= PREJUDGED_ITEMS).select(F.col("id").alias("item_id"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("idx"))
    rows = passages.where(F.col("kind").isin(*JUDGEABLE)).join(F.broadcast(first), "item_id")  # at most PREJUDGED_ITEMS rows
    return rows.withColumn("place", place).where(F.col("place") <= PREJUDGED_PASSAGES).drop("place")


def pin_pass(changed: DataFrame, sentences: DataFrame, judgments: DataFrame, model: str) -> DataFrame:
    """One request per changed text with the frames of all pins that it has no answer for."""
    return rank.requests(rank.missing(rank.pairs(changed, sentences), judgments, model))


def matched_by_title(articles: DataFrame, rows: DataFrame) -> DataFrame:
    """articles (item_id, found) with whether the row was found though its article holds nothing. rows: banded list rows."""
    hit = rows.where("band = 2").select(F.col("id").alias("item_id")).distinct().withColumn("_hit", F.lit(True))
    return articles.join(hit, "item_id", "left").select("item_id", (F.col("_hit").isNotNull() & (F.col("found") == 0)).alias("by_title"))


def stem_terms(text: Column) -> Column:
    """Distinct words of two characters or more, without common ones, and without the s of a plural."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 1) & ~w.isin(*IGNORED))
    return F.array_distinct(F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.left(w, F.length(w) - 1)).otherwise(w)))


# Words that say nothing.
IGNORED = (
    "a", "an", "the", "of", "on", "in", "for", "to", "and", "or", "about", "with", "is", "are", "my", "your", "that", "this",
    "things", "stuff", "how", "what", "can", "i", "sur", "la", "le", "les", "et", "de", "des", "du", "un", "une", "trucs",
)


def stem_judge(text: Column, sentence: Column, jitter: Column) -> Column:
    """p by the share of the sentence's stems that the text has, equal or one the start of the other; jitter: 0 to 1."""
    wanted, present = stem_terms(sentence), stem_terms(text)
    like = lambda a, b: (a == b) | ((F.length(a) > 4) & (F.length(b) > 4) & (a.startswith(b) | b.startswith(a)))
    share = F.size(F.filter(wanted, lambda w: F.exists(present, lambda x: like(x, w)))) / F.nullif(F.size(wanted), F.lit(0))
    scored = F.least(0.05 + 0.9 * F.pow(share, F.lit(1.6)) + (jitter - 0.5) * 0.06, F.lit(0.98))
    return F.when(share.isNull(), 0.02 + jitter * 0.1).when(share > 0, scored).otherwise(0.02 + jitter * 0.12)
