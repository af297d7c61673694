"""Queries of the ranked list: search, pins, cache, request order."""

from __future__ import annotations

from pyspark.sql import functions as F

from semrank.constants import LIST_CAP, LIST_UNSURE
from semrank.functions import sentence as S
from semrank.functions.judge import FOUND
from semrank.operators import rank
from semrank.plans.base import query
from semrank.plans.items import TEXT_HASH_SQL, item_text_hash
from semrank.sources.tables import ITEM_SQL, SENTENCES, live_items, sentence_sql, sources

MODEL = "overlap-1"
ASKED = SENTENCES[0]


def _terms(t: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 3)"


def shared_sql(text: str, asked: str) -> str:
    return f"len(list_intersect(list_distinct({_terms(asked)}), list_distinct({_terms(text)})))"


def judge_sql(text: str, asked: str) -> str:
    share = f"{shared_sql(text, asked)} / len(list_distinct({_terms(asked)}))"
    return f"(CASE WHEN {share} >= 0.6 THEN 0.9::DOUBLE WHEN {share} >= 0.3 THEN 0.5::DOUBLE ELSE 0.05::DOUBLE END)"


TEXT = "concat_ws(' ', repo_name, title, snippet)"
FRAME = "'" + S.ITEM_OPENING + ": \"' || sentence || '\". " + S.DATA_RULE + "'"
BASE = f"""WITH {ITEM_SQL}, {sentence_sql()}, near AS (SELECT *, {TEXT_HASH_SQL} AS text_hash FROM live ORDER BY live.sort_date DESC, id DESC LIMIT 300),
  pair AS (SELECT near.*, pin_id, sentence, sha256({FRAME}) AS frame_hash FROM near, pin),
  judged AS (SELECT *, {judge_sql(TEXT, 'sentence')} AS p FROM pair),
  shown AS (SELECT *, CASE WHEN pin_id = 4 THEN least(p, {LIST_CAP!r}::DOUBLE) ELSE p END AS shown FROM judged),
  banded AS (SELECT *, CASE WHEN shown >= 0.6 THEN 2 WHEN shown >= 0.45 THEN 1 ELSE 0 END AS band FROM shown)"""
#: The same over all live items: judging, the cache and requests have no window of their own.
BASE_ALL = BASE.replace(" ORDER BY live.sort_date DESC, id DESC LIMIT 300", "")
VIEWED = "CASE WHEN pin_id % 2 = 0 THEN TIMESTAMP '2024-01-20' ELSE TIMESTAMP '0001-01-01' END"


def _near(spark, sf):
    return rank.window(live_items(spark, sf)).withColumn("text_hash", item_text_hash())


def _pairs(spark, sf, texts=SENTENCES):
    return rank.pairs(_near(spark, sf), rank.framed(spark, texts))


def _all_pairs(spark, sf):
    return rank.pairs(live_items(spark, sf).withColumn("text_hash", item_text_hash()), rank.framed(spark, SENTENCES))


def _banded(spark, sf, texts=SENTENCES):
    return rank.banded(rank.judge(_pairs(spark, sf, texts)))


def listable(spark, sf):
    """Rows of each sentence's list over the newest window: banded, with the probability that is shown."""
    return _banded(spark, sf).where(F.col("shown") >= LIST_UNSURE)


def _cached(spark, sf, pairs=_pairs):
    """Judgments of two thirds of the texts, for the first three sentences, one third by an older model."""
    rows = rank.judge(pairs(spark, sf)).where("id % 3 <> 1 AND pin_id < 3")
    model = F.when(F.col("id") % 3 == 0, MODEL).otherwise("overlap-0")
    return rows.select("text_hash", "frame_hash", model.alias("model"), "p").distinct()


CACHE = f"{BASE}, cache AS (SELECT DISTINCT text_hash, frame_hash, p FROM judged WHERE id % 3 = 0 AND pin_id < 3)"
CACHE_ALL = CACHE.replace(BASE, BASE_ALL)


@query("ranked_search", f"""{BASE} SELECT row_number() OVER (ORDER BY round(shown * 20) DESC, sort_date DESC, id DESC) AS position, id, coalesce(s.title, '') AS source_title, round(shown, 6) AS p, band
  FROM banded LEFT JOIN (SELECT source_id, title FROM source) s USING (source_id) WHERE pin_id = 0 AND shown >= 0.45""")  # fmt: skip
def ranked_search(spark, sf):
    """The flagship: newest window, judged, capped, banded, ordered by rounded probability and date."""
    rows = rank.ranked(_banded(spark, sf, (ASKED,)))
    names = sources(spark, sf).select("source_id", F.col("title").alias("source_title"))
    return rows.join(F.broadcast(names), "source_id", "left").select("position", "id", F.coalesce("source_title", F.lit("")).alias("source_title"), F.round("shown", 6).alias("p"), "band")  # names: a row per feed


@query("judge_overlap", f"{BASE} SELECT id, pin_id, p FROM judged")
def judge_overlap(spark, sf):
    return rank.judge(_pairs(spark, sf)).select("id", "pin_id", "p")


@query("terms_overlap", f"{BASE} SELECT id, pin_id, {shared_sql(TEXT, 'sentence')}::BIGINT AS shared FROM pair")
def terms_overlap(spark, sf):
    return _pairs(spark, sf).select("id", "pin_id", rank.overlap(rank.judged_text(), F.col("sentence")).cast("long").alias("shared"))


@query("sentence_frames", f"WITH {sentence_sql()} SELECT pin_id, {FRAME} AS frame, sha256({FRAME}) AS frame_hash, CASE WHEN pin_id = 4 THEN 'exclusion' END AS unjudgeable FROM pin")
def sentence_frames(spark, sf):
    return rank.framed(spark, SENTENCES).select("pin_id", "frame", "frame_hash", "unjudgeable")


@query("sentence_cap", f"{BASE} SELECT id, shown, band FROM banded WHERE pin_id = 4")
def sentence_cap(spark, sf):
    """No row of a sentence that can't be judged in full is found."""
    return _banded(spark, sf).where("pin_id = 4").select("id", "shown", "band")


@query("missing_pairs", f"{CACHE} SELECT id, pin_id FROM pair ANTI JOIN cache USING (text_hash, frame_hash)")
def missing_pairs(spark, sf):
    return rank.missing(_pairs(spark, sf), _cached(spark, sf), MODEL).select("id", "pin_id")


@query("requests_per_item", f"{CACHE} SELECT text_hash, count(DISTINCT frame_hash) AS frames FROM pair ANTI JOIN cache USING (text_hash, frame_hash) GROUP BY text_hash")
def requests_per_item(spark, sf):
    return rank.requests(rank.missing(_pairs(spark, sf), _cached(spark, sf), MODEL)).select("text_hash", F.size("frames").cast("long").alias("frames"))


@query("cache_join", f"{CACHE} SELECT id, pin_id, cache.p FROM pair LEFT JOIN cache USING (text_hash, frame_hash)")
def cache_join(spark, sf):
    return rank.with_answers(_pairs(spark, sf), _cached(spark, sf), MODEL).select("id", "pin_id", "p")


@query("cache_union_buffer", f"{CACHE}, buffer AS (SELECT text_hash, frame_hash, 0.25::DOUBLE AS p FROM cache WHERE p < 0.1) SELECT text_hash, frame_hash, coalesce(buffer.p, cache.p) AS p FROM cache LEFT JOIN buffer USING (text_hash, frame_hash)")
def cache_union_buffer(spark, sf):
    stored = _cached(spark, sf).where(F.col("model") == MODEL)
    return rank.read_your_writes(stored, stored.where("p < 0.1").withColumn("p", F.lit(0.25))).select("text_hash", "frame_hash", "p")


@query("judge_overlap_all", f"{BASE_ALL} SELECT id, pin_id, p FROM judged")
def judge_overlap_all(spark, sf):
    return rank.judge(_all_pairs(spark, sf)).select("id", "pin_id", "p")


@query("terms_overlap_all", f"{BASE_ALL} SELECT id, pin_id, {shared_sql(TEXT, 'sentence')}::BIGINT AS shared FROM pair")
def terms_overlap_all(spark, sf):
    return _all_pairs(spark, sf).select("id", "pin_id", rank.overlap(rank.judged_text(), F.col("sentence")).cast("long").alias("shared"))


@query("sentence_cap_all", f"{BASE_ALL} SELECT id, shown, band FROM banded WHERE pin_id = 4")
def sentence_cap_all(spark, sf):
    return rank.banded(rank.judge(_all_pairs(spark, sf))).where("pin_id = 4").select("id", "shown", "band")


@query("missing_pairs_all", f"{CACHE_ALL} SELECT id, pin_id FROM pair ANTI JOIN cache USING (text_hash, frame_hash)")
def missing_pairs_all(spark, sf):
    return rank.missing(_all_pairs(spark, sf), _cached(spark, sf, _all_pairs), MODEL).select("id", "pin_id")


@query("requests_per_item_all", f"{CACHE_ALL} SELECT text_hash, count(DISTINCT frame_hash) AS frames FROM pair ANTI JOIN cache USING (text_hash, frame_hash) GROUP BY text_hash")
def requests_per_item_all(spark, sf):
    return rank.requests(rank.missing(_all_pairs(spark, sf), _cached(spark, sf, _all_pairs), MODEL)).select("text_hash", F.size("frames").cast("long").alias("frames"))


@query("cache_join_all", f"{CACHE_ALL} SELECT id, pin_id, cache.p FROM pair LEFT JOIN cache USING (text_hash, frame_hash)")
def cache_join_all(spark, sf):
    return rank.with_answers(_all_pairs(spark, sf), _cached(spark, sf, _all_pairs), MODEL).select("id", "pin_id", "p")


@query("cache_union_buffer_all", f"{CACHE_ALL}, buffer AS (SELECT text_hash, frame_hash, 0.25::DOUBLE AS p FROM cache WHERE p < 0.1) SELECT text_hash, frame_hash, coalesce(buffer.p, cache.p) AS p FROM cache LEFT JOIN buffer USING (text_hash, frame_hash)")
def cache_union_buffer_all(spark, sf):
    stored = _cached(spark, sf, _all_pairs).where(F.col("model") == MODEL)
    return rank.read_your_writes(stored, stored.where("p < 0.1").withColumn("p", F.lit(0.25))).select("text_hash", "frame_hash", "p")


def _lists(spark, sf):
    viewed = F.when(F.col("pin_id") % 2 == 0, F.expr("timestamp_ntz'2024-01-20'"))
    return rank.pin_lists(_banded(spark, sf).withColumn("viewed", viewed))


LISTS = f"{BASE}, lists AS (SELECT pin_id, id, row_number() OVER (PARTITION BY pin_id ORDER BY sort_date DESC, id DESC) AS position, sort_date > {VIEWED} AS fresh FROM banded WHERE band = 2)"


@query("pin_list", f"{LISTS} SELECT * FROM lists")
def pin_list(spark, sf):
    return _lists(spark, sf).select("pin_id", "id", "position", "fresh")


@query("pin_badges", f"{LISTS} SELECT pin_id, count(id) AS fresh FROM pin LEFT JOIN (SELECT * FROM lists WHERE fresh) USING (pin_id) GROUP BY pin_id")
def pin_badges(spark, sf):
    return rank.badges(rank.framed(spark, SENTENCES), _lists(spark, sf))


@query("pin_last_new", f"{LISTS} SELECT pin_id, arg_max(id, position) AS id FROM lists WHERE fresh GROUP BY pin_id")
def pin_last_new(spark, sf):
    return rank.last_new(_lists(spark, sf))


@query("hits_first", f"""{BASE}, h AS (SELECT DISTINCT id FROM banded WHERE band = 2), m AS (SELECT id, sort_date, id IN (SELECT id FROM h) AND sort_date > TIMESTAMP '2024-01-25' AS marked FROM near)
  SELECT id, marked, row_number() OVER (ORDER BY marked DESC, sort_date DESC, id DESC) AS position FROM m""")  # fmt: skip
def hits_first(spark, sf):
    hits = _banded(spark, sf).where(F.col("band") == FOUND)
    return rank.hits_first(_near(spark, sf), hits, F.expr("timestamp_ntz'2024-02-01' - INTERVAL '7' DAY")).select("id", "marked", "position")


ROBIN = """robin AS (SELECT *, row_number() OVER (ORDER BY turn, first) AS position FROM (
  SELECT *, min(place) OVER (PARTITION BY source_id) AS first FROM (
    SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY sort_date DESC, id DESC) AS turn, row_number() OVER (ORDER BY sort_date DESC, id DESC) AS place FROM near)))"""


@query("round_robin", f"{BASE}, {ROBIN} SELECT id, turn, position FROM robin")
def round_robin(spark, sf):
    return rank.round_robin(_near(spark, sf)).select("id", "turn", "position")


@query("likeliest_first", f"{BASE}, {ROBIN}, l AS (SELECT id, position AS turn, {shared_sql(TEXT, repr(ASKED))}::BIGINT AS shared FROM robin) SELECT id, shared, row_number() OVER (ORDER BY shared DESC, turn) AS position FROM l")
def likeliest_first(spark, sf):
    return rank.likeliest_first(rank.round_robin(_near(spark, sf)), F.lit(ASKED)).select("id", "shared", "position")


@query("judge_window", f"WITH {ITEM_SQL} SELECT id FROM live ORDER BY live.sort_date DESC, id DESC LIMIT 1500")
def judge_window(spark, sf):
    return rank.window(live_items(spark, sf), older=1).select("id")


@query("hide_read_kept", f"WITH {ITEM_SQL} SELECT id FROM live WHERE id % 5 = 0 AND id % 10 <> 0 OR id % 10 = 0")
def hide_read_kept(spark, sf):
    """Items unread at request time stay when they are read meanwhile."""
    before = live_items(spark, sf).select("id", "read")
    after = before.withColumn("read", F.col("read") | (F.col("id") % 10 == 0))
    return rank.hide_read(after, before.where("NOT read")).select("id")


_SHOWN = f"{BASE}, r AS (SELECT id, row_number() OVER (ORDER BY round(shown * 20) DESC, sort_date DESC, id DESC) AS position FROM banded WHERE pin_id = 0 AND shown >= 0.45), s AS (SELECT * FROM r WHERE id % 2 = 0), f AS (SELECT * FROM r WHERE id % 2 = 1)"


def _shown(spark, sf):
    return rank.ranked(_banded(spark, sf, (ASKED,))).select("id", "position")


@query("append_below", f"{_SHOWN} SELECT id, row_number() OVER (ORDER BY part, position) AS position FROM (SELECT *, 0 AS part FROM s UNION ALL SELECT *, 1 FROM f)")
def append_below(spark, sf):
    rows = _shown(spark, sf)
    return rank.append_below(rows.where("id % 2 = 0"), rows)


@query("merge_new_rows", f"{_SHOWN} SELECT id, position, id % 2 = 1 AS inserted FROM r")
def merge_new_rows(spark, sf):
    """At the end of a run the list takes its own order; rows that weren't on screen are marked."""
    rows = _shown(spark, sf)
    seen = rows.where("id % 2 = 0").select("id", F.lit(True).alias("seen"))
    return rows.join(seen, "id", "left").select("id", "position", F.col("seen").isNull().alias("inserted"))


@query("pin_list_loaded", f"""{BASE_ALL}, placed AS (SELECT *, dense_rank() OVER (ORDER BY sort_date DESC, id DESC) AS place FROM judged), p2 AS (SELECT * FROM placed WHERE place <= 2000 AND (place <= 300 OR (pin_id < 3 AND text_hash IN (SELECT text_hash FROM judged WHERE id % 3 = 0)))),
  s2 AS (SELECT *, CASE WHEN pin_id = 4 THEN least(p, {LIST_CAP!r}::DOUBLE) ELSE p END AS q FROM p2) SELECT pin_id, id, row_number() OVER (PARTITION BY pin_id ORDER BY sort_date DESC, id DESC) AS position FROM s2 WHERE q >= 0.6""")  # fmt: skip
def pin_list_loaded(spark, sf):
    """Pins list what they found among the loaded items: the window is judged, older rows have their cached answers."""
    rows = rank.loaded(live_items(spark, sf)).withColumn("text_hash", item_text_hash())
    known = _cached(spark, sf, _all_pairs).where(F.col("model") == MODEL).select("text_hash", "frame_hash", F.col("p").alias("known")).dropDuplicates(["text_hash", "frame_hash"])
    rows = rank.judge(rank.pairs(rows, rank.framed(spark, SENTENCES))).join(known, ["text_hash", "frame_hash"], "left")
    listed = rank.pin_lists(rank.banded(rows.withColumn("p", F.when(F.col("judged"), F.col("p")).otherwise(F.col("known")))).withColumn("viewed", F.lit(None).cast("timestamp_ntz")))
    return listed.select("pin_id", "id", "position")
