"""Queries over the store's folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from semrank.constants import DAILY_DOLLARS, DOLLARS_PER_TOKEN, FAILING_S, FAILURES_IN_A_ROW, READING_RESERVE
from semrank.operators import store
from semrank.plans.base import query
from semrank.plans.items import TEXT_HASH_SQL, item_text_hash
from semrank.sources.tables import ITEM_SQL, PASSAGE_SQL, items, passages, stamp, table

W = f"WITH {ITEM_SQL}"
TS = "'%Y-%m-%d %H:%M:%S'"


def stored_items(spark, sf):
    """Two thirds of the items as they were, seen a while ago."""
    return items(spark, sf).where("id % 3 <> 0").selectExpr("id", "source_id", "guid", "url", "title", "snippet", "content", "CASE WHEN id % 4 <> 0 THEN published END AS published", "timestamp_ntz'2024-02-02' AS seen")


def fetched_entries(spark, sf):
    """All items as a refresh brings them: some retitled, some with another snippet, some with another guid, some undated."""
    return items(spark, sf).selectExpr(
        "source_id", "CASE WHEN id % 11 = 5 THEN concat('moved-', guid) ELSE guid END AS guid", "url", "CASE WHEN id % 10 = 1 THEN concat(title, ' (updated)') ELSE title END AS title",
        "CASE WHEN id % 10 = 2 THEN concat('! ', snippet) ELSE snippet END AS snippet", "content", "published", "id AS position",
    )


UPSERT_SQL = f"""{W}, o AS (SELECT id, source_id, guid, url, title, snippet, content, CASE WHEN id % 4 <> 0 THEN published END AS published FROM item WHERE id % 3 <> 0
), n AS (SELECT source_id, CASE WHEN id % 11 = 5 THEN 'moved-' || guid ELSE guid END AS guid, url, CASE WHEN id % 10 = 1 THEN title || ' (updated)' ELSE title END AS title,
    CASE WHEN id % 10 = 2 THEN '! ' || snippet ELSE snippet END AS snippet, content, published, id AS position FROM item
), m AS (SELECT n.*, coalesce(g.id, (SELECT min(u.id) FROM o u WHERE u.source_id = n.source_id AND u.url = n.url)) AS id FROM n LEFT JOIN o g ON g.source_id = n.source_id AND g.guid = n.guid
), old AS (SELECT o.id, coalesce(m.title, o.title) AS title, coalesce(o.published, m.published) AS published,
    CASE WHEN m.id IS NOT NULL AND (o.title IS DISTINCT FROM m.title OR o.snippet IS DISTINCT FROM m.snippet OR o.content IS DISTINCT FROM m.content OR o.url IS DISTINCT FROM m.url) THEN 'edited' ELSE 'kept' END AS action
  FROM o LEFT JOIN m ON m.id = o.id
), fresh AS (SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY source_id, position DESC) AS id, title, published, 'new' AS action FROM m WHERE id IS NULL
), done AS (SELECT * FROM old UNION ALL SELECT * FROM fresh)"""


NOW = "timestamp_ntz'2024-02-05'"


def _upserted(spark, sf):
    return store.upsert(stored_items(spark, sf), fetched_entries(spark, sf), F.expr(NOW))


def shown(items):
    return items.select("id", "title", stamp("published"), stamp("seen"))


@query("upsert_changes", f"{UPSERT_SQL} SELECT id, action FROM done WHERE action <> 'kept'")
def upsert_changes(spark, sf):
    return _upserted(spark, sf).where("action <> 'kept'").select("id", "action")


@query("upsert_result", f"{UPSERT_SQL} SELECT id, title, strftime(published, {TS}) AS published, '2024-02-05 00:00:00' AS seen FROM done")
def upsert_result(spark, sf):
    return shown(_upserted(spark, sf))


@query("article_invalidation", f"{W} SELECT id, CASE WHEN id % 6 = 0 THEN 'extract again' WHEN id % 6 = 1 THEN 'retitle' ELSE 'keep' END AS article FROM item WHERE id % 2 = 0 OR id % 6 = 1")
def article_invalidation(spark, sf):
    """What a refresh does to stored articles: other content drops them, another title alone renames their passages."""
    old = items(spark, sf).where("id % 2 = 0 OR id % 6 = 1").select("id", "title", F.sha2("content", 256).alias("hash"), "url")
    new = items(spark, sf).select("id", F.when(F.col("id") % 6 == 1, F.concat("title", F.lit("?"))).otherwise(F.col("title")).alias("title"), F.sha2(F.when(F.col("id") % 6 == 0, F.concat("content", F.lit("."))).otherwise(F.col("content")), 256).alias("hash"), "url")
    both = old.alias("o").join(new.alias("n"), "id")
    again, rename = store.changed("o", "n", ("hash", "url")), store.changed("o", "n", ("title",))
    return both.select("id", F.when(again, "extract again").when(rename, "retitle").otherwise("keep").alias("article"))


@query("retitle_passages", f"WITH {PASSAGE_SQL} SELECT item_id, idx, CASE WHEN item_id % 6 = 1 THEN article || '?' ELSE article END AS article FROM passage")
def retitle_passages(spark, sf):
    nested = passages(spark, sf).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("idx", "text", "article"))).alias("p"))  # an article's passages
    named = nested.withColumn("p", F.when(F.col("item_id") % 6 == 1, F.transform("p", lambda x: x.withField("article", F.concat(x["article"], F.lit("?"))))).otherwise(F.col("p")))
    return named.select("item_id", F.inline("p")).select("item_id", "idx", "article")


@query("read_state_fold", f"""SELECT user_id AS item_id, strftime(max(ts) FILTER (event_type = 'view'), {TS}) AS opened,
  coalesce(arg_max(event_type, (ts, event_id)) FILTER (event_type IN ('view', 'click', 'error')), '') <> 'error' AS read FROM events GROUP BY user_id""")  # fmt: skip
def read_state_fold(spark, sf):
    """Opening reads an item; later marks win."""
    kinds = F.col("event_type").isin("view", "click", "error")
    last = F.max(F.when(kinds, F.struct("ts", "event_id", "event_type")))["event_type"]
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("item_id")).agg(F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("opened"), (F.coalesce(last, F.lit("")) != "error").alias("read")).select("item_id", stamp("opened"), "read")


@query("mark_all_read_changed", f"{W} SELECT id FROM live WHERE NOT read AND source_id IN (0, 3, 5)")
def mark_all_read_changed(spark, sf):
    scope = spark.createDataFrame([(0,), (3,), (5,)], "source_id long")
    gone = items(spark, sf).where("source_id = 3").select("source_id").distinct()
    return items(spark, sf).where("NOT read").join(scope, "source_id", "left_semi").join(gone, "source_id", "left_anti").select("id")


_PINS = "SELECT user_id % 12 AS pin_id, event_type, ts, event_id FROM events WHERE event_type IN ('signup', 'error')"


@query("soft_delete_restore_positions", f"""WITH e AS ({_PINS}), s AS (SELECT pin_id, arg_max(event_type, (ts, event_id)) = 'error' AS removed, min(ts) AS added FROM e GROUP BY pin_id)
  SELECT pin_id, removed, CASE WHEN NOT removed THEN row_number() OVER (PARTITION BY removed ORDER BY added, pin_id) - 1 END AS position FROM s""")  # fmt: skip
def soft_delete_restore_positions(spark, sf):
    """Pins added and removed over time: the last event says whether one is there; positions are dense among these."""
    events = table(spark, sf, "events").where("event_type IN ('signup', 'error')").withColumn("pin_id", F.col("user_id") % 12)
    state = events.groupBy("pin_id").agg((F.max(F.struct("ts", "event_id", "event_type"))["event_type"] == "error").alias("removed"), F.min("ts").alias("added"))
    placed = store.renumbered(state, ["removed"], ["added", "pin_id"])
    return placed.select("pin_id", "removed", F.when(~F.col("removed"), F.col("position")).alias("position"))


@query("move_position", """WITH s AS (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS source_id FROM documents), p AS (SELECT source_id, row_number() OVER (ORDER BY source_id) - 1 AS position FROM s),
  t AS (SELECT least(max(position), max(position) FILTER (source_id = 2) + 3) AS goal FROM p)
  SELECT source_id, row_number() OVER (ORDER BY CASE WHEN source_id = 2 THEN goal + 0.5 ELSE position END) - 1 AS position FROM p, t""")  # fmt: skip
def move_position(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("CAST(substr(source, 4) AS BIGINT) AS source_id").distinct()
    return store.moved(store.renumbered(rows, [F.lit(0)], ["source_id"]), "source_id", 2, 3)


_SEEN = "CASE WHEN id % 3 = 0 THEN TIMESTAMP '2024-01-20' WHEN source_id = 7 THEN TIMESTAMP '2023-01-01' ELSE TIMESTAMP '2024-02-01' END"


@query("purge_old", f"""{W}, i AS (SELECT id, source_id, sort_date, {_SEEN} AS seen FROM item), m AS (SELECT source_id, max(seen) AS read_at FROM i GROUP BY source_id)
  SELECT id FROM i JOIN m USING (source_id) WHERE sort_date < TIMESTAMP '2024-01-20' AND epoch(read_at) - epoch(seen) > 86400""")  # fmt: skip
def purge_old(spark, sf):
    seen = "CASE WHEN id % 3 = 0 THEN timestamp_ntz'2024-01-20' WHEN source_id = 7 THEN timestamp_ntz'2023-01-01' ELSE timestamp_ntz'2024-02-01' END AS seen"
    rows = items(spark, sf).selectExpr("id", "source_id", "sort_date", seen).withColumn("seen", F.col("seen").cast("timestamp"))
    return store.purgeable(rows, F.expr("timestamp_ntz'2024-01-20'")).select("id")


@query("purge_removed_judgments", f"""{W}, h AS (SELECT source_id, {TEXT_HASH_SQL} AS text_hash FROM item)
  SELECT DISTINCT text_hash FROM h WHERE source_id = 3 AND text_hash NOT IN (SELECT text_hash FROM h WHERE source_id <> 3)""")  # fmt: skip
def purge_removed_judgments(spark, sf):
    hashed = items(spark, sf).select("source_id", item_text_hash().alias("text_hash"))
    judged = hashed.select("text_hash").distinct()
    return store.orphaned(judged, hashed, spark.createDataFrame([(3,)], "source_id long"))


_HEALTH = "SELECT user_id AS source_id, ts, event_type = 'purchase' AS ok FROM events WHERE event_type IN ('error', 'purchase')"
HEALTH_SQL = f"""WITH e AS ({_HEALTH}), l AS (SELECT source_id, max(ts) FILTER (ok) AS ok_at FROM e GROUP BY source_id),
  h AS (SELECT source_id, min(ts) FILTER (NOT ok AND (ok_at IS NULL OR ts > ok_at)) AS failing_since, max(ok_at) AS ok_at FROM e JOIN l USING (source_id) GROUP BY source_id)"""


def _health(spark, sf):
    return store.health(table(spark, sf, "events").where("event_type IN ('error', 'purchase')").selectExpr("user_id AS source_id", "ts", "event_type = 'purchase' AS ok"))


@query("fetch_health", f"{HEALTH_SQL} SELECT source_id, strftime(failing_since, {TS}) AS failing_since, strftime(ok_at, {TS}) AS ok_at FROM h")
def fetch_health(spark, sf):
    return _health(spark, sf).select("source_id", stamp("failing_since"), stamp("ok_at"))


@query("failing_over_24h", f"{HEALTH_SQL} SELECT source_id FROM h WHERE floor(epoch(failing_since)) < (SELECT floor(epoch(max(ts))) FROM e) - 86400")
def failing_over_24h(spark, sf):
    now = table(spark, sf, "events").where("event_type IN ('error', 'purchase')").agg(F.unix_timestamp(F.max("ts").cast("timestamp")).alias("now"))
    rows = _health(spark, sf).join(F.broadcast(now))  # now: one row
    return rows.where(F.unix_timestamp(F.col("failing_since").cast("timestamp")) < F.col("now") - FAILING_S).select("source_id")


@query("daily_spend", f"SELECT strftime(ts, '%Y-%m-%d') AS day, sum(floor(value)::BIGINT)::BIGINT AS tokens, round(sum(floor(value)::BIGINT) * {DOLLARS_PER_TOKEN!r}, 9) AS dollars FROM events GROUP BY day")
def daily_spend(spark, sf):
    by_day = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum(F.floor("value")).cast("long").alias("tokens"))
    return by_day.withColumn("dollars", F.round(F.col("tokens") * DOLLARS_PER_TOKEN, 9))


BUDGET_SQL = f"""WITH r AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, ts, floor(value)::BIGINT * 1000 AS tokens FROM events),
  s AS (SELECT event_id, day, coalesce(sum(tokens) OVER (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)"""


@query("budget_cutoff", f"{BUDGET_SQL} SELECT event_id FROM s WHERE before < {round((DAILY_DOLLARS - READING_RESERVE) / DOLLARS_PER_TOKEN)}")
def budget_cutoff(spark, sf):
    """Searches stop at the day's budget less the reserve that reading keeps."""
    requests = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", (F.floor("value") * 1000).cast("long").alias("tokens"))
    return store.within_budget(requests, "day", ["ts", "event_id"], "tokens", round((DAILY_DOLLARS - READING_RESERVE) / DOLLARS_PER_TOKEN)).select("event_id")


@query("failure_streak", f"""WITH e AS (SELECT user_id, event_type IN ('error', 'view', 'click') AS bad, sum(CASE WHEN event_type IN ('error', 'view', 'click') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
  r AS (SELECT user_id, run, count(*) AS n FROM e WHERE bad GROUP BY ALL), m AS (SELECT user_id, max(n) AS n FROM r GROUP BY user_id)
  SELECT u.user_id, coalesce(m.n, 0) AS longest, coalesce(m.n, 0) >= {FAILURES_IN_A_ROW} AS stopped FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN m USING (user_id)""")  # fmt: skip
def failure_streak(spark, sf):
    runs = store.longest_streak(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "view", "click"))
    return runs.withColumn("stopped", F.col("longest") >= FAILURES_IN_A_ROW)


@query("judgment_upsert", "SELECT user_id, event_type, round(arg_max(value, (ts, event_id)), 6) AS p FROM events GROUP BY ALL")
def judgment_upsert(spark, sf):
    """The last answer for each key of a log."""
    return store.latest(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", F.round("value", 6).alias("p"))


@query("meta_fold", "SELECT k, v FROM (SELECT user_id % 40 AS k, arg_max(CASE WHEN event_type = 'error' THEN '' ELSE event_type END, (ts, event_id)) AS v FROM events GROUP BY k) WHERE v <> ''")
def meta_fold(spark, sf):
    """Settings: the last value of a key, errors standing for deletions."""
    last = store.latest(table(spark, sf, "events").withColumn("k", F.col("user_id") % 40), ["k"], ["ts", "event_id"])
    return last.where("event_type <> 'error'").select("k", F.col("event_type").alias("v"))


@query("seed_once", "SELECT n_nationkey::BIGINT AS source_id FROM nation WHERE n_nationkey NOT IN (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) FROM documents)")
def seed_once(spark, sf):
    """Starter sources that aren't there yet."""
    there = items(spark, sf).select("source_id").distinct()
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("source_id")).join(there, "source_id", "left_anti")


@query("cascade_articles", f"WITH {PASSAGE_SQL} SELECT item_id, count(*) AS passages FROM passage WHERE item_id % 9 <> 0 GROUP BY item_id")
def cascade_articles(spark, sf):
    """Articles of the items that are left after a purge."""
    left = items(spark, sf).where("id % 9 <> 0").select(F.col("id").alias("item_id"))
    return passages(spark, sf).join(left, "item_id", "left_semi").groupBy("item_id").agg(F.count("*").alias("passages"))


@query("mark_viewed", "SELECT user_id % 9 AS pin_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS viewed FROM events WHERE event_type = 'view' GROUP BY pin_id")
def mark_viewed(spark, sf):
    return table(spark, sf, "events").where("event_type = 'view'").groupBy((F.col("user_id") % 9).alias("pin_id")).agg(F.max("ts").alias("viewed")).select("pin_id", stamp("viewed"))


@query("article_retry", f"{W} SELECT id FROM item WHERE id % 8 = 0 AND sort_date < TIMESTAMP '2024-02-01' - INTERVAL 1 HOUR")
def article_retry(spark, sf):
    """Articles that weren't available more than an hour ago."""
    state = items(spark, sf).select("id", F.when(F.col("id") % 8 == 0, "unavailable").otherwise("ready").alias("state"), F.col("sort_date").alias("fetched"))
    return state.where("state = 'unavailable' AND fetched < timestamp_ntz'2024-02-01' - INTERVAL '1' HOUR").select("id")
