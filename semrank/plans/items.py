"""Queries over items and sources: lists, lookups, counts, identities."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from semrank.operators import rank, store
from semrank.plans.base import query
from semrank.sources.tables import ITEM_SQL, PASSAGE_SQL, items, live_items, passages, sentence_sql, sentences, sources, stamp, table

W = f"WITH {ITEM_SQL}"


def newest_first():
    return F.col("sort_date").desc(), F.col("id").desc()


def newest(df, limit: int, offset: int = 0):
    """The newest items, content left out; negative numbers count as 0."""
    return df.select("id", "source_id", "title", "sort_date", "read").orderBy(*newest_first()).offset(max(0, offset)).limit(max(0, limit)).select("id", "source_id", "title", stamp("sort_date"))


def _newest_sql(where: str, limit: int, offset: int = 0) -> str:
    return f"{W} SELECT id, source_id, title, strftime(sort_date, '%Y-%m-%d %H:%M:%S') AS sort_date FROM live WHERE {where} ORDER BY live.sort_date DESC, id DESC LIMIT {limit} OFFSET {offset}"


@query("newest_topk", _newest_sql("true", 300))
def newest_topk(spark, sf):
    return newest(live_items(spark, sf), 300)


@query("newest_topk_offset", _newest_sql("true", 50, 100))
def newest_topk_offset(spark, sf):
    return newest(live_items(spark, sf), 50, 100)


@query("newest_scope", _newest_sql("source_id = 5", 50))
def newest_scope(spark, sf):
    return newest(live_items(spark, sf).where("source_id = 5"), 50)


@query("newest_unread", _newest_sql("NOT read", 100))
def newest_unread(spark, sf):
    return newest(live_items(spark, sf).where("NOT read"), 100)


@query("item_by_id", f"{W} SELECT id, guid, title, length(content) AS n_chars FROM item WHERE id = 17")
def item_by_id(spark, sf):
    return items(spark, sf).where("id = 17").select("id", "guid", "title", F.length("content").cast("long").alias("n_chars"))


@query("items_by_ids", f"{W} SELECT id, title FROM live WHERE id IN (SELECT unnest(from_json('[3,5,8,40,999999,12]', '[\"BIGINT\"]')))")
def items_by_ids(spark, sf):
    ids = spark.range(1).select(F.explode(F.from_json(F.lit("[3,5,8,40,999999,12]"), "array<long>")).alias("id"))
    return live_items(spark, sf).join(ids, "id", "left_semi").select("id", "title")


@query("keyed_lookups", f"{W} SELECT source_id, title, removed, kind FROM source WHERE source_id IN (2, 3)")
def keyed_lookups(spark, sf):
    return sources(spark, sf).where(F.col("source_id").isin(2, 3))


@query("item_counts", f"{W} SELECT 'all' AS scope, count(*) AS n FROM live UNION ALL SELECT 'source 5', count(*) FROM live WHERE source_id = 5 UNION ALL SELECT 'unread', count(*) FROM live WHERE NOT read")
def item_counts(spark, sf):
    one = live_items(spark, sf).agg(F.count("*").alias("all"), F.count_if(F.col("source_id") == 5).alias("source 5"), F.count_if(~F.col("read")).alias("unread"))
    return one.unpivot([], ["all", "source 5", "unread"], "scope", "n")


@query("unread_counts_rollup", f"{W} SELECT source_id, count(*) AS unread FROM live WHERE NOT read GROUP BY ROLLUP (source_id)")
def unread_counts_rollup(spark, sf):
    return live_items(spark, sf).where("NOT read").rollup("source_id").agg(F.count("*").alias("unread"))


@query("max_seen_by_source", f"{W} SELECT source_id, strftime(max(coalesce(published, fetched)), '%Y-%m-%d %H:%M:%S') AS seen FROM item GROUP BY source_id")
def max_seen_by_source(spark, sf):
    return items(spark, sf).groupBy("source_id").agg(F.max("sort_date").alias("seen")).select("source_id", stamp("seen"))


@query("source_lookup", f"{W} SELECT id, coalesce(s.title, '') AS source_title, coalesce(s.kind, 'feed') AS kind FROM item LEFT JOIN source s ON s.source_id = item.source_id AND NOT s.removed")
def source_lookup(spark, sf):
    known = sources(spark, sf).where("NOT removed").select("source_id", F.col("title").alias("source_title"), "kind")
    return items(spark, sf).select("id", "source_id").join(known, "source_id", "left").select("id", F.coalesce("source_title", F.lit("")).alias("source_title"), F.coalesce("kind", F.lit("feed")).alias("kind"))


def item_text_hash(repo="repo_name", title="title", snippet="snippet"):
    """sha256 of the judged text as JSON with its fields in order; releases carry their repository's name."""
    named = F.concat_ws(" ", repo, F.coalesce(title, F.lit("")))
    return F.sha2(F.to_json(F.struct(F.coalesce(snippet, F.lit("")).alias("snippet"), named.alias("title"))), 256)


TEXT_HASH_SQL = "sha256(json_object('snippet', snippet, 'title', concat_ws(' ', repo_name, title))::VARCHAR)"


@query("text_hash_items", f"{W} SELECT id, {TEXT_HASH_SQL} AS text_hash FROM item")
def text_hash_items(spark, sf):
    return items(spark, sf).select("id", item_text_hash().alias("text_hash"))


@query("identity_chain", f"""{W} SELECT id, CASE WHEN id % 3 = 0 THEN guid WHEN id % 3 = 1 THEN url
  ELSE 'sha256:' || sha256(title || chr(10) || coalesce(CAST(epoch(published)::BIGINT AS VARCHAR), '')) END AS identity FROM item""")  # fmt: skip
def identity_chain(spark, sf):
    """A feed's own identifier, else the link, else a hash of title and date."""
    seen = items(spark, sf).select("id", F.when(F.col("id") % 3 == 0, F.col("guid")).alias("guid"), F.when(F.col("id") % 3 == 1, F.col("url")).otherwise("").alias("url"), "title", "published")
    seconds = F.coalesce(F.unix_timestamp(F.col("published").cast("timestamp")).cast("string"), F.lit(""))
    hashed = F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\n", "title", seconds), 256))
    return seen.select("id", F.coalesce(F.nullif("guid", F.lit("")), F.nullif("url", F.lit("")), hashed).alias("identity"))


_FEED = "SELECT doc_id AS position, source, doc_id % 97 AS identity, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 61 END AS link FROM documents"


@query("dedupe_feed_order", f"""WITH f AS ({_FEED}), a AS (SELECT *, row_number() OVER (PARTITION BY source, identity ORDER BY position) AS n FROM f),
  b AS (SELECT *, row_number() OVER (PARTITION BY source, link ORDER BY position) AS m FROM a WHERE n = 1)
  SELECT position, source, identity, link FROM b WHERE m = 1 OR link IS NULL""")  # fmt: skip
def dedupe_feed_order(spark, sf):
    feed = table(spark, sf, "documents").selectExpr("doc_id AS position", "source", "doc_id % 97 AS identity", "CASE WHEN doc_id % 7 <> 0 THEN doc_id % 61 END AS link")
    return store.first_of_feed(feed, "source", "position", "identity", "link")


@query("new_since_viewed", f"{W} SELECT source_id, count(*) AS n FROM live WHERE sort_date > CASE WHEN source_id % 2 = 0 THEN TIMESTAMP '2024-01-15' ELSE TIMESTAMP '0001-01-01' END GROUP BY source_id")
def new_since_viewed(spark, sf):
    viewed = F.when(F.col("source_id") % 2 == 0, F.expr("timestamp_ntz'2024-01-15'"))
    return live_items(spark, sf).where(F.col("sort_date") > F.coalesce(viewed, F.expr("timestamp_ntz'0001-01-01'"))).groupBy("source_id").agg(F.count("*").alias("n"))


@query("any_unread", f"{W} SELECT EXISTS (SELECT 1 FROM live WHERE NOT read) AS some")
def any_unread(spark, sf):
    return live_items(spark, sf).where("NOT read").select(F.lit(True).alias("some")).limit(1).agg(F.coalesce(F.bool_or("some"), F.lit(False)).alias("some"))


@query("filtered_list", f"{W} SELECT id FROM live WHERE source_id IN (1, 2, 5) AND NOT read AND sort_date >= TIMESTAMP '2024-01-03' AND sort_date < TIMESTAMP '2024-02-01' AND contains(lower(title), 'e') AND contains(lower(title), 'n')")
def filtered_list(spark, sf):
    """Any conjunction of conditions."""
    wanted = {"source_id": (1, 2, 5), "read": False, "since": datetime.datetime(2024, 1, 3), "until": datetime.datetime(2024, 2, 1), "words": "E n"}
    return rank.matching(live_items(spark, sf), **wanted).select("id")


@query("keyed_lookups", f"""{W}, {PASSAGE_SQL}, {sentence_sql()} SELECT 'source' AS what, count(*) AS n, max(title) AS one FROM source WHERE source_id = 5 UNION ALL SELECT 'pin', count(*), max(sentence) FROM pin WHERE pin_id = 2
  UNION ALL SELECT 'article', count(*), max(text) FROM passage WHERE item_id = 7 UNION ALL SELECT 'spend', count(*), sum(floor(value)::BIGINT)::BIGINT::VARCHAR FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-05'""")  # fmt: skip
def keyed_lookups(spark, sf):
    """One source, pin, article and day of spend by key."""
    said = lambda df, what, one: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"), one.alias("one"))
    out = said(sources(spark, sf).where("source_id = 5"), "source", F.max("title"))
    out = out.unionByName(said(sentences(spark).where("pin_id = 2"), "pin", F.max("sentence"))).unionByName(said(passages(spark, sf).where("item_id = 7"), "article", F.max("text")))
    day = table(spark, sf, "events").where("ts >= timestamp_ntz'2024-01-05' AND ts < timestamp_ntz'2024-01-06'")
    return out.unionByName(said(day, "spend", F.sum(F.floor("value").cast("long")).cast("string")))
