"""Queries that run a stream to its end and return what it wrote."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semrank.constants import LIST_UNSURE, RANK_STEPS
from semrank.plans import base, rank
from semrank.plans import store as stored
from semrank.plans.base import query
from semrank.sources.scratch import folder, written
from semrank.sources.tables import PASSAGE_SQL, passages
from semrank.streaming import ingest, lists, versions


def _written(spark, stream, mode: str = "append"):
    at = folder(spark, "stream")
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/state").option("path", f"{at}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def _events(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # A stream reads folders: the table's file by its name in its folder.
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("stream_dedupe", "SELECT event_id, user_id, event_type FROM events")
def stream_dedupe(spark, sf):
    """Every event sent twice comes out once."""
    twice = _events(spark, sf).select("event_id", "user_id", "event_type", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("sent"))
    return _written(spark, ingest.deduplicated(twice, "event_id", "ts").select("event_id", "user_id", "event_type"))


@query("daily_tumbling", "SELECT strftime(ts, '%Y-%m-%d') AS day, sum(floor(value)::BIGINT)::BIGINT AS total FROM events GROUP BY day")
def daily_tumbling(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return ingest.daily_totals(events, "ts", F.floor("value")).withColumn("total", F.col("total").cast("long"))


@query("stream_daily_local", """WITH l AS (SELECT ts + INTERVAL 9 HOUR AS ts, value FROM events), m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM l)
  SELECT strftime(ts, '%Y-%m-%d') AS day, sum(floor(value)::BIGINT)::BIGINT AS total FROM l, m GROUP BY day HAVING day::TIMESTAMP + INTERVAL 1 DAY <= any_value(mark)""")  # fmt: skip
def stream_daily_local(spark, sf):
    """Totals of the days of Tokyo that the watermark has passed, as a stream gives them."""
    totals = ingest.daily_totals(_events(spark, sf).select("ts", "value"), "ts", F.floor("value"), zone="Asia/Tokyo")
    return _written(spark, totals.select("day", F.col("total").cast("long").alias("total")))


def _thirds(spark, sf, rows):
    """rows by thirds of the sources, in their order."""
    n = rows.agg(F.max("source_id")).first()[0] + 1
    part = F.least(F.lit(2), F.floor(F.col("source_id") * 3 / n))
    return [rows.where(part == k) for k in range(3)]


def _folded(spark, sf):
    """Fetched entries in three batches, the second of which comes once more, folded into versions of the item table: the folder
    and the number of the last version.
    """
    at = folder(spark, "versions")
    items, entries = stored.stored_items(spark, sf), stored.fetched_entries(spark, sf)
    versions.create(items, f"{at}/items")
    one, two, three = _thirds(spark, sf, entries)
    ingest.fed(spark, [one, two, two, three], f"{at}/entries", lambda s: versions.upserted(s, f"{at}/items", f"{at}/state", F.expr(stored.NOW), items.schema))
    return f"{at}/items", 4, items.schema


@query("stream_upsert", base.ORACLES["upsert_result"])
def stream_upsert(spark, sf):
    root, n, schema = _folded(spark, sf)
    versions.drop_old(spark, root, n)
    return stored.shown(versions.read(spark, root, n, schema))


@query("stream_versions", f"""{stored.UPSERT_SQL}, src AS (SELECT DISTINCT source_id FROM n), t AS (SELECT source_id, least(2, source_id * 3 // (SELECT max(source_id) + 1 FROM src)) AS part, source_id % {versions.BUCKETS} AS bucket FROM src

), v AS (SELECT version, unnest(parts) AS part, unnest(ats) AS ver FROM (VALUES (1, [0], [1]), (2, [0, 1], [1, 2]), (3, [0, 1], [1, 3]), (4, [0, 1, 2], [1, 3, 4])) x(version, parts, ats)
), made AS (SELECT version, bucket, max(ver) AS made FROM v JOIN t USING (part) GROUP BY ALL
), was AS (SELECT source_id % {versions.BUCKETS} AS bucket, count(*) AS n FROM o GROUP BY bucket
), more AS (SELECT version, bucket, count(*) AS n FROM v JOIN t USING (part) JOIN m USING (source_id) WHERE m.id IS NULL GROUP BY ALL
), every AS (SELECT version, bucket FROM (VALUES (1), (2), (3), (4)) x(version), (SELECT DISTINCT bucket FROM t UNION SELECT bucket FROM was))
  SELECT version, bucket::BIGINT AS bucket, coalesce(made, 0)::BIGINT AS made, coalesce(was.n, 0) + coalesce(more.n, 0) AS "rows" FROM every LEFT JOIN made USING (version, bucket) LEFT JOIN was USING (bucket) LEFT JOIN more USING (version, bucket) WHERE coalesce(was.n, 0) + coalesce(more.n, 0) > 0""")  # fmt: skip
def stream_versions(spark, sf):
    """Manifests of the versions: a batch rewrites the buckets of its own sources and no others."""
    root, n, _ = _folded(spark, sf)
    each = [versions.manifest(spark, root, k).withColumn("version", F.lit(k)) for k in range(1, n + 1)]
    return reduce(DataFrame.unionByName, each).select("version", F.col("bucket").cast("long").alias("bucket"), F.col("made").cast("long").alias("made"), "rows")


@query("stream_saturation", f"""WITH {PASSAGE_SQL}, j AS (SELECT item_id, length(text) > 60 AS found, CASE WHEN length(text) > 60 THEN idx % 2 ELSE 1 + idx % 2 END AS batch FROM passage),
  c AS (SELECT item_id, b AS batch, count(*) AS checked, count(*) FILTER (found) AS found FROM j, (VALUES (0), (1), (2)) v(b) WHERE batch <= b GROUP BY ALL),
  s AS (SELECT item_id, max(checked) AS checked, max(found) AS found, bool_or(checked >= 8 AND found > 0.35::DOUBLE * checked) AS saturated FROM c GROUP BY item_id)
  SELECT item_id, checked, found, saturated, saturated AND NOT (found > 0.35::DOUBLE * checked) AS held FROM s""")  # fmt: skip
def stream_saturation(spark, sf):
    """Saturation of articles whose judged passages come in three batches, the finds early: once saturated, an article stays so
    (held: where its share has fallen again).
    """
    at = folder(spark, "judged")
    found = F.length("text") > 60
    judged = written(passages(spark, sf).select("item_id", found.alias("found"), F.when(found, F.col("idx") % 2).otherwise(1 + F.col("idx") % 2).alias("batch")), "judged")

    def start(rows):
        fold = lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")
        return ingest.sticky_saturation(rows, 0.35, 8).writeStream.foreachBatch(fold).outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()

    ingest.fed(spark, [judged.where(F.col("batch") == k).select("item_id", "found") for k in range(3)], f"{at}/in", start)
    rows = spark.read.parquet(f"{at}/out").groupBy("item_id").agg(F.max_by(F.struct("checked", "found", "saturated"), "batch").alias("s")).select("item_id", "s.*")
    return rows.withColumn("held", F.col("saturated") & ~(F.col("found") > 0.35 * F.col("checked")))


_LISTED = f"""{rank.BASE}, l AS (SELECT pin_id AS run, id, id % 3 AS batch, row_number() OVER (PARTITION BY pin_id ORDER BY round(shown * {RANK_STEPS}) DESC, sort_date DESC, id DESC) AS o FROM banded WHERE shown >= {LIST_UNSURE!r}
), n AS (SELECT run, count(*) FILTER (batch = 0) AS n0, count(*) FILTER (batch <= 1) AS n1 FROM l GROUP BY run
), p AS (SELECT run, CASE WHEN n0 >= 8 THEN 0 WHEN n1 >= 1 THEN 1 ELSE 2 END AS paint FROM n
), e AS (SELECT l.*, paint, (SELECT max(x.o) FROM l x WHERE x.run = l.run AND x.batch < l.batch) AS low FROM l JOIN p USING (run)
), s AS (SELECT *, greatest(batch, paint) AS came FROM e WHERE batch <= paint OR o > low
), c AS (SELECT run, came AS batch, CASE WHEN came = paint THEN 'paint' ELSE 'append' END AS change, id, row_number() OVER (PARTITION BY run ORDER BY came, o) AS place, true AS inserted FROM s
  UNION ALL SELECT l.run, 3, 'merge', l.id, l.o, s.id IS NULL FROM l LEFT JOIN s ON s.run = l.run AND s.id = l.id)"""


@query("stream_list", f"{_LISTED} SELECT run, batch::BIGINT AS batch, change, id, place, inserted FROM c")
def stream_list(spark, sf):
    """Each sentence's list while its answers come in three batches and a fourth settles it: every change of what is shown."""
    at = folder(spark, "lists")
    rows = rank.listable(spark, sf)
    answers = written(rows.select(F.col("pin_id").alias("run"), (F.col("id") % 3).cast("int").alias("batch"), F.lit("answer").alias("event"), "id", F.round(F.col("shown") * RANK_STEPS).cast("long").alias("steps"), F.unix_timestamp("sort_date").alias("date")), "answers")
    mark = lambda batch, event: answers.select("run").distinct().select("run", F.lit(batch).alias("batch"), F.lit(event).alias("event"), *[F.lit(None).cast("long").alias(c) for c in ("id", "steps", "date")])
    one, two, three = (answers.where(F.col("batch") == k) for k in range(3))
    before = {k: spark.conf.get(k, None) for k in lists.STATE_STORE}
    for k, v in lists.STATE_STORE.items():
        spark.conf.set(k, v)

    def start(rows):
        return lists.growing_lists(rows).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(once=True).start()

    try:
        ingest.fed(spark, [one.unionByName(mark(0, "begin")), two, three, mark(3, "settled")], f"{at}/in", start)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    return spark.read.schema(lists.CHANGES).parquet(f"{at}/out").withColumn("batch", F.col("batch").cast("long"))
