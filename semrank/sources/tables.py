"""The model's tables over the driver's Parquet files.

Items come from documents, sources from their source column, relevance labels from labels, and activity from events. Dates
are TIMESTAMP_NTZ in UTC, as in the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sentences of common words that find something in the documents, and one with an exclusion.
SENTENCES = ("with that from", "une les des", "pour dans avec", "nicht eine sind", "that not with from")
REMOVED_SOURCE = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source_id, guid, url, title, snippet, content, published, fetched, sort_date, read, repo_name."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id",
        "CAST(substr(source, 4) AS BIGINT) AS source_id",
        "concat('doc-', doc_id) AS guid",
        "concat('https://src', substr(source, 4), '.example/', doc_id) AS url",
        "substr(text, 1, 60) AS title",
        "substr(text, 1, 300) AS snippet",
        "text AS content",
        "CASE WHEN doc_id % 20 <> 19 THEN timestamp_ntz'2024-01-01' + make_dt_interval(0, CAST(doc_id % 700 AS INT)) END AS published",
        "timestamp_ntz'2024-02-01' AS fetched",
        "coalesce(CASE WHEN doc_id % 20 <> 19 THEN timestamp_ntz'2024-01-01' + make_dt_interval(0, CAST(doc_id % 700 AS INT)) END, timestamp_ntz'2024-02-01') AS sort_date",
        "doc_id % 5 <> 0 AS read",
        "CASE WHEN source = 'src2' THEN 'mlx' END AS repo_name",
    )


#: The same rows in SQL, as common table expressions for the oracles.
ITEM_SQL = """item AS (
  SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS source_id, 'doc-' || doc_id AS guid, 'https://src' || substr(source, 4) || '.example/' || doc_id AS url,
    substr(text, 1, 60) AS title, substr(text, 1, 300) AS snippet, text AS content,
    CASE WHEN doc_id % 20 <> 19 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 700 AS INT)) END AS published, TIMESTAMP '2024-02-01' AS fetched,
    coalesce(CASE WHEN doc_id % 20 <> 19 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 700 AS INT)) END, TIMESTAMP '2024-02-01') AS sort_date,
    doc_id % 5 <> 0 AS read, CASE WHEN source = 'src2' THEN 'mlx' END AS repo_name
  FROM documents
), source AS (
  SELECT source_id, 'Source ' || source_id AS title, source_id = 3 AS removed, CASE WHEN source_id = 2 THEN 'githubReleases' WHEN source_id = 4 THEN 'youtube' ELSE 'feed' END AS kind
  FROM (SELECT DISTINCT source_id FROM item)
), live AS (SELECT * FROM item WHERE source_id NOT IN (SELECT source_id FROM source WHERE removed))"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, title, removed, kind."""
    return (
        items(spark, sf_dir).select("source_id").distinct()
        .selectExpr("source_id", "concat('Source ', source_id) AS title", f"source_id = {REMOVED_SOURCE} AS removed", "CASE source_id WHEN 2 THEN 'githubReleases' WHEN 4 THEN 'youtube' ELSE 'feed' END AS kind")
    )


def live_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the sources that aren't removed."""
    gone = sources(spark, sf_dir).where("removed").select("source_id")
    return items(spark, sf_dir).join(gone, "source_id", "left_anti")


def sentences(spark: SparkSession, texts=SENTENCES) -> DataFrame:
    """pin_id, sentence: a fixed handful of rows."""
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "pin_id long, sentence string")


def sentence_sql(texts=SENTENCES) -> str:
    return "pin AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{t}')" for i, t in enumerate(texts)) + ") v(pin_id, sentence))"


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, idx, text, article: each non-empty line of a document in order."""
    lines = "filter(transform(split(text, '\\n'), x -> trim(x)), x -> x <> '')"
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS item_id", "substr(text, 1, 60) AS article", f"posexplode({lines}) AS (idx, text)").selectExpr("item_id", "CAST(idx AS BIGINT) AS idx", "text", "article")


PASSAGE_SQL = """passage AS (
  SELECT item_id, generate_subscripts(l, 1)::BIGINT - 1 AS idx, unnest(l) AS text, article
  FROM (SELECT doc_id AS item_id, substr(text, 1, 60) AS article, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
)"""


def stamp(col: str, name: str | None = None):
    """A date as text, equal in every engine."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(name or col)
