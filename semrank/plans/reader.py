"""Queries of the reader: passages, sections, saturation, marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from semrank.functions.judge import overlap_judge
from semrank.operators import reader
from semrank.plans.base import query
from semrank.plans.rank import judge_sql
from semrank.sources.tables import PASSAGE_SQL, SENTENCES, passages, table

ASKED = SENTENCES[0]
W = f"""WITH {PASSAGE_SQL}, leveled AS (SELECT *, CASE WHEN length(text) < 20 THEN 1 WHEN length(text) < 40 THEN 2 END AS level FROM passage),
  judged AS (SELECT *, CASE WHEN idx % 7 <> 3 THEN {judge_sql('text', repr(ASKED))} END AS p FROM leveled WHERE level IS NULL),
  counts AS (SELECT item_id, count(*) AS judgeable, count(p) AS checked, count(*) FILTER (p >= 0.75) AS found, count(*) FILTER (p > 0.25 AND p < 0.75) AS unsure FROM judged GROUP BY item_id),
  article AS (SELECT *, checked > 0 AND checked >= least(24, judgeable) AND found > 0.35::DOUBLE * checked AS saturated FROM counts),
  marked AS (SELECT l.item_id, l.idx, CASE WHEN l.level IS NOT NULL THEN 'none' WHEN j.p IS NULL THEN 'unchecked' WHEN coalesce(saturated, false) OR j.p <= 0.25 THEN 'none' WHEN j.p >= 0.75 THEN 'found' ELSE 'unsure' END AS mark
    FROM leveled l LEFT JOIN judged j ON j.item_id = l.item_id AND j.idx = l.idx LEFT JOIN article a ON a.item_id = l.item_id)"""
FOLLOWING = "OVER (PARTITION BY item_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"


def _leveled(spark, sf):
    """Passages; short lines stand for headings."""
    return passages(spark, sf).withColumn("level", F.when(F.length("text") < 20, 1).when(F.length("text") < 40, 2))


def _judged(spark, sf):
    """With p of the asked sentence; one passage in seven is unchecked."""
    p = F.when(F.col("level").isNull() & (F.col("idx") % 7 != 3), overlap_judge(F.col("text"), F.lit(ASKED)))
    return _leveled(spark, sf).withColumn("p", p)


def _articles(spark, sf):
    return reader.saturation(_judged(spark, sf).where("level IS NULL"))


@query("text_hash_passages", f"WITH {PASSAGE_SQL} SELECT item_id, idx, sha256(json_object('article', article, 'passage', text, 'section_heading', '')::VARCHAR) AS text_hash FROM passage")
def text_hash_passages(spark, sf):
    state = F.struct("article", F.col("text").alias("passage"), F.lit("").alias("section_heading"))
    return passages(spark, sf).select("item_id", "idx", F.sha2(F.to_json(state), 256).alias("text_hash"))


@query("plain_text_passages", r"""WITH p AS (SELECT doc_id AS item_id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t\r]*\n'), lambda x: trim(regexp_replace(x, '[\p{Z}\s\x{200B}\x{FEFF}\x{85}]+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents)
  SELECT item_id, generate_subscripts(l, 1)::BIGINT - 1 AS idx, unnest(l) AS text FROM p""")  # fmt: skip
def plain_text_passages(spark, sf):
    return reader.from_plain_text(table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text"), "text")


@query("section_headings", f"{W} SELECT item_id, idx, coalesce(last_value(CASE WHEN level IS NOT NULL THEN text END IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS section FROM leveled")
def section_headings(spark, sf):
    return reader.sections(_leveled(spark, sf)).select("item_id", "idx", "section")


@query("empty_sections", f"""{W}, n AS (SELECT item_id, idx, level, min(idx) FILTER (level IS NULL) {FOLLOWING} AS body, min(idx) FILTER (level <= 1) {FOLLOWING} AS one, min(idx) FILTER (level <= 2) {FOLLOWING} AS two FROM leveled)
  SELECT item_id, idx FROM n WHERE level IS NULL OR body IS NOT NULL AND body < coalesce(CASE level WHEN 1 THEN one ELSE two END, 9999999)""")  # fmt: skip
def empty_sections(spark, sf):
    return reader.without_empty_sections(_leveled(spark, sf), 2).select("item_id", "idx")


@query("passage_cap", f"WITH {PASSAGE_SQL} SELECT item_id, idx FROM passage WHERE idx < 400")
def passage_cap(spark, sf):
    return reader.capped(passages(spark, sf)).select("item_id", "idx")


@query("saturation", f"{W} SELECT * FROM article")
def saturation(spark, sf):
    return _articles(spark, sf)


@query("mark_plan", f"{W} SELECT * FROM marked")
def mark_plan(spark, sf):
    return reader.marks(_judged(spark, sf), _articles(spark, sf)).select("item_id", "idx", "mark")


@query("reader_hits", f"""{W} SELECT item_id, idx, row_number() OVER w AS hit, coalesce(lead(idx) OVER w, min(idx) OVER (PARTITION BY item_id)) AS next_idx
  FROM marked WHERE mark IN ('found', 'unsure') WINDOW w AS (PARTITION BY item_id ORDER BY idx)""")  # fmt: skip
def reader_hits(spark, sf):
    return reader.hits(reader.marks(_judged(spark, sf), _articles(spark, sf))).select("item_id", "idx", "hit", "next_idx")


_VIEW = f"WITH {PASSAGE_SQL}, v AS (SELECT item_id, idx, row_number() OVER (PARTITION BY item_id ORDER BY NOT idx BETWEEN 3 AND 9, idx) AS position FROM passage)"


@query("viewport_first", f"{_VIEW} SELECT * FROM v")
def viewport_first(spark, sf):
    return reader.viewport_first(passages(spark, sf), F.lit(3), F.lit(9), 8).select("item_id", "idx", "position")


@query("chunk_ids", f"{_VIEW} SELECT item_id, (position - 1) // 8 AS chunk, count(*) AS n FROM v GROUP BY ALL")
def chunk_ids(spark, sf):
    return reader.viewport_first(passages(spark, sf), F.lit(3), F.lit(9), 8).groupBy("item_id", "chunk").agg(F.count("*").alias("n"))


@query("reader_hits_back", f"""{W} SELECT item_id, idx, coalesce(lag(idx) OVER w, max(idx) OVER (PARTITION BY item_id)) AS previous_idx
  FROM marked WHERE mark IN ('found', 'unsure') WINDOW w AS (PARTITION BY item_id ORDER BY idx)""")  # fmt: skip
def reader_hits_back(spark, sf):
    """The hit before each, the last one before the first."""
    return reader.hits(reader.marks(_judged(spark, sf), _articles(spark, sf))).select("item_id", "idx", "previous_idx")
