"""Cases that larger tables brought up."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semrank.functions import urls
from semrank.operators import store
from semrank.plans import registry
from semrank.sources import html_blocks
from semrank.sources.scratch import written
from semrank.streaming import ingest
from tests.oracle import differences


@pytest.fixture()
def made(spark, tmp_path):
    """Writes rows as a table of a folder of their own, and tells how a query differs from its SQL over it."""

    def differing(query, name, rows):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
        con = duckdb.connect()
        con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
        return differences(registry.queries()[query](spark, str(tmp_path)), con, registry.oracle_sql()[query])

    return differing


def test_arxiv_numbers_are_not_cut(spark, made):
    one = spark.range(1).select(urls.arxiv_id(F.lit("https://arxiv.org/abs/2401.100002v2")).alias("id")).first()
    assert one.id == "2401.100002"
    assert made("arxiv_ids", "pages", spark.range(99_990, 100_020).withColumnRenamed("id", "page_id")) == []


PAGE = '<html><body><div class="ad">Buy</div><article><h1>Than&amp; Enbeau&amp{}</h1><p>A paragraph that is long enough to be one, with &quot;words&quot; &amp; more.</p><p>And a second one, which is about as long as the first.</p></article></body></html>'


def test_references_without_a_semicolon_stay(spark, made):
    rows = [(i, "https://a.example/", PAGE.format(x)) for i, x in enumerate(("", ";", ";&am", "p;", " x"))]
    assert made("extract_blocks", "pages", spark.createDataFrame(rows, "page_id long, url string, html string")) == []
    page = html_blocks.Page('<p class="a&amp=1">R&D &lt 5 &#38 &amp;lt; &eacute;</p><script type="math/tex">a&b</script>')
    assert "".join(b[2] for b in page.blocks).startswith("R&D &lt 5 &#38 &lt; é") and "﷐" not in str(page.blocks)
    assert page.boxes[0].attrs == {"class": "a&amp=1"}


def test_years_of_two_digits_are_unambiguous(spark, made):
    assert made("table_dates", "documents", spark.range(23_650, 24_400).withColumnRenamed("id", "doc_id")) == []


def test_saturation_calls_python_once_for_many_articles(spark, tmp_path):
    """Ids of several blocks, negative and null ones too: a row of state for each block, not for each article."""
    ids = [*range(-300, 300), 10**12, None]
    batches = [[(i, k % 3 == 0) for i in ids for k in range(9)], [(i, None if k else i is None) for i in ids[::2] for k in range(9)]]

    def start(rows):
        fold = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
        return ingest.sticky_saturation(rows, 0.3, 8).writeStream.foreachBatch(fold).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()

    ingest.fed(spark, [spark.createDataFrame(b, "item_id long, found boolean").repartition(3) for b in batches], f"{tmp_path}/in", start)
    got = {(r.batch, r.item_id): (r.checked, r.found, r.saturated) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {**{(0, i): (9, 3, True) for i in ids}, **{(1, i): (18, 3 + (i is None) * 9, True) for i in ids[::2]}}
    assert spark.read.format("statestore").load(f"{tmp_path}/state").count() == 6


ENTRIES = "source_id long, guid string, url string, title string, snippet string, content string, published timestamp_ntz, position long"
ITEMS = "id long, source_id long, guid string, url string, title string, snippet string, content string, published timestamp_ntz, seen timestamp_ntz"
NOW = "timestamp_ntz'2024-02-05'"


def test_texts_of_an_upsert_move_once(spark):
    """Shuffled bytes against those of the texts: none of them for the changes, the batch's once for the whole rows."""
    text = "concat_ws(' ', transform(sequence(1, 40), x -> sha2(concat(id, '-', x, '-{}'), 512)))"
    stored = written(spark.range(2000).selectExpr("id", "id % 7 AS source_id", "concat('g', id) AS guid", "concat('u', id) AS url", "'t' AS title", "'s' AS snippet", f"{text.format('a')} AS content", "timestamp_ntz'2024-01-01' AS published", "timestamp_ntz'2024-01-02' AS seen"), "stored")
    batch = written(spark.range(1000, 3000).selectExpr("id % 7 AS source_id", "concat('g', id) AS guid", "concat('u', id) AS url", "'t' AS title", "'s' AS snippet", f"{text.format('b')} AS content", "timestamp_ntz'2024-01-01' AS published", "id AS position"), "batch")
    size = batch.selectExpr("sum(length(content)) AS n").first().n
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    start = shuffled()
    changes = store.upsert(stored, batch, F.expr(NOW)).groupBy("action").count()
    assert {r.action: r["count"] for r in changes.collect()} == {"new": 1000, "edited": 1000, "kept": 1000}
    middle = shuffled()
    assert written(store.upsert(stored, batch, F.expr(NOW)), "whole").count() == 3000
    assert middle - start < 0.1 * size and shuffled() - middle < 1.2 * size


def test_upsert_of_odd_entries(spark):
    """Entries without guid or url, copies, two entries of one stored item, null texts, items that aren't listed."""
    stored = [(3, 1, "a", "u1", "t", None, "c", None, None), (5, 1, "b", "u1", "t", "s", "c", None, None), (8, 2, "a", None, None, "s", "c", None, None), (9, 2, "z", "u9", "t", "s", "c", None, None)]
    batch = [
        (1, "a", "u1", "t", None, "c", None, 0), (1, "x", "u1", "t", None, "c", None, 1), (2, "a", None, "", "s", "c", None, 0), (2, None, None, "n", "s", "c", None, 1), (2, None, None, "m", "s", "c", None, 1),
        (None, "q", "u9", "t", "s", "c", None, 0), (1, "w", "u7", "t", "s", "c", None, 2),
    ]
    out = store.upsert(spark.createDataFrame(stored, ITEMS), spark.createDataFrame(batch, ENTRIES), F.expr(NOW))
    got = sorted((r.id, r.source_id or 0, r.guid or "", r.title or "", r.action) for r in out.collect())
    fresh = [r for r in got if r[-1] == "new"]
    assert [r for r in got if r[-1] != "new"] == [(3, 1, "a", "t", "kept"), (3, 1, "a", "t", "kept"), (5, 1, "b", "t", "kept"), (8, 2, "a", "", "edited"), (9, 2, "z", "t", "kept")]
    assert [r[0] for r in fresh] == [10, 11, 12, 13] and [r[1:3] for r in fresh] == [(0, "q"), (1, "w"), (2, ""), (2, "")] and {r[3] for r in fresh[2:]} == {"m", "n"}


@pytest.mark.parametrize("query", ["embedded_articles", "json_pages", "page_bytes"])
def test_whole_bodies_go_to_python_in_small_batches(spark, query):
    """Arrow would take 10,000 bodies at once, whatever their size."""
    plan = registry.queries()[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_pages_are_parsed_in_parts():
    """The rows of a large batch of pages don't stand in a worker at once."""
    html = [None, "", *["<article><h1>Title</h1><p>A text of some words.</p></article>"] * 998]
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(1, 1000)], pa.int64()), pa.array(html)], ["item_id", "html"])
    out = list(html_blocks._in_parts(iter([batch])))
    assert len(out) == 1000 / html_blocks.PAGES and max(len(set(b["item_id"].to_pylist())) for b in out) <= html_blocks.PAGES
    rows = [r for b in out for r in b.to_pylist()]
    assert {r["item_id"] for r in rows} == {*range(2, 1000)} and sum(r["text"] == "A text of some words." for r in rows) == 998
    assert list(html_blocks._in_parts(iter([batch.slice(0, 2)])))[0].num_rows == 0
