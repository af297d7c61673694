"""Streams in several micro-batches against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from semrank.operators import store
from semrank.sources.scratch import folder, written
from semrank.streaming import ingest, lists, versions


@pytest.fixture()
def rocks(spark):
    for k, v in lists.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in lists.STATE_STORE:
        spark.conf.unset(k)


def expected_list(batches):
    """What is shown after each batch, and the changes, as one sees them from whole snapshots."""
    rank = lambda r: (-r[1], -r[2], -r[0])
    known, shown, painted, out = {}, [], False, []
    for n, batch in enumerate(batches):
        known = {r[1]: r[1:] for r in batch if r[0] == "answer"} | known
        order = sorted(known.values(), key=rank)
        if any(r[0] == "settled" for r in batch):
            out += [(n, "merge" if painted else "paint", r[0], i + 1, r[0] not in shown) for i, r in enumerate(order)]
            break
        if not painted:
            if len(order) >= 8 or (n and order):
                painted, shown = True, [r[0] for r in order]
                out += [(n, "paint", r[0], i + 1, True) for i, r in enumerate(order)]
            continue
        lowest = max(i for i, r in enumerate(order) if r[0] in shown)
        below = [r[0] for r in order[lowest + 1 :]]
        out += [(n, "append", x, len(shown) + i + 1, True) for i, x in enumerate(below)]
        shown += below
    return out


def test_growing_lists(spark, rocks, tmp_path):
    r = random.Random(4)
    runs = {}
    for run in range(6):
        ids = r.sample(range(1000), 60)
        sizes = [(12, 9, 9), (3, 6, 8), (0, 0, 4), (0, 5, 0), (8, 0, 1), (0, 0, 0)][run]
        batches = [[("answer", ids.pop(), r.randint(0, 20), r.randint(0, 5)) for _ in range(n)] for n in sizes]
        batches[1] += batches[0][:2]  # a row that comes again
        batches[0].append(("begin", None, None, None))
        runs[run] = [*batches, [("settled", None, None, None)]]
    at = str(tmp_path)
    frames = [spark.createDataFrame([(run, n, *row) for run, b in runs.items() for row in b[n]], lists.EVENTS).repartition(3) for n in range(4)]

    def start(rows):
        return lists.growing_lists(rows).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(once=True).start()

    ingest.fed(spark, frames, f"{at}/in", start)
    got = spark.read.schema(lists.CHANGES).parquet(f"{at}/out").collect()
    for run, batches in runs.items():
        assert sorted((x.batch, x.change, x.id, x.place, x.inserted) for x in got if x.run == run) == sorted(expected_list(batches)), run


def entry(source, guid, url, title, position):
    return source, guid, url, title, "s", "c", None, position


ENTRIES = "source_id long, guid string, url string, title string, snippet string, content string, published timestamp_ntz, position long"
ITEMS = "id long, source_id long, guid string, url string, title string, snippet string, content string, published timestamp_ntz, seen timestamp_ntz"


def test_versions_share_files_and_batches_may_run_again(spark):
    root = f"{folder(spark, 'versions')}/items"
    now = F.expr("timestamp_ntz'2024-02-05'")
    items = spark.createDataFrame([(i, i % 20, f"g{i}", f"u{i}", "t", "s", "c", None, None) for i in range(100)], ITEMS)
    batches = [[entry(s, f"g{s}", f"u{s}", "new title", 0), entry(s, f"n{s}", f"v{s}", "t", 1)] for s in (1, 2, 35)]
    batches = [spark.createDataFrame(b, ENTRIES) for b in batches]
    versions.create(items, root)
    for n, b in enumerate(batches):
        versions.fold(b, root, n, now, items.schema)
        versions.fold(b, root, n, now, items.schema)  # as after a failure
    whole = items
    for b in batches:
        whole = written(store.upsert(whole, b, now).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in items.schema]), "whole")
    for n, expected in ((0, items), (3, whole)):
        assert sorted(map(tuple, versions.read(spark, root, n, items.schema).collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
    # Each version has new files for its own source's bucket alone.
    for n, source in ((1, 1), (2, 2), (3, 35)):
        made = {r.bucket: r.made for r in versions.manifest(spark, root, n).collect()}
        assert made[source % versions.BUCKETS] == n and sum(m == n for m in made.values()) == 1
    versions.drop_old(spark, root, 3, keep=1)
    assert versions.read(spark, root, 3, items.schema).count() == whole.count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        versions.manifest(spark, root, 2).count()


def test_version_of_nothing(spark):
    root = f"{folder(spark, 'versions')}/items"
    none = spark.createDataFrame([], ITEMS)
    versions.create(none, root)
    versions.fold(spark.createDataFrame([entry(3, "a", "b", "t", 0)], ENTRIES), root, 0, F.expr("timestamp_ntz'2024-02-05'"), none.schema)
    assert [r.id for r in versions.read(spark, root, 1, none.schema).collect()] == [0]


def test_saturation_stays(spark, tmp_path):
    at = str(tmp_path)
    batches = [[(1, True)] * 8 + [(2, True)] * 2, [(1, False)] * 40 + [(2, False)] * 9, [(2, True)] * 20 + [(3, False)]]

    def start(rows):
        fold = lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")
        return ingest.sticky_saturation(rows, 0.35, 8).writeStream.foreachBatch(fold).outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()

    ingest.fed(spark, [spark.createDataFrame(b, "item_id long, found boolean").repartition(2) for b in batches], f"{at}/in", start)
    got = {(r.batch, r.item_id): (r.checked, r.found, r.saturated) for r in spark.read.parquet(f"{at}/out").collect()}
    assert got == {(0, 1): (8, 8, True), (0, 2): (2, 2, False), (1, 1): (48, 8, True), (1, 2): (11, 2, False), (2, 2): (31, 22, True), (2, 3): (1, 0, False)}
