"""Positions, running sums and what is built on them, with most rows in one group."""

import random

import pytest
from pyspark.sql import functions as F

from semrank.operators import evaluate, ranks, store
from semrank.sources.scratch import written


@pytest.fixture(scope="module", autouse=True)
def in_parts(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows(spark):
    """90% of the rows in one group, a group that is null, and groups of one row."""
    r = random.Random(5)
    groups = ["big"] * 9000 + [None] * 300 + ["small"] * 200 + [f"g{i}" for i in range(500)]
    data = [(g, i, r.randint(0, 50), r.choice([None, 1, 2, 3])) for i, g in enumerate(groups)]
    r.shuffle(data)
    return written(spark.createDataFrame(data, "g string, k long, a int, v long").repartition(5), "rows")


def _by_group(rows, order):
    out = {}
    for r in rows:
        out.setdefault(r.g, []).append(r)
    return {g: sorted(x, key=order) for g, x in out.items()}


@pytest.mark.parametrize("share", [ranks.HOT_SHARE, 0.02])
def test_numbered(rows, monkeypatch, share):
    monkeypatch.setattr(ranks, "HOT_SHARE", share)
    got = ranks.numbered(rows, [F.col("a").desc(), "k"], ["g"])
    assert got.columns == ["g", "k", "a", "v", "position"]
    for x in _by_group(got.collect(), lambda r: (-r.a, r.k)).values():
        assert [r.position for r in x] == list(range(len(x)))


def test_numbered_over_all(rows):
    got = sorted(ranks.numbered(rows, ["k"], name="n").collect(), key=lambda r: r.k)
    assert [r.n for r in got] == list(range(10_000))


def test_running(rows):
    for x in _by_group(ranks.running(rows, ["a", "k"], "v", ["g"]).collect(), lambda r: (r.a, r.k)).values():
        total = 0
        for r in x:
            assert r.before == total
            total += r.v or 0


def test_no_task_holds_a_group(spark, rows):
    """The largest group lies in all partitions of the ranges."""
    placed = ranks._dealt(rows, ["g"], [F.col("a"), F.col("k")])
    sizes = [r["count"] for r in placed.groupBy(F.shiftright("_at", 33)).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 5000


def test_empty(spark, rows):
    none = rows.where("k < 0")
    assert ranks.numbered(none, ["k"], ["g"]).count() == ranks.numbered(none, ["k"]).count() == ranks.running(none, ["k"], "v", ["g"]).count() == 0


def test_spearman_and_topk_of_a_large_group(rows):
    both = rows.withColumn("b", (F.col("k") * 7919 % 1000).cast("int"))
    local = _by_group(both.collect(), lambda r: r.k)
    rho = {r.g: r.rho for r in evaluate.spearman(both, "g", "k").collect()}
    shared = {r.g: r.shared for r in evaluate.topk_overlap(both, "g", "k", 20).collect()}
    for g, x in local.items():
        ra = {r.k: i for i, r in enumerate(sorted(x, key=lambda r: (r.a, r.k)))}
        rb = {r.k: i for i, r in enumerate(sorted(x, key=lambda r: (r.b, r.k)))}
        n = len(x)
        assert rho[g] == (None if n == 1 else round(1 - 6 * sum((ra[k] - rb[k]) ** 2 for k in ra) / (n * (n * n - 1)), 9))
        top = [{r.k for r in sorted(x, key=lambda r: (-r[c], r.k))[:20]} for c in ("a", "b")]
        assert shared[g] == len(top[0] & top[1])


def test_budget_of_a_large_day(rows):
    sent = store.within_budget(rows, "g", ["k"], "v", 900)
    kept = {r.k for r in sent.collect()}
    for x in _by_group(rows.collect(), lambda r: r.k).values():
        total = 0
        for r in x:
            assert (r.k in kept) == (total < 900)
            total += r.v or 0
