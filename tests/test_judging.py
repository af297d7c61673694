"""The loop of a judge over rows: what is asked, what is kept, how a pass ends."""

from pyspark.sql import functions as F

from semrank.operators import judging
from semrank.sources.scratch import folder

PAIRS = "text_hash string, state string, position long, frame_hash string, frame string"


def pairs(spark, texts, frames=("a", "b")):
    return spark.createDataFrame([(f"t{i:03}", f"text {i}", i, f"h{f}", f) for i in range(texts) for f in frames], PAIRS)


def empty_cache(spark):
    root = folder(spark, "cache")
    spark.createDataFrame([], judging.CACHE).write.parquet(root)
    return root


class Judge:
    """Answers by rules on the place of a request; remembers what it was asked."""

    def __init__(self, status=lambda p: F.lit("answered"), ps=lambda p: F.lit(0.5)):
        self.status, self.ps, self.asked = status, ps, []

    def __call__(self, requests):
        self.asked += [(r.text_hash, r.position, tuple(r.frames)) for r in requests.collect()]
        p = F.col("position")
        return requests.select("text_hash", "position", self.status(p).alias("status"), F.transform("frames", lambda f: self.ps(p)).alias("ps"))


def held(spark, root):
    return {(r.text_hash, r.frame_hash): r.p for r in judging.cache(spark, root).collect()}


def test_waves_in_order_and_nothing_asked_twice(spark):
    root, rows = empty_cache(spark), pairs(spark, 10)
    spark.createDataFrame([("t001", "ha", "m", 0.25), ("t002", "ha", "old", 0.25)], judging.CACHE).write.mode("append").parquet(root)
    judge = Judge()
    assert judging.judge_pass(rows, root, judge, "m", wave=4) == "completed"
    assert sorted(judge.asked) == [(f"t{i:03}", i, ("b",) if i == 1 else ("a", "b")) for i in range(10)]
    waves = [{x[1] for x in judge.asked[k : k + 4]} for k in (0, 4, 8)]
    assert waves == [{0, 1, 2, 3}, {4, 5, 6, 7}, {8, 9}]
    again = Judge()
    assert judging.judge_pass(rows, root, again, "m", wave=4) == "completed" and again.asked == []
    assert len([k for k in held(spark, root)]) == 20 and held(spark, root)["t001", "ha"] == 0.25


def test_failures_settle_in_a_second_pass(spark):
    root, rows = empty_cache(spark), pairs(spark, 30)
    assert judging.judge_pass(rows, root, Judge(lambda p: F.when(p % 10 < 3, "unreachable").otherwise("answered")), "m", wave=8) == "completed"
    assert {k[0] for k in held(spark, root)} == {f"t{i:03}" for i in range(30) if i % 10 >= 3}
    second = Judge()
    assert judging.judge_pass(rows, root, second, "m", wave=8) == "completed"
    assert {x[0] for x in second.asked} == {f"t{i:03}" for i in range(30) if i % 10 < 3} and len(held(spark, root)) == 60


def test_bad_answers_stay_missing(spark):
    root, rows = empty_cache(spark), pairs(spark, 6)
    judge = Judge(ps=lambda p: F.when(p == 0, 1.5).when(p == 1, F.lit(None)).when(p == 2, F.lit(float("nan"))).otherwise(1.0))
    assert judging.judge_pass(rows, root, judge, "m") == "completed"
    assert set(held(spark, root)) == {(f"t{i:03}", h) for i in (3, 4, 5) for h in ("ha", "hb")}


def test_ten_failures_in_a_row_end_a_pass_across_waves(spark):
    root, rows = empty_cache(spark), pairs(spark, 40)
    judge = Judge(lambda p: F.when(p >= 5, "unreachable").otherwise("answered"))
    assert judging.judge_pass(rows, root, judge, "m", wave=8) == "offline"
    assert len(judge.asked) == 16 and len(held(spark, root)) == 10
    stop = Judge(lambda p: F.when(p == 2, "unauthorized").otherwise("answered"))
    assert judging.judge_pass(rows, root, stop, "m", wave=8) == "keyRejected" and len(stop.asked) == 8
    assert judging.judge_pass(pairs(spark, 0), root, stop, "m") == "completed"
