"""Operators 11 to 13 against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from semrank.llm import merkle, resampling, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, bucket long, Row string"


@pytest.fixture(scope="module", autouse=True)
def in_parts(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def table(spark, rows, tmp_path):
    """rows as a written table, with columns that clash with the operators' own."""
    spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def odd_rows():
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["Ab", "cd", "éü", "x1", "AB", "zz"]) for _ in range(r.randint(0, 60))), r.choice(["en", "en", "en", None, "de", "é"]), r.choice(["s", None]), r.choice([i, None])) for i in range(700)]
    rows += [(5, "again", "en", None, 7), (5, "again", "en", None, 7), (9, None, None, None, None), (None, None, "fr", "s", 3), (None, "", "en", "s", 3), (800, "w " * 50_000, "en", "s", 1)]
    return rows


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels_of(nodes, run):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + run])) for i in range(0, len(out[-1]), run)])
    return out


def path_of(levels, i, run):
    out = []
    for level in levels[:-1]:
        first = i // run * run
        out.append((level[first : first + run], i - first))
        i //= run
    return out


def expected_manifest(rows, run=2):
    """Counter of (doc_id, leaf, subroot, root, proof, folded root, verified)."""
    groups = {}
    for doc_id, text, lang, source, n in rows:
        tampered = n is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        parts = [field(doc_id), field(source), field(lang), field(n), field(text)]
        leaf = H("".join(parts))
        groups.setdefault(lang, []).append(((doc_id is not None, doc_id, leaf), leaf, H("".join([*parts[:3], field(n + 1), parts[4]])) if tampered else leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[1] for x in sorted(groups[g], key=lambda x: x[0])], run) for g in order}
    top = levels_of([trees[g][-1][0] for g in order], run)
    out = Counter()
    for k, g in enumerate(order):
        for i, (key, leaf, given) in enumerate(sorted(groups[g], key=lambda x: x[0])):
            path = path_of(trees[g], i, run) + path_of(top, k, run)
            folded = given
            for nodes, slot in path:
                folded = H("".join([*nodes[:slot], folded, *nodes[slot + 1 :]]))
            proof = "".join("".join(nodes[:slot] + nodes[slot + 1 :]) for nodes, slot in path)
            out[key[1], leaf, trees[g][-1][0], top[-1][0], proof, folded, folded == top[-1][0]] += 1
    return out


def tampered():
    return F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0, F.col("n_chars") + 1)


@pytest.mark.parametrize("tree", [merkle.Tree(), merkle.Tree(run=3, height=2), merkle.Tree(run=2, height=3)])
def test_manifest(spark, tmp_path, tree):
    rows = odd_rows()
    got = merkle.manifest(table(spark, rows, tmp_path), tampered(), tree).collect()
    found = Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.verified) for r in got)
    assert found == expected_manifest(rows, tree.run)
    assert 0 < sum(not r.verified for r in got) < len(got)


@pytest.mark.parametrize("n", [1, 2, 3, 257])
def test_manifest_of_one_language(spark, tmp_path, n):
    rows = [(i, f"t{i}", "en", None, i) for i in range(n)]
    docs = table(spark, rows, tmp_path)
    got = merkle.manifest(docs, tampered()).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.verified) for r in got) == expected_manifest(rows)


def test_manifest_without_rows(spark, tmp_path):
    docs = table(spark, [(1, "a", "en", None, 1)], tmp_path).where("doc_id < 0")
    assert merkle.manifest(docs, tampered()).collect() == []


def test_verify(spark, tmp_path):
    got = merkle.manifest(table(spark, odd_rows()[:50], tmp_path))
    wrong = F.sha2("leaf", 256)
    assert got.where(~merkle.verify(F.col("leaf"), F.col("path"), F.col("root"))).count() == got.where(merkle.verify(wrong, F.col("path"), F.col("root"))).count() == 0


def expected_draw(rows, target, p):
    """Multiset of (doc_id, n_features, weight, score), and the scores and ids of the drawn in order."""

    def grams(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [" ".join(w[i : i + n]) for n in range(1, p.most + 1) for i in range(len(w) - n + 1)]

    bucket = lambda x: zlib.crc32(x.encode()) % p.buckets
    each = [(r[0], *grams(r[1])) for r in rows]
    s = Counter(bucket(x) for _, _, g in each for x in g)
    t = Counter(bucket(x) for y in target for x in grams(y)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + p.buckets) / ((s[b] + 1) * (T + p.buckets)))) for b in s}
    out = []
    for doc_id, n_words, g in each:
        weight = sum(gain[bucket(x)] for x in g) // len(g) if g else 0
        h = int(H(f"{p.seed}:{'' if doc_id is None else doc_id}")[:8], 16)
        out.append((doc_id, n_words, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-x[4], x[0] is not None, x[0] or 0) for x in out if x[1] >= p.least_words)
    return Counter(out), able[: len(able) * p.percent // 100]


@pytest.mark.parametrize("p", [resampling.Resampling(), resampling.Resampling(most=3, buckets=50, least_words=1, percent=60, seed=1)])
def test_resample(spark, tmp_path, p):
    rows, target = odd_rows(), ["ab CD ab x1", None, "", "zz zz éü"]
    got = resampling.resample(table(spark, rows, tmp_path), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id long"), p).collect()
    every, drawn = expected_draw(rows, target, p)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == every
    ranked = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(-r.score, r.doc_id is not None, r.doc_id or 0) for r in ranked] == drawn


def test_resample_without_rows_or_target(spark, tmp_path):
    docs = table(spark, odd_rows()[:40], tmp_path)
    target = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(docs.where("doc_id < 0"), target).collect() == []
    alone = resampling.resample(docs, target.where("false")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in alone) == expected_draw(odd_rows()[:40], [], resampling.Resampling())[0]


def test_sample_keeps_rows(spark, tmp_path):
    docs = table(spark, odd_rows()[:100], tmp_path)
    target = spark.createDataFrame([("ab cd",)], "text string")
    kept = resampling.sample(docs, target)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in resampling.resample(docs, target).collect() if r.rank is not None}


@pytest.mark.parametrize("bucket_bytes", [8 << 20, 200])
def test_shards(spark, tmp_path, bucket_bytes):
    rows = odd_rows() + [(77, "hot", "en", "s", 1)] * 400
    docs = table(spark, rows, tmp_path).withColumn("tags", F.create_map(F.lit("a"), F.lit(1))).withColumn("Shard", F.lit(-1))
    p = sharding.Sharding(bucket_bytes=bucket_bytes)
    got = sharding.shards(docs, p).collect()
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got) == Counter(rows)
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "leaf", "bucket", "Row", "tags", "shard", "slot"}
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(16))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for x in by.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
    # Random: neither the hot rows nor the order of ids stay together.
    assert all(10 <= sum(r.doc_id == 77 for r in x) <= 45 for x in by.values())
    ids = [r.doc_id or 0 for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert sum(a < b for a, b in zip(ids, ids[1:], strict=False)) < 0.6 * len(ids)
    assert sorted(map(str, got)) == sorted(map(str, sharding.shards(docs, p).collect()))
    assert sorted(map(str, got)) != sorted(map(str, sharding.shards(docs, sharding.Sharding(seed=12, bucket_bytes=bucket_bytes)).collect()))


def test_exchange_in_a_bucket_is_uniform(spark, tmp_path):
    """Each of three rows comes first about as often over many seeds: all in one bucket, so by the exchange alone."""
    docs = table(spark, [(i, "t", "en", None, 1) for i in range(3)], tmp_path)
    seen = Counter()
    for seed in range(60):
        rows = sharding.shuffled(docs, sharding.Sharding(seed=seed)).select("row.doc_id", "at").collect()
        seen[tuple(r.doc_id for r in sorted(rows, key=lambda r: r["at"]))] += 1
    assert len(seen) == 6 and max(seen.values()) <= 24


def test_few_and_no_rows(spark, tmp_path):
    docs = table(spark, [(1, "a", "en", None, 1), (2, None, None, None, None)], tmp_path)
    assert sorted((r.doc_id, r.slot) for r in sharding.shards(docs).collect()) == [(1, 0), (2, 0)]
    assert sharding.shards(docs.where("doc_id < 0")).collect() == []


def test_written_shards(spark, tmp_path):
    docs = table(spark, odd_rows(), tmp_path)
    sharding.write(docs, str(tmp_path / "out"), sharding.Sharding(shards=4))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(odd_rows()) and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
