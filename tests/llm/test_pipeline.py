"""Each stage of the pipeline on a small made-up corpus, against plain Python, and the whole of it."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as P

CLEAN = [f"word{i}" for i in range(300)]
VILE = ["vile", "rotten", "nasty", "filth"]


def made(spark, tmp):
    """Documents with toxic ones, repeated lines, near copies, passages of the benchmark, nulls, repeats and clashing columns."""
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(CLEAN) for _ in range(n))
    rows, labels = [], []
    for i in range(60):
        toxic = i % 4 == 0
        text = words(40) + (" " + " ".join(rng.choice(VILE) for _ in range(12)) if toxic else "")
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    lines = "\n".join(words(12) for _ in range(4))
    rows += [(100, lines + "\n" + words(30)), (101, words(30) + "\n" + lines), (102, lines)]
    near = words(200)
    rows += [(200, near), (201, near), (202, near + " tail"), (203, words(200))]
    passage = words(14)
    rows += [(300, words(20) + " " + passage.upper() + " " + words(20)), (301, words(60))]
    rows += [(400, None), (401, ""), (None, words(25)), (403, "one two"), (403, "one two")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, key double")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp}/labels.parquet")
    spark.createDataFrame([("q1", passage), ("q2", None), ("q3", "")], "item_id string, text string").write.parquet(f"{tmp}/benchmark.parquet")
    table.write.parquet(f"{tmp}/documents.parquet")
    return rows, table


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    tmp = str(tmp_path_factory.mktemp("corpus"))
    return (*made(spark, tmp), tmp)


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_toxic_documents_go(spark, corpus):
    rows, table, sf = corpus
    assert kept(P.drop_toxic(spark, table, sf)) == Counter(r for r in rows if not (r[0] is not None and r[0] < 60 and r[0] % 4 == 0))


def test_repeated_lines_go(spark, corpus):
    rows, table, sf = corpus
    got = {r.doc_id: r for r in P.dedup_lines(spark, table, sf).collect()}
    text = {i: t for i, t in rows}
    assert got[100].text == text[100] and 102 not in got and got[101].text == text[101].split("\n")[0] and got[101].n_chars == len(got[101].text)
    assert kept(P.dedup_lines(spark, table, sf)) == Counter((i, got[101].text if i == 101 else t) for i, t in rows if i != 102)


def test_one_of_near_copies_stays(spark, corpus):
    rows, table, sf = corpus
    assert kept(P.dedup_near(spark, table, sf)) == Counter(r for r in rows if r[0] not in (201, 202))


def test_benchmark_passages_go(spark, corpus):
    rows, table, sf = corpus
    assert kept(P.drop_benchmark(spark, table, sf)) == Counter(r for r in rows if r[0] != 300)


def test_packing_keeps_every_document(spark, corpus):
    rows, table, sf = corpus
    pieces = P.pack(spark, table, sf).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(i for i, _ in rows)
    used = Counter()
    for r in pieces:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and sum(used.values()) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_whole_pipeline_applies_its_stages(spark, corpus):
    rows, _, sf = corpus
    got = {r.doc_id for r in P.run(spark, sf).collect()}
    gone = {i for i in range(60) if i % 4 == 0} | {102, 201, 202, 300}
    assert got == {i for i, _ in rows} - gone
    assert [name for name, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_empty_tables_and_missing_columns(spark, corpus):
    _, table, sf = corpus
    for _, stage in P.STAGES:
        assert stage(spark, table.limit(0), sf).count() == 0
        out = stage(spark, table.select("doc_id", "text"), sf)
        assert "doc_id" in out.columns and not re.search("lang|source|n_chars", " ".join(out.columns))
