import hashlib
import random

import pytest
from pyspark.sql import functions as F

from semrank.llm.hashing import digest
from semrank.llm.substring_dedup import Repeats, deduplicate, repeats

WORDS = ["the", "of", "a"] * 5 + [f"w{i}" for i in range(60)] + ["Ünï", "x y", "."]


def brute(rows, k):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(w for w in words if w is not None):
        for j in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][j : j + k]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j : j + k])] < i:
                gone.update(range(j, j + k))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


def fixture():
    rng = random.Random(3)
    def text(n):
        return rng.choice([" ", "\n"]).join(rng.choice(WORDS) for _ in range(n))
    passages = [text(n) for n in (13, 14, 20, 60, 200)]
    rows = [(100 + i, text(rng.randrange(0, 60)) + " " + rng.choice(passages) + "\t" + text(rng.randrange(0, 60))) for i in range(80)]
    rows += [(300 + i, rows[i][1]) for i in range(20)]
    rows += [(10 + i, rows[i][1][:-30]) for i in range(5)]
    loop = "a b c d e f g " * 12
    rows += [(1, None), (2, ""), (3, " \n "), (4, text(12)), (5, text(12)), (600, loop), (601, loop + "z"), (602, " ".join(p for p in passages)), (603, text(20000) + " " + passages[3])]
    return rows


def test_equals_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for p in (Repeats(), Repeats(window=7, anchor=3), Repeats(hot=3)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in deduplicate(docs, p).collect()}
        assert got == brute(rows, p.window)


def test_spans_are_paths_with_sources(spark):
    rows = fixture()
    words = {i: (t or "").encode().split() for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeats(docs).collect()
    assert found
    for s in found:
        here, there = words[s.doc_id][s.start : s.start + s.length], words[s.source_doc][s.source_start : s.source_start + s.length]
        assert s.source_doc < s.doc_id and here == there and digest(b" ".join(there)) == s.words


def thue_morse(n, letters="ab", flip=0):
    return [letters[(bin(i).count("1") + flip) % 2] for i in range(n)]


def test_words_and_texts_that_cancel_in_polynomials(spark):
    """Words and texts of which every polynomial modulo 2^64 has the same value."""
    one, two = "".join(thue_morse(2048)), "".join(thue_morse(2048, flip=1))
    rows = [(1, " ".join([one, *(f"w{i}" for i in range(12))])), (2, " ".join([two, *(f"w{i}" for i in range(12))]))]
    # Long texts that differ at 2,048 places only.
    fill = " ".join(f"f{i}" for i in range(26_624))
    rows += [(3, " ".join(thue_morse(2048, ["x", "y"])) + " " + fill), (4, " ".join(thue_morse(2048, ["x", "y"], 1)) + " " + fill)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in deduplicate(docs).collect()}
    assert got == brute(rows, 13)
    assert got[2][1] == 0


def test_collisions_of_hashes_are_found_and_undone(spark, monkeypatch):
    """With hashes of windows that collide under the first seed, words are compared at the sources and the second seed is right."""
    from semrank.llm import substring_dedup

    right = substring_dedup._edges

    def colliding(texts, p, seed, until=1):
        rows = right(texts, p, seed)
        return rows if seed >= until else rows.withColumn("hs", F.transform("hs", lambda h: F.lit(1).cast("long"))).withColumn("gs", F.transform("gs", lambda g: F.lit(1)))

    monkeypatch.setattr(substring_dedup, "_edges", colliding)
    rows = fixture()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 13)
    monkeypatch.setattr(substring_dedup, "_edges", lambda texts, p, seed: colliding(texts, p, seed, 9))
    with pytest.raises(RuntimeError):
        deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))


def test_several_texts_of_one_doc_id(spark):
    """Each text of a doc_id is held against smaller doc_ids, not against the others of its own."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, f"{c} {b}"), (2, f"q {a} q"), (2, f"q {a} q"), (2, None), (2, b), (3, f"{b} z"), (3, f"q {a} q")]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == sorted([(1, 40, 0, a), (2, 80, 0, f"{c} {b}"), (2, 42, 40, "q q"), (2, 42, 40, "q q"), (2, 0, 0, ""), (2, 40, 0, b), (3, 41, 40, "z"), (3, 42, 42, "")])


def test_repeated_rows_nulls_and_clashing_columns(spark):
    t = " ".join(f"v{i}" for i in range(20))
    rows = [(7, t, 1), (7, t, 1), (None, t, 2), (9, t, 3)]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in deduplicate(spark.createDataFrame(rows, "doc_id long, text string, anchor long")).collect())
    assert got == [("7", 20, 0), ("7", 20, 0), ("9", 20, 20), ("None", 20, 0)]
    assert deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
