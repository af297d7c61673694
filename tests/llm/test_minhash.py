import math
import random
from collections import Counter

import numpy as np
import pytest

from semrank.llm.minhash import NearDup, check_samples, near_duplicates, samples

WORDS = [f"w{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in t.split())


def brute(rows, p):
    """Classes by plain set arithmetic over all pairs."""
    bags = {}
    for i, t in rows:
        w = [x for x in "".join(c.lower() if c.isalnum() and c.isascii() else c if ord(c) > 127 else " " for c in t or "").split(" ") if x]
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    n = sum(1 for b in bags.values() if b)
    df = Counter(g for b in bags.values() for g in b)
    weight = {i: {g: tf * (1 + math.log(max(df[g] / n, p.rare)) / math.log(p.rare)) for g, tf in b.items()} for i, b in bags.items()}
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    for x in ids:
        for y in ids:
            if x < y and weight[x] and weight[y]:
                s = sum(min(v, weight[y].get(g, 0)) for g, v in weight[x].items())
                total = sum(weight[x].values()) + sum(weight[y].values()) - s
                if s / total >= p.threshold:
                    a, b = find(x), find(y)
                    root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_classes_equal_brute_force(spark):
    rng = random.Random(5)
    base = [text(rng, n) for n in (3, 12, 60, 200, 900)]
    rows = [(i, t) for i, t in enumerate(base)]
    for t in base:
        for share in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.2):
            rows.append((len(rows), edited(rng, t, share)))
    rows += [(len(rows) + k, text(rng, 80)) for k in range(60)]
    rows += [(1000, None), (1001, ""), (1002, " .. "), (1003, None), (1004, "one"), (1005, "ONE!"), (1006, "é ü"), (1007, "é, ü")]
    p = NearDup(block=5000, segment=4)
    got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), p).collect()}
    want = brute(rows, p)
    assert {i: c for i, (c, _) in got.items()} == want
    assert all(k == (i == c) for i, (c, k) in got.items())
    assert want[1005] == 1004 and want[1007] == 1006 and want[1001] == 1001


def test_chain_of_copies_in_one_bucket(spark):
    """Copies of copies: leaders aren't similar to all members, later links still join the class."""
    rng = random.Random(6)
    t, rows = text(rng, 300), []
    for i in range(40):
        rows.append((i, t))
        t = edited(rng, t, 0.008)
    p = NearDup()
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()}
    assert got == brute(rows, p)


def test_empty_table_repeated_rows_and_other_columns(spark):
    none = near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert none.columns == ["doc_id", "component_id", "kept"] and none.count() == 0
    rows = [(1, "a b c d e f", 5, "x"), (1, "a b c d e f", 5, "x"), (2, "A b c d e f", 6, "y"), (None, None, None, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, rep long, band string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 1, False), (None, None, True)} and len(got) == 3


def test_rows_of_one_doc_id_with_different_texts(spark):
    """The least text counts: 1 is "a ...", so 2 and 3 have no partner through it."""
    rows = [(1, "a b c d e f"), (1, "n o p q r s"), (2, "n o p q r s"), (3, "t u v w x y"), (4, "a b c d e f"), (None, "a b c d e f")]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 1, False), (None, None, True)}


def test_a_third_of_the_rows_are_copies_and_near_copies(spark):
    rng = random.Random(9)
    hot = text(rng, 120)
    rows = [(i, text(rng, 40)) for i in range(120)] + [(200 + i, hot) for i in range(40)] + [(300 + i, edited(rng, hot, 0.01)) for i in range(40)]
    p = NearDup(star=4, segment=8)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), p).collect()}
    assert got == brute(rows, p)


def test_lines_repeated_hundreds_of_times(spark):
    """Most of the weight is in ten shingles, beside different own text: linked by the whole bag, or by none of it."""
    rng = random.Random(7)
    rows = []
    for _ in range(6):
        line = text(rng, 10)
        rows += [(len(rows) + k, " ".join([line] * 400) + " " + text(rng, own)) for k, own in enumerate((250, 250, 300, 300, 4000))]
    rows += [(len(rows) + k, text(rng, 80)) for k in range(30)]
    p = NearDup()
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()}
    want = brute(rows, p)
    assert got == want
    assert want[3] == 0 and want[4] == 4


@pytest.mark.parametrize("own, n_shared, tf", [(500, 10, 400), (200, 300, 1), (0, 20, 3), (40, 1, 1000), (900, 100, 2)])
def test_samples_agree_with_the_weighted_jaccard_of_the_bags(own, n_shared, tf):
    rng = np.random.default_rng(own)
    shared, one, two = (rng.integers(0, 1 << 48, size=n, dtype=np.uint64) for n in (n_shared, own, own))
    grams = np.concatenate([shared, one, shared, two])
    row = np.repeat([0, 1], n_shared + own)
    copies = np.concatenate([np.full(n_shared, tf), np.ones(own), np.full(n_shared, tf * 2), np.ones(own)]).astype(float)
    idf = np.concatenate([np.full(n_shared, 1.3), np.full(own, 2.0)] * 2)
    weight = copies * idf
    low, high = weight[: n_shared + own], weight[n_shared + own :]
    least = low[:n_shared].sum()
    want = least / (low.sum() + high.sum() - least)
    for ids in (samples(row, grams, weight, 2, 4096, 3), check_samples(row, grams, copies, idf, 2, 4096, 3)):
        assert abs((ids[0] == ids[1]).mean() - want) < 4 * (want * (1 - want) / 4096) ** 0.5 + 0.001


def test_idf_grows_below_the_common_share(spark):
    """A template that 3 of 400 documents share weighs less than text of one document only, and it doesn't link them."""
    rng = random.Random(8)
    template = text(rng, 400)
    rows = [(k, template + " " + text(rng, 46)) for k in range(3)] + [(10 + k, text(rng, 30)) for k in range(397)]
    p = NearDup()
    bags = [Counter(zip(*(t.split()[j:] for j in range(5)))) for _, t in rows[:2]]
    shared = sum((bags[0] & bags[1]).values())
    own = sum(bags[0].values()) - shared
    weigh = lambda df: 1 + math.log(df / len(rows)) / math.log(p.rare)
    flat, exact = shared / (shared + 2 * own), shared * weigh(3) / (shared * weigh(3) + 2 * own * weigh(1))
    assert exact < p.threshold < flat
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), p).collect()}
    assert got == {i: i for i, _ in rows}


def test_texts_that_cancel_in_polynomials_are_two_nodes(spark):
    """Two texts that every polynomial modulo 2^64 takes for one: they differ at 2,048 of 4,096 places."""
    bit = lambda i, flip: (bin(i).count("1") + flip) % 2
    fill = " ".join(f"f{i}" for i in range(2048))
    rows = [(k + 1, " ".join("xy"[bit(i, k)] for i in range(2048)) + " " + fill) for k in (0, 1)]
    long = [(k + 3, "".join("xy"[bit(i, k)] for i in range(2048))) for k in (0, 1)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows + long, "doc_id long, text string")).collect()}
    assert got[3] == 3 and got[4] == 4
