import numpy as np

from semrank.llm.embedding_dedup import Projections, collisions, near_duplicates, plan, sized

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.95):
    ok = {}
    for i, v, _ in rows:
        if i is not None and v is not None and len(v) and all(x is not None for x in v):
            x = np.array(v, dtype=np.float32).astype(np.float64)
            if np.isfinite(x).all() and np.linalg.norm(x) > 0:
                ok[i] = x / np.linalg.norm(x)
    ids = sorted(ok)
    near = {i: set() for i in {r[0] for r in rows}}
    for a in ids:
        for b in ids:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine:
                near[a].add(b)
                near[b].add(a)
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(near[i]), None if i is None else min(seen))
    return out


def fixture():
    rng = np.random.default_rng(1)
    rows = []
    for size, n in ((64, 150), (5, 40)):
        for _ in range(n):
            base = rng.standard_normal(size)
            for _ in range(rng.integers(1, 6)):
                v = base + rng.standard_normal(size) * np.linalg.norm(base) / np.sqrt(size) * rng.choice([0.02, 0.1, 0.18, 0.25])
                rows.append((1000 - len(rows), [float(x) for x in v], 1))
    hot = rng.standard_normal(64)
    rows += [(2000 + i, [float(x) for x in hot + 0.14 * rng.standard_normal(64)], 2) for i in range(120)]
    rows += [(3000 + i, [float(x) for x in hot], 2) for i in range(30)]
    rows += [(4000, None, 0), (4001, [0.0] * 64, 0), (4002, [float("nan")] * 64, 0), (4003, [None] + [1.0] * 63, 0), (4004, [float("inf")] + [0.0] * 63, 0), (4005, [], 0), (None, [1.0] * 64, 0)]
    return rows + rows[:3]


def test_equals_brute_force(spark):
    rows = fixture()
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    for p in (Projections(), Projections(segment=16)):
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(table, p).collect()}
        assert got == want


def test_doubles_and_empty_table(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.96, 0.28]), (3, [0.94, (1 - 0.94**2) ** 0.5])]
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False)}
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_huge_and_tiny_doubles(spark):
    rows = [(1, [1e200, 0.0]), (2, [2e200, 1e199]), (3, [1e-200, 0.0]), (4, [0.0, 1e300]), (5, [0.0, 5e-324])]
    got = {(r.vec_id, r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4)}


def test_a_third_of_the_rows_is_one_vector(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(16)], 0) for i in range(400)]
    rows += [(1000 + i, [1.0] * 16, 0) for i in range(200)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(table).collect()}
    assert got == brute(rows)


def test_count_is_calibrated_for_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    for size, n in ((64, 10**5), (64, 10**7), (256, 10**6), (8, 1000)):
        p = sized(n, Projections())
        made = plan(size, p)
        x, u = rng.standard_normal((2, 5000, size))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        u -= (u * x).sum(axis=1, keepdims=True) * x
        y = p.cosine * x + (1 - p.cosine**2) ** 0.5 * u / np.linalg.norm(u, axis=1, keepdims=True)
        a, b = made.members(x, size), made.members(y, size)
        count, _ = collisions(np.concatenate([a[0], b[0]], axis=1), np.concatenate([a[1], b[1]], axis=1), made.window)
        assert made.count >= 2 and (count >= made.count).mean() > 0.9995
    assert sized(10**9, Projections()).terms > sized(1000, Projections()).terms
