"""Operator 1: embedding near-duplicates by collision-counting projections.

All pairs of vectors with cosine of at least `cosine` are links. Vectors are projected on many directions: a direction is the
sum of `terms` signed vectors of one of `groups` random orthonormal bases, scaled to length 1. Over a whole sorted
projection, a window that keeps the links keeps a fixed share of all rows too (18% at cosine 0.95), so counting in bare windows grows
with the square of the rows. Each vector is therefore sorted only into the `own` directions of a basis on which it projects farthest, the upper
tails; `terms` grows with log of the rows, so a tail holds a bounded number of unrelated vectors at any size.

1. Rows (direction, place) of each vector; directions that hold one vector alone go, and so do vectors with fewer than
   `count` others: they can't collide `count` times. Only ids travel.
2. The others meet per direction, sorted by place. Around every vector a window of half-width `window` is looked at; a
   pair's collisions are the directions in whose windows it is.
3. Pairs with at least `count` collisions are verified by their cosine in double precision.

`count` is calibrated for recall: half of what the least of `trials` random pairs just at the threshold reach. Groups are
added until that least is 4 or more, so a link is missed with a chance far below 1/`trials`.

A pair is handled in the first direction where it collides, so each link counts once. Tasks send link counts and a spanning
forest of their links, not pairs. Equal vectors are one vector with a multiplicity. Directions beyond `segment` vectors are
dealt out in pairs of segments.

Defined results: vectors that are null, zero or hold null or non-finite components link with nothing; vectors of different
lengths don't link. Of rows that repeat a vec_id one vector counts; one row comes out per vec_id. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semrank.llm.common import batch, components, forget, lookup, map_arrow, released, stored
from semrank.llm.hashing import mix


@dataclass(frozen=True)
class Projections:
    cosine: float = 0.95
    groups: int = 8
    most_groups: int = 64
    own: int = 6
    #: The farthest basis vectors whose sums are looked at, and vectors of a basis at most.
    top: int = 10
    basis: int = 256
    #: Half-width of a window in standard deviations of a link's difference on a direction.
    sigmas: float = 3.0
    trials: int = 2000
    #: Unrelated vectors that a direction may hold on average.
    crowd: float = 0.05
    segment: int = 1024
    seed: int = 11
    #: Set by sized().
    terms: int = 3


def sized(n: int, p: Projections) -> Projections:
    """terms for n vectors, of a basis of 64 vectors or more; shorter vectors have fewer and so larger directions."""
    terms = 2
    while terms < 6 and n * p.own > p.crowd * 2**terms * math.comb(64, terms):
        terms += 1
    return replace(p, terms=terms)


@dataclass
class Plan:
    """The directions of vectors of one length."""

    bases: list[np.ndarray]
    sums: np.ndarray  #: combinations of the farthest basis vectors
    own: int
    window: float
    count: int = 1

    def members(self, x: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """(directions, places) of unit vectors x, one row each."""
        terms, ids, places = self.sums.shape[1], [], []
        for g, basis in enumerate(self.bases):
            on = x @ basis.T
            far = np.argpartition(-np.abs(on), self.sums.max(), axis=1)[:, : self.sums.max() + 1]
            code = np.sort(far * 2 + (np.take_along_axis(on, far, 1) > 0), axis=1)
            size = np.abs(np.take_along_axis(on, code >> 1, 1))[:, self.sums].sum(axis=2) / math.sqrt(terms)
            best = np.argsort(-size, axis=1, kind="stable")[:, : self.own]
            chosen = code[np.arange(len(x))[:, None, None], self.sums[best]]
            name = np.full(best.shape, salt * 64 + g, dtype=np.uint64)
            for t in range(terms):
                name = mix(name * np.uint64(1024) + chosen[:, :, t].astype(np.uint64))
            ids.append(name)
            places.append(np.take_along_axis(size, best, 1))
        return np.concatenate(ids, axis=1), np.concatenate(places, axis=1).astype(np.float32)


def collisions(ids: np.ndarray, places: np.ndarray, window: float) -> tuple[np.ndarray, np.ndarray]:
    """(number, least direction) of the collisions of pairs: each row holds the directions of one vector and then of the other."""
    order = np.argsort(ids, axis=1, kind="stable")
    ids, places = np.take_along_axis(ids, order, 1), np.take_along_axis(places, order, 1)
    hit = (ids[:, 1:] == ids[:, :-1]) & (np.abs(places[:, 1:] - places[:, :-1]) <= window)
    return hit.sum(axis=1), ids[np.arange(len(ids)), hit.argmax(axis=1)]


_plans: dict[tuple, Plan] = {}


def plan(size: int, p: Projections) -> Plan:
    """Directions of vectors of `size` components, with the calibrated count; one per worker."""
    if (size, p) in _plans:
        return _plans[size, p]
    rng = np.random.default_rng([p.seed, size])
    width = min(size, p.basis)
    terms, top = min(p.terms, width), min(p.top, width)
    sums = np.array(list(itertools.combinations(range(top), terms)))
    window = p.sigmas * math.sqrt((2 - 2 * p.cosine) / size)
    made = Plan([], sums, min(p.own, len(sums)), window)
    x, u = rng.standard_normal((2, p.trials, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    norm = np.linalg.norm(u, axis=1, keepdims=True)
    y = x if size == 1 else p.cosine * x + math.sqrt(1 - p.cosine**2) * u / norm
    groups, least = p.groups, 0
    while True:
        made.bases += [np.linalg.qr(rng.standard_normal((size, width)))[0].T for _ in range(groups - len(made.bases))]
        a, b = made.members(x, size), made.members(y, size)
        n, _ = collisions(np.concatenate([a[0], b[0]], axis=1), np.concatenate([a[1], b[1]], axis=1), window)
        least = int(n.min())
        if least >= 4 or groups >= p.most_groups:
            break
        groups = min(groups + p.groups // 2, p.most_groups)
    made.count = max(1, least // 2)
    _plans[size, p] = made
    return made


def _vectors(table: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, v), valid vectors as bytes of their components, and the number format of these."""
    kind = table.schema["embedding"].dataType.elementType.typeName()
    code = "<f4" if kind == "float" else "<f8"

    def run(b):
        ids, out = [], []
        lists = b.column("embedding")
        for k, x in enumerate(lists):
            if x.is_valid and len(x.values) and not x.values.null_count:
                v = np.asarray(x.values, dtype=code)
                if np.isfinite(v).all() and v.any():
                    ids.append(k)
                    out.append((v + 0).tobytes())  # no negative zeros
        yield batch(vec_id=b.column("vec_id").take(pa.array(ids, pa.int64())), v=pa.array(out, pa.binary()))

    return map_arrow(table.select("vec_id", "embedding").where("vec_id is not null"), run, "vec_id long, v binary").groupBy("vec_id").agg(F.min("v").alias("v")), code


def _matrix(v: list[bytes], code: str) -> np.ndarray:
    """Rows of equal length, each scaled by a power of two, so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(v), dtype=code).reshape(len(v), -1).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _by_size(v: list[bytes]):
    """(length in bytes, places) of the vectors of each length."""
    length = np.array([len(x) for x in v], dtype=np.int64)
    for size in np.unique(length):
        yield int(size), np.flatnonzero(length == size)


def _hashed(reps: DataFrame, code: str, p: Projections) -> DataFrame:
    """(rep, least, dirs, places, key): each vector's directions and places in them, and the count that it has to reach; key
    holds both in 8 and 4 bytes.
    """
    one = np.dtype(code).itemsize

    def run(b):
        ids, v = np.array(b.column("rep")), b.column("v").to_pylist()
        for size, at in _by_size(v):
            made = plan(size // one, p)
            for lo in range(0, len(at), 1024):
                part = at[lo : lo + 1024]
                x = _matrix([v[k] for k in part], code)
                dirs, places = made.members(x / np.linalg.norm(x, axis=1, keepdims=True), size // one)
                width = pa.array(np.arange(len(part) + 1, dtype=np.int32) * dirs.shape[1])
                yield batch(rep=ids[part], least=np.full(len(part), made.count), key=pa.array([d.tobytes() + f.tobytes() for d, f in zip(dirs, places, strict=True)], pa.binary()), dirs=pa.ListArray.from_arrays(width, pa.array(dirs.view(np.int64).ravel())), places=pa.ListArray.from_arrays(width, pa.array(places.ravel())))

    return map_arrow(reps.select("rep", "v"), run, "rep long, least long, key binary, dirs array<long>, places array<float>")


def _verified(a: np.ndarray, b: np.ndarray, here: np.ndarray, keys: list[bytes], vecs: list[bytes], code: str, p: Projections) -> np.ndarray:
    """Which of the pairs (a, b) in windows of the directions `here` are links and first collide there."""
    good = np.zeros(len(a), dtype=bool)
    for size, at in _by_size([vecs[k] for k in a]):
        at = at[[len(vecs[k]) == size for k in b[at]]]
        made = plan(size // np.dtype(code).itemsize, p)
        n = len(made.bases) * made.own
        for lo in range(0, len(at), 4096):
            part = at[lo : lo + 4096]
            both = np.frombuffer(b"".join(keys[k] for pair in zip(a[part], b[part], strict=True) for k in pair), np.uint8).reshape(len(part), 2, 12 * n)
            ids = np.ascontiguousarray(both[:, :, : 8 * n]).view(np.uint64).reshape(len(part), 2 * n)
            places = np.ascontiguousarray(both[:, :, 8 * n :]).view(np.float32).reshape(len(part), 2 * n)
            count, first = collisions(ids, places, made.window)
            part = part[(count >= made.count) & (first == here[part])]
            if len(part):
                x, y = _matrix([vecs[k] for k in a[part]], code), _matrix([vecs[k] for k in b[part]], code)
                cos = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                good[part[cos >= p.cosine]] = True
    return good


def _forest(a: np.ndarray, b: np.ndarray, rep: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    """(rep, n, root): of the links (a, b), each end with the other's multiplicities and the least rep that it reaches."""
    ids, at = np.unique(rep[np.concatenate([a, b])], return_inverse=True)
    u, w = at[: len(a)], at[len(a) :]
    count = np.bincount(u, many[b], len(ids)) + np.bincount(w, many[a], len(ids))
    root = np.arange(len(ids))
    while True:
        before = root.copy()
        np.minimum.at(root, u, root[w])
        np.minimum.at(root, w, root[u])
        root = root[root]
        if (root == before).all():
            break
    return batch(rep=ids, n=count.astype(np.int64), root=ids[root])


def _links(cells: DataFrame, code: str, p: Projections) -> DataFrame:
    """(rep, n, root) of rows sorted by direction, segments and place: links found and their forest."""
    names = ("dir", "s0", "t0")

    def solve(rows: pa.Table):
        col = lambda name: np.array(rows.column(name))
        group = np.stack([col(c) for c in names])
        last = np.append(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)), group.shape[1] - 1)
        end = (last + 1)[np.searchsorted(last, np.arange(group.shape[1]))]  # one past the last row of a row's cell
        place, seg, rep, many, here = col("place"), col("s"), col("rep"), col("m"), col("dir").view(np.uint64)
        size, which = np.unique(np.array(pc.binary_length(rows.column("v"))), return_inverse=True)
        reach = np.array([plan(int(x) // np.dtype(code).itemsize, p).window for x in size])[which]
        cross = group[1] != group[2]
        keys, vecs = rows.column("key").to_pylist(), rows.column("v").to_pylist()
        i, d, pairs = np.arange(len(rep)), 1, []
        while len(i):
            j = i + d
            live = j < end[i]
            i, j = i[live], j[live]
            near = place[j] - place[i] <= reach[i]
            i, j = i[near], j[near]
            able = ~cross[i] | (seg[i] != seg[j])
            a, b = i[able], j[able]
            if len(a):
                good = _verified(a, b, here[a], keys, vecs, code, p)
                pairs.append(np.stack([a[good], b[good]]))
            d += 1
        if pairs and sum(x.shape[1] for x in pairs):
            yield _forest(*np.concatenate(pairs, axis=1), rep, many)

    def run(batches):
        held = None
        for b in batches:
            now = pa.Table.from_batches([b])
            now = now if held is None else pa.concat_tables([held, now])
            group = np.stack([np.array(now.column(c)) for c in names])
            change = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
            cut = int(change[-1]) if len(change) else 0
            if cut:
                yield from solve(now.slice(0, cut).combine_chunks())
            held = now.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield from solve(held)

    return cells.mapInArrow(released(run), "rep long, n long, root long")


def near_duplicates(table: DataFrame, p: Projections = Projections()) -> DataFrame:
    """table (vec_id, embedding): vec_id, n_links, component_id, kept, one row per vec_id."""
    vectors, code = _vectors(table)
    vectors = stored(vectors, "vectors")
    reps = stored(vectors.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "reps")
    p = sized(reps.count(), p)
    hashed = stored(_hashed(reps, code, p), "hashed")
    rows = hashed.select("rep", "least", F.explode(F.arrays_zip("dirs", "places")).alias("x")).select("rep", "least", F.col("x.dirs").alias("dir"), F.col("x.places").alias("place"))
    sizes = stored(rows.groupBy("dir").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.expr(f"int(ceil(n / {p.segment}))")), "directions")
    met = stored(lookup(rows, sizes, ["dir"]), "met")
    able = met.groupBy("rep", "least").agg(F.count("*").alias("n")).where("n >= least").select("rep")
    full = able.join(hashed.select("rep", "key"), "rep").join(reps, "rep")
    cell = ("dir", "s0", "t0")
    dealt = met.drop("least").join(full, "rep").withColumn("s", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("t", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = dealt.select("dir", F.least("s", "t").alias("s0"), F.greatest("s", "t").alias("t0"), "s", "place", "rep", "m", "key", "v")
    found = stored(_links(dealt.repartition(*cell).sortWithinPartitions(*cell, "place", "rep"), code, p), "links")
    classes = components(found.where("rep <> root").select(F.col("root").alias("a"), F.col("rep").alias("b")))
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    of_rep = reps.join(links, "rep", "left").join(classes.withColumnRenamed("id", "rep"), "rep", "left")
    of_rep = stored(of_rep.select("v", "m", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "of_rep")
    for done in (hashed, sizes, met, found):
        forget(done)
    out = table.select("vec_id").distinct().join(lookup(vectors, of_rep, ["v"], "m").select("vec_id", "n_links", "component_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
