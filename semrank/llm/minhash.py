"""Operator 10: near-duplicate documents by consistent weighted sampling over TF-IDF word shingles.

Method: a document is a bag of 5-word shingles (words as in hashing.FOLDED; a text of 1 to 4 words is one shingle) with
weight tf x idf. Improved consistent weighted sampling draws bands x rows samples, each over the whole bag, `rows` samples
make a band, documents that agree on a band are candidates, and a pair is linked if the weighted Jaccard similarity of the
two whole bags is at least `threshold`. Classes are the connected components of the links.

idf(t) = 1 + log(df/n) / log(rare): 1 in every document, 2 in a share `rare` of them, growing with log(n/df) without a bound.
df is exact for every shingle. Those of more than a share `rare` go to every task: there are at most
mean-shingles-per-document / rare of these, so the table has a bound that doesn't depend on the corpus. A shingle in a share
`rare` of all documents has that share in at least one block, so blocks name the candidates and a second pass counts these.
All others are dealt by hash to tasks that count them, and go back to their documents with their counts: six bytes a shingle
and two for the document's number in its chunk of rows; a chunk's name follows from its rows, so a task run again deals alike.

Skew: texts with equal word sequences, by a cryptographic digest of their words, are one node of the search, whatever their number. A bucket of a band compares its
members with one leader, not with each other; only members that are not in the leader's class afterwards are compared
further. For these, `check_samples` one-byte samples of the whole bags estimate the similarity, and a pair is verified unless the estimate is
`check_sigmas` standard errors below the threshold (a chance of about one in a million for a true link). Only documents with
such a partner get their bags joined, and pairs whose components have been linked meanwhile are passed over. No bucket is
cut: a large one is dealt out in pairs of segments. The members of a leader meet it in parts of `star`, and copies of one text
and members of one bucket stay in place while its row is broadcast (common.lookup).

Defined results: null, empty and wordless texts have no shingle, link with nothing and are kept. Rows that repeat a doc_id
count as one document with the least of their texts; rows without doc_id link with nothing. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semrank.llm.common import batch, components, forget, lookup, map_arrow, released, stored
from semrank.llm.hashing import FOLDED, digests, inside, keys, mix, ngrams, word_slices

_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
#: Shingles, or copies of shingles, that are sampled at a time.
BLOCK = 1 << 15


@dataclass(frozen=True)
class NearDup:
    shingle: int = 5
    threshold: float = 0.8
    bands: int = 16
    rows: int = 4
    rare: float = 0.01
    seed: int = 17
    #: Shingles in a block of the first pass over document frequencies.
    block: int = 1 << 21
    #: Shingles of a chunk of documents that are dealt out together.
    chunk: int = 1 << 19
    #: Bytes of text whose shingles are counted together.
    part_bytes: int = 1 << 22
    #: Candidates for the table of common shingles beyond which their counts come from a shuffle of all shingles.
    max_common: int = 1 << 21
    check_samples: int = 1024
    check_sigmas: float = 4.75
    #: Documents in a segment of a bucket, and members of a leader that meet it in one task.
    segment: int = 512
    star: int = 1024

    @property
    def samples(self) -> int:
        return self.bands * self.rows


def shingles(words: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 48-bit shingle, tf), ordered by row and shingle."""
    at, rows = inside(offs, n)
    grams = ngrams(words, n)
    parts = [(rows.astype(np.uint64) << _U(48)) | (grams[at] >> _U(16))]
    size = np.diff(offs)
    for k in range(1, n):
        if len(few := np.flatnonzero(size == k)):
            parts.append((few.astype(np.uint64) << _U(48)) | (ngrams(words, k, seed=1 + k)[offs[:-1][few]] >> _U(16)))
    joint = np.sort(np.concatenate(parts))
    if not len(joint):
        return np.zeros(0, dtype=np.int64), joint, np.zeros(0)
    new = np.flatnonzero(np.concatenate(([True], joint[1:] != joint[:-1])))
    tf = np.diff(np.append(new, len(joint))).astype(np.float64)
    joint = joint[new]
    return (joint >> _U(48)).astype(np.int64), joint & _U((1 << 48) - 1), tf


def _narrow(grams: np.ndarray) -> np.ndarray:
    """48-bit shingles as rows of six bytes."""
    return np.ascontiguousarray(grams, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def idf(row: np.ndarray, found: np.ndarray, b: pa.RecordBatch, lo: int, hi: int, common, p: NearDup) -> np.ndarray:
    """idf of each shingle of rows lo to hi of b, from the common shingles and the rows' own tables of repeated ones; a shingle
    that is in neither is in this document only.
    """
    common, common_df, n_docs = common.value
    df = np.ones(len(found))
    if len(common) and len(found):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        hit = common[at] == found
        df[hit] = common_df[at[hit]]
    tables = [(i, x.as_py(), y.as_py()) for i, (x, y) in enumerate(zip(b.column("grams").slice(lo, hi - lo), b.column("dfs").slice(lo, hi - lo), strict=True)) if x.is_valid]
    if tables:
        known = np.concatenate([_wide(x) | _U(i << 48) for i, x, _ in tables])
        counts = np.concatenate([np.frombuffer(y, np.uint32) for _, _, y in tables])
        joint = (row.astype(_U) << _U(48)) | found
        at = np.searchsorted(joint, known)
        df[at] = counts
    return 1 + np.log(df / max(n_docs, 1)) / np.log(p.rare)


def _uniform(h: np.ndarray, k: np.uint64) -> np.ndarray:
    return ((mix(h * k) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers of 23 bits from 32-bit hashes."""
    u = (x >> np.uint32(9)).view(np.int32).astype(np.float32)
    u += np.float32(0.5)
    u *= np.float32(2.0**-23)
    return u


def _gamma(h: np.ndarray) -> np.ndarray:
    """Gamma(2, 1) numbers from 64-bit hashes: the two halves of each are independent exponential ones."""
    u = _unit(h.view(np.uint32))
    out = u[0::2] * u[1::2]
    np.log(out, out=out)
    return np.negative(out, out=out)


def samples(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_rows: int, n: int, seed: int) -> np.ndarray:
    """n_rows x n ids of improved consistent weighted sampling, each sample drawn over the row's whole bag; rows without
    shingles are all ones. Rows are in order. Two rows agree on a sample with the weighted Jaccard similarity of their bags.
    """
    k, each = keys(seed, 6), keys(seed + 1000, n)
    best = np.full((n, n_rows), _EMPTY)
    for lo in range(0, len(row), BLOCK):
        part, s = row[lo : lo + BLOCK], shingle[lo : lo + BLOCK]
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        of = part[first]
        log_w = np.log(weight[lo : lo + BLOCK]).astype(np.float32)
        packed = np.arange(len(s), dtype=np.uint64)
        high = packed.view(np.uint32)[1::2]
        for i in range(n):
            h = s * each[i]
            for mult in k[:2]:
                h ^= h >> _U(32)
                h *= mult
            h ^= h >> _U(29)
            r = _gamma(h)
            h *= k[2]
            beta = _unit(h.view(np.uint32)[1::2])
            h ^= h >> _U(32)
            h *= k[3]
            h ^= h >> _U(29)
            c = _gamma(h)
            t = np.floor(log_w / r + beta)
            beta -= t
            beta -= np.float32(1)
            beta *= r
            c *= np.exp(beta, out=beta)
            high[:] = c.view(np.uint32)  # positive: ordered as its bits
            low = np.minimum.reduceat(packed, first)
            at = (low & _U(0xFFFFFFFF)).astype(np.int64)
            ident = mix(s[at] * k[4] + t[at].astype(np.int64).astype(np.uint64) * k[5]) & _U(0xFFFFFFFF)
            best[i, of] = np.minimum(best[i, of], (low & _U(0xFFFFFFFF00000000)) | ident)
    return np.ascontiguousarray(best.T) & _U(0xFFFFFFFF)


def check_samples(row: np.ndarray, shingle: np.ndarray, tf: np.ndarray, idf_: np.ndarray, n_rows: int, n: int, seed: int) -> np.ndarray:
    """n_rows x n ids that agree with the weighted Jaccard similarity of the bags, at a cost that doesn't grow with n times
    the bag: each of a shingle's tf copies sends marked points at rate n x idf, and each mark's first point is its sample.
    """
    k = keys(seed, 6)
    total = np.bincount(row, tf * idf_, n_rows)
    ends = np.cumsum(tf.astype(np.int64))
    drawn = np.full(n_rows * n, _EMPTY)
    todo = total > 0
    until = (np.log(n) + 3) / np.where(todo, total, 1)
    while todo.any():
        for lo in range(0, int(ends[-1]), BLOCK):
            copy = np.arange(lo, min(lo + BLOCK, int(ends[-1])))
            of = np.searchsorted(ends, copy, side="right")
            some = todo[row[of]]
            copy, of = copy[some], of[some]
            layer = (copy - (ends[of] - tf[of].astype(np.int64))).astype(np.uint64)
            e, rate, at_row = mix(shingle[of] * k[0] + layer * k[1]), n * idf_[of], row[of]
            last, time, seen, size = until[at_row], np.zeros(len(of)), 0, 1
            while len(e):
                h = mix(e[:, None] + np.arange(seen + 1, seen + size + 1, dtype=np.uint64) * k[2])
                when = time[:, None] + np.cumsum(-np.log(_uniform(h, k[3])), axis=1) / rate[:, None]
                i, j = np.nonzero(when <= last[:, None])
                point = h[i, j]
                spot = at_row[i] * n + (mix(point * k[4]) % _U(n)).astype(np.int64)
                order = when[i, j].astype(np.float32).view(np.uint32).astype(np.uint64)
                np.minimum.at(drawn, spot, (order << _U(32)) | (mix(point * k[5]) & _U(0xFFFFFFFF)))
                time = when[:, -1]
                on = time <= last
                e, rate, at_row, last, time = e[on], rate[on], at_row[on], last[on], time[on]
                seen, size = seen + size, min(seen + size, 512)
        todo = todo & (drawn.reshape(n_rows, n) == _EMPTY).any(axis=1)
        until = until * 2
    return drawn.reshape(n_rows, n) & _U(0xFFFFFFFF)


def band_keys(ids: np.ndarray, p: NearDup) -> np.ndarray:
    """n_rows x bands keys; equal keys of different bands are unrelated."""
    k = keys(p.seed + 1, p.rows)
    out = np.empty((len(ids), p.bands), dtype=np.uint64)
    for b in range(p.bands):
        part = ids[:, b * p.rows : (b + 1) * p.rows]
        out[:, b] = mix((part * k).sum(axis=1, dtype=np.uint64) + keys(p.seed + 2 + b, 1)[0])
    return out


def _doc_frequencies(docs: DataFrame, p: NearDup, keep: str) -> DataFrame:
    """(shingle, df) for the blocks of each task. keep: "frequent" (share of at least `rare` in the block) or "all"."""

    def run(batches):
        held, size, n_docs = [], 0, 0

        def flush():
            grams, df = np.unique(np.concatenate(held), return_counts=True)
            if keep == "frequent":
                good = df >= p.rare * n_docs
                grams, df = grams[good], df[good]
            return batch(shingle=grams.astype(np.int64), df=df.astype(np.int64))

        for b in batches:
            for lo, hi, words, offs in word_slices(b.column(0), FOLDED):
                row, grams, _ = shingles(words, offs, p.shingle)
                held.append(grams)
                size += len(grams)
                n_docs += int((np.diff(offs) > 0).sum())
                if size >= p.block:
                    yield flush()
                    held, size, n_docs = [], 0, 0
        if size:
            yield flush()

    return docs.select("text").mapInArrow(released(run), "shingle long, df long")


def common_shingles(docs: DataFrame, n_docs: int, p: NearDup) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of more than a share `rare` of the documents, sorted, and their df. n_docs: documents with words."""
    spark = docs.sparkSession
    frequent = stored(_doc_frequencies(docs, p, "frequent").select("shingle").distinct(), "frequent")
    n = frequent.count()
    if n > p.max_common:
        counts = _doc_frequencies(docs, p, "all")
    elif n == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0)
    else:
        wanted = spark.sparkContext.broadcast(np.sort(np.array(frequent.toArrow().column(0))).astype(np.uint64))

        def count(b):
            total = np.zeros(len(wanted.value), dtype=np.int64)
            for lo, hi, words, offs in word_slices(b.column(0), FOLDED):
                grams = shingles(words, offs, p.shingle)[1]
                at = np.minimum(np.searchsorted(wanted.value, grams), len(wanted.value) - 1)
                total += np.bincount(at[wanted.value[at] == grams], minlength=len(total))
            some = np.flatnonzero(total)
            yield batch(shingle=wanted.value[some].astype(np.int64), df=total[some])

        counts = map_arrow(docs.select("text"), count, "shingle long, df long")
    found = counts.groupBy("shingle").agg(F.sum("df").alias("df")).where(F.col("df") > p.rare * n_docs).toArrow()
    forget(frequent)
    grams, df = np.array(found.column("shingle")).astype(np.uint64), np.array(found.column("df")).astype(np.float64)
    order = np.argsort(grams)
    return grams[order], df[order]


def _dealt(part: np.ndarray, **columns) -> Iterator[tuple[np.ndarray, dict[str, pa.Array]]]:
    """The parts, in order, and the rows of each column that belong to each of them as bytes."""
    order = np.argsort(part, kind="stable")
    found, first = np.unique(part[order], return_index=True)
    cuts = np.append(first, len(order))
    blobs = {}
    for k, x in columns.items():
        x = x[order]
        blobs[k] = pa.array([x[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
    return found, blobs


def repeated_shingles(docs: DataFrame, common, p: NearDup) -> DataFrame:
    """(k, grams, dfs): of each document, the shingles that others have too and that aren't common, sorted (6 bytes each), and
    the number of documents of each (4). Every shingle is counted.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, size // p.part_bytes + 1)
    null = lambda n: pa.nulls(n, pa.binary())

    def send(batches):
        """A chunk: rows in a row of one batch, of about `chunk` shingles; its documents' names, and its shingles by part."""
        for b in batches:
            k = np.array(b.column("k")).astype(_U)
            start, held, n = 0, [], 0
            for lo, hi, words, offs in word_slices(b.column("text"), FOLDED):
                row, grams, _ = shingles(words, offs, p.shingle)
                known = common.value[0]
                if len(known) and len(grams):
                    keep = known[np.minimum(np.searchsorted(known, grams), len(known) - 1)] != grams
                    row, grams = row[keep], grams[keep]
                held.append((row + (lo - start), grams))
                n += len(grams)
                if n >= p.chunk or hi == len(k) or hi - start > 1 << 15:
                    if n:
                        names = k[start:hi]
                        chunk = np.int64(mix(np.array([mix(names + np.arange(len(names), dtype=_U)).sum(dtype=_U)]))[0].view(np.int64))
                        grams = np.concatenate([g for _, g in held])
                        found, blobs = _dealt((mix(grams) % _U(parts)).astype(np.int32), at=np.concatenate([r for r, _ in held]).astype("<u2"), grams=_narrow(grams))
                        yield batch(part=np.array([chunk % parts], dtype=np.int32), chunk=np.array([chunk]), at=null(1), grams=null(1), dfs=null(1), names=pa.array([names.tobytes()], pa.binary()))
                        yield batch(part=found, chunk=np.full(len(found), chunk), at=blobs["at"], grams=blobs["grams"], dfs=null(len(found)), names=null(len(found)))
                    start, held, n = hi, [], 0

    def count(batches):
        chunks, at, grams = [], [], []
        for b in batches:
            named = np.array(b.column("names").is_valid())
            if named.any():
                yield b.filter(pa.array(named))
            for c, x, g in zip(*(b.filter(pa.array(~named)).column(n).to_pylist() for n in ("chunk", "at", "grams")), strict=True):
                chunks.append((c, len(g) // 6))
                at.append(np.frombuffer(x, "<u2"))
                grams.append(_wide(g))
        if not grams:
            return
        chunk, which = np.unique(np.repeat(*np.array(chunks).T), return_inverse=True)
        at, grams = np.concatenate(at), np.concatenate(grams)
        order = np.argsort(grams)
        ordered = grams[order]
        new = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        n = np.diff(np.append(new, len(ordered)))
        df = np.empty(len(grams), dtype="<u4")
        df[order] = np.repeat(n, n)
        some = np.flatnonzero(df > 1)
        if len(some):
            found, blobs = _dealt(which[some], at=at[some], grams=_narrow(grams[some]), dfs=df[some])
            yield batch(part=(chunk[found] % parts).astype(np.int32), chunk=chunk[found], at=blobs["at"], grams=blobs["grams"], dfs=blobs["dfs"], names=null(len(found)))

    def regroup(batches):
        """All rows of a part, chunk by chunk."""
        held: dict[int, dict] = {}
        for b in batches:
            for c, *values in zip(*(b.column(n).to_pylist() for n in ("chunk", "at", "grams", "dfs", "names")), strict=True):
                one = held.setdefault(c, {"at": [], "grams": [], "dfs": [], "names": b""})
                for name, x in zip(("at", "grams", "dfs"), values, strict=False):
                    if x is not None:
                        one[name].append(x)
                one["names"] = values[3] or one["names"]
        for c in list(held):
            one = held.pop(c)
            at, grams, df = np.frombuffer(b"".join(one["at"]), "<u2"), _wide(b"".join(one["grams"])), np.frombuffer(b"".join(one["dfs"]), "<u4")
            if len(at):
                order = np.argsort((at.astype(_U) << _U(48)) | grams)
                found, blobs = _dealt(at[order], grams=_narrow(grams[order]), dfs=df[order])
                yield batch(k=np.frombuffer(one["names"], np.int64)[found], grams=blobs["grams"], dfs=blobs["dfs"])

    kind = "part int, chunk long, at binary, grams binary, dfs binary, names binary"
    sent = docs.select("k", "text").mapInArrow(released(send), kind).repartition(parts, "part")
    return sent.mapInArrow(released(count), kind).repartition(parts, "part").mapInArrow(released(regroup), "k long, grams binary, dfs binary")


def _weights(b, common, p: NearDup) -> Iterator[tuple]:
    for lo, hi, words, offs in word_slices(b.column("text"), FOLDED):
        row, grams, tf = shingles(words, offs, p.shingle)
        yield lo, hi, words, offs, row, grams, tf, idf(row, grams, b, lo, hi, common, p)


def _signatures(docs: DataFrame, common, p: NearDup) -> DataFrame:
    """(doc_id, f1, f2, bands): digest of the word sequence and the band keys; no row for a text without words."""

    def sign(b):
        for lo, hi, words, offs, row, grams, tf, rarity in _weights(b, common, p):
            full = np.flatnonzero(np.diff(offs))
            bands = band_keys(samples(row, grams, tf * rarity, hi - lo, p.samples, p.seed), p)[full].astype(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * p.bands), pa.array(bands.ravel()))
            of = pa.array(full + lo)
            f1, f2 = digests([FOLDED.normal(b.column("text")[int(i)].as_py()) for i in full + lo])
            yield batch(doc_id=b.column("doc_id").take(of), f1=f1, f2=f2, bands=flat)

    return map_arrow(docs.select("doc_id", "text", "grams", "dfs"), sign, "doc_id long, f1 long, f2 long, bands array<long>")


def _bags(docs: DataFrame, common, p: NearDup) -> DataFrame:
    """(doc_id, bag, sig, keys): the whole weighted bag as sorted shingles (8 bytes each) and weights (4), the check samples
    (a byte each) and the band keys (8).
    """

    def pack(b):
        for lo, hi, words, offs, row, grams, tf, rarity in _weights(b, common, p):
            weight = tf * rarity
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            bags = [grams[x:y].tobytes() + weight[x:y].astype(np.float32).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            sigs = []
            for at in range(0, hi - lo, 128):  # bounds the table of samples
                x, y = cut[at], cut[min(hi - lo, at + 128)]
                ids = check_samples(row[x:y] - at, grams[x:y], tf[x:y], rarity[x:y], min(128, hi - lo - at), p.check_samples, p.seed + 99)
                sigs += [s.tobytes() for s in ids.astype(np.uint8)]
            bands = [x.tobytes() for x in band_keys(samples(row, grams, weight, hi - lo, p.samples, p.seed), p)]
            yield batch(doc_id=b.column("doc_id").slice(lo, hi - lo), bag=pa.array(bags, pa.binary()), sig=pa.array(sigs, pa.binary()), keys=pa.array(bands, pa.binary()))

    return map_arrow(docs.select("doc_id", "text", "grams", "dfs"), pack, "doc_id long, bag binary, sig binary, keys binary")


def weighted_jaccard(one: bytes, two: bytes) -> float:
    """Of two bags of _bags()."""
    n, m = len(one) // 12, len(two) // 12
    a, b = np.frombuffer(one, np.uint64, n), np.frombuffer(two, np.uint64, m)
    v, w = np.frombuffer(one, np.float32, n, 8 * n).astype(np.float64), np.frombuffer(two, np.float32, m, 8 * m).astype(np.float64)
    at = np.minimum(np.searchsorted(b, a), m - 1)
    same = b[at] == a
    shared = np.minimum(v[same], w[at[same]]).sum()
    return float(shared / (v.sum() + w.sum() - shared))


def _verify(pairs: DataFrame, bags: DataFrame, p: NearDup) -> DataFrame:
    """Of the distinct (a, b) of a written table, the rows whose whole bags are similar enough, with the similarity."""
    each = stored(pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("parts", F.expr(f"int(ceil(n / {p.star}))")), "leaders")
    dealt = lookup(pairs, each, ["a"]).select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("s"))
    right = bags.select(F.col("doc_id").alias("b"), F.col("bag").alias("bag_b"))
    left = each.join(bags.select(F.col("doc_id").alias("a"), F.col("bag").alias("bag_a")), "a").select("a", "bag_a", F.explode(F.expr("sequence(0, parts - 1)")).alias("s"))

    def check(x):
        sim = np.array([weighted_jaccard(u.as_py(), v.as_py()) for u, v in zip(x.column("bag_a"), x.column("bag_b"), strict=True)])
        good = np.flatnonzero(sim >= p.threshold)
        yield batch(a=x.column("a").take(pa.array(good)), b=x.column("b").take(pa.array(good)), similarity=sim[good])

    return map_arrow(dealt.join(right, "b").join(left, ["a", "s"]).select("a", "b", "bag_a", "bag_b"), check, "a long, b long, similarity double")


def _cells(members: DataFrame, bags: DataFrame, p: NearDup) -> DataFrame:
    """Members (band, key, doc_id, component) of the buckets that hold several components, with columns of bags, dealt out
    in cells: segment s of a bucket meets each segment t in cell (s, t), s <= t.
    """
    sizes = members.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    sizes = stored(sizes.select("band", "key", "n", F.expr(f"int(ceil(n / {p.segment}))").alias("parts")), "sizes")
    rows = lookup(members, sizes, ["band", "key"])
    rows = rows.withColumn("s", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).withColumn("t", F.explode(F.expr("sequence(0, parts - 1)")))
    rows = rows.select("band", "key", "doc_id", "component", "s", F.least("s", "t").alias("s0"), F.greatest("s", "t").alias("t0"))
    cell = ("band", "key", "s0", "t0")
    rows = rows.join(bags, "doc_id").repartition(*cell).sortWithinPartitions(*cell, "doc_id")
    return rows.select(*cell, "doc_id", "component", "s", *[c for c in bags.columns if c != "doc_id"])


def _each_cell(batches, f):
    """f of the rows of each cell, as lists by column, in one pass over sorted batches."""
    cell, held = None, []
    for x in batches:
        for row in zip(*(c.to_pylist() for c in x.columns), strict=True):
            if row[:4] != cell:
                if len(held) > 1:
                    yield from f(*cell, *zip(*held, strict=True))
                cell, held = row[:4], []
            held.append(row[4:])
    if len(held) > 1:
        yield from f(*cell, *zip(*held, strict=True))


def _open_pairs(band, s0, t0, comp, seg, sig, keys_, p: NearDup) -> Iterator[tuple[int, np.ndarray]]:
    """(i, later j) of a cell that are in different components, may be similar and share no earlier band."""
    comp, seg = np.array(comp), np.array(seg)
    sig = np.frombuffer(b"".join(sig), np.uint8).reshape(len(comp), -1)
    shared = np.frombuffer(b"".join(keys_), np.uint64).reshape(len(comp), -1)[:, : band + 1]
    least = p.threshold - p.check_sigmas * (p.threshold * (1 - p.threshold) / p.check_samples) ** 0.5
    for i in range(len(comp) - 1):
        able = comp[i + 1 :] != comp[i]
        if s0 != t0:
            able &= seg[i + 1 :] != seg[i]
        j = np.flatnonzero(able) + i + 1
        if len(j):
            j = j[(shared[j] == shared[i]).argmax(axis=1) == band]
        if len(j):
            j = j[(sig[j] == sig[i]).mean(axis=1) >= least]
        if len(j):
            yield i, j


def _missed_links(members: DataFrame, bags: DataFrame, p: NearDup) -> DataFrame:
    """(a, b): links between different components of a bucket, enough to join all components that have one."""

    def may(band, key, s0, t0, ids, comp, seg, sig, keys_):
        found = {ids[k] for i, j in _open_pairs(band, s0, t0, comp, seg, sig, keys_, p) for k in (i, *j)}
        if found:
            yield batch(doc_id=pa.array(sorted(found), pa.int64()))

    def verify(band, key, s0, t0, ids, comp, seg, sig, keys_, bag):
        root, out = {c: c for c in comp}, []

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i, js in _open_pairs(band, s0, t0, comp, seg, sig, keys_, p):
            for j in js:
                x, y = find(comp[i]), find(comp[j])
                if x != y and weighted_jaccard(bag[i], bag[j]) >= p.threshold:
                    root[x] = y
                    out.append((ids[i], ids[j]))
        if out:
            yield batch(a=pa.array([x for x, _ in out], pa.int64()), b=pa.array([y for _, y in out], pa.int64()))

    light = _cells(members, bags.select("doc_id", "sig", "keys"), p).mapInArrow(released(lambda x: _each_cell(x, may)), "doc_id long").distinct()
    some = members.join(light, "doc_id", "left_semi")
    return _cells(some, bags.select("doc_id", "sig", "keys", "bag"), p).mapInArrow(released(lambda x: _each_cell(x, verify)), "a long, b long")


def _one_each(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k), one row per doc_id that isn't null; texts move only where a doc_id repeats."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    repeated = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        least = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        docs = stored(docs.join(repeated, "doc_id", "left_anti").unionByName(least), "documents")
    return docs.withColumn("k", F.col("doc_id"))


def near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """One row per document: doc_id, component_id (smallest doc_id of its class), kept (doc_id = component_id)."""
    spark, every = docs.sparkSession, docs.select("doc_id").distinct()
    docs = _one_each(docs)
    n_docs = docs.where(F.col("text").rlike("[0-9A-Za-z]|[^\\x00-\\x7F]")).count()
    common = spark.sparkContext.broadcast((*common_shingles(docs, n_docs, p), n_docs))
    counts = stored(repeated_shingles(docs, common, p), "counts")
    counted = docs.join(counts.hint("shuffle_hash"), "k", "left")
    signed = stored(_signatures(counted, common, p), "signatures")
    copies = stored(signed.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "copies")
    reps = signed.join(copies.select(F.col("rep").alias("doc_id")), "doc_id")
    keys_ = stored(reps.select("doc_id", F.posexplode("bands").alias("band", "key")), "keys")
    shared = keys_.groupBy("band", "key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    buckets = stored(lookup(keys_, stored(shared, "shared"), ["band", "key"]), "buckets")
    forget(keys_)
    # The hint keeps one plan at every size: texts are shuffled, never sorted, and the ids are the hashed side.
    wanted = docs.join(buckets.select("doc_id").distinct().hint("shuffle_hash"), "doc_id")
    bags = stored(_bags(wanted.join(counts.hint("shuffle_hash"), "k", "left"), common, p), "bags")
    forget(counts)
    stars = stored(buckets.where("doc_id > leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct(), "stars")
    links = stored(_verify(stars, bags, p).select("a", "b"), "links")
    found = stored(components(links), "classes")
    members = stored(buckets.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("band", "key", "doc_id", F.coalesce("component", "doc_id").alias("component")), "members")
    more = stored(_missed_links(members, bags, p), "links")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    of_rep = lookup(signed.select("doc_id", "f1", "f2"), copies, ["f1", "f2"]).select("doc_id", "rep")
    of_doc = of_rep.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    for done in (bags, buckets, stars, members):
        forget(done)
    out = every.join(of_doc, "doc_id", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
