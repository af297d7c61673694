"""Operator 2: toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the 3- to 6-grams of its distinct lower-cased words with their ends marked, hashed to `buckets`; the
value of a feature is the number of distinct words that hold it. The log-count ratio of a feature compares its document
counts in both classes, with `smooth` pseudo-documents dealt out by class share, so rare features are near 0. Features whose
ratio is under `least_ratio` are dropped; a logistic regression with an L2 penalty is fitted over the rest, each value times
its ratio. A word's score is then a constant, so scoring is a sum over distinct words with a bounded cache of words.

Labels: at most `max_labelled` labelled documents, the first by a hash of doc_id, are broadcast as (doc_id, label); their texts
are written once, one row per doc_id (the least text of rows that repeat it), and stay on the executors. The driver gets counts per bucket and the few kept features of these documents, both bounded.

Defined results: null, empty and wordless texts have the score of the intercept alone, which is under 0.5 unless most
labelled documents are toxic; without labels of both classes all scores are the share of toxic labels, or 0. Documents with
several labels count as toxic if one is. Rows that repeat a doc_id are scored alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semrank.llm.common import batch, forget, map_arrow, released, stored
from semrank.llm.hashing import keys, mix


@dataclass(frozen=True)
class Toxicity:
    orders: tuple[int, ...] = (3, 4, 5, 6)
    buckets: int = 1 << 20
    smooth: float = 10.0
    least_ratio: float = 1.0
    least_documents: int = 3
    l2: float = 1e-3
    steps: int = 300
    max_labelled: int = 30_000
    max_cached: int = 300_000


def word_grams(words: list[str], p: Toxicity) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, bucket) of each character n-gram; lone surrogates count as other characters."""
    text = "\x02" + "\x03\x02".join(words) + "\x03"
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    which = np.cumsum(chars == 2) - 1
    found, owner = [], []
    for n in p.orders:
        if len(chars) < n:
            continue
        k = keys(40 + n, n)
        h = chars[: len(chars) - n + 1] * k[0]
        for j in range(1, n):
            h += chars[j : len(chars) - n + 1 + j] * k[j]
        at = np.flatnonzero(which[: len(chars) - n + 1] == which[n - 1 :])
        found.append((mix(h[at]) % np.uint64(p.buckets)).astype(np.int64))
        owner.append(which[at])
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(owner), np.concatenate(found)


def distinct_words(text: str | None) -> list[str]:
    return sorted(set((text or "").lower().replace("\x02", " ").replace("\x03", " ").split()))


def _features(text: str | None, p: Toxicity) -> np.ndarray:
    """Buckets of the text, one for each distinct word that holds them."""
    words = distinct_words(text)
    if not words:
        return np.zeros(0, dtype=np.int64)
    owner, bucket = word_grams(words, p)
    return np.unique(owner * p.buckets + bucket) % p.buckets


@dataclass
class Model:
    weight: np.ndarray  #: per bucket, ratio x coefficient
    bias: float

    def word_scores(self, words: list[str], p: Toxicity) -> np.ndarray:
        owner, bucket = word_grams(words, p)
        _, first = np.unique(owner * p.buckets + bucket, return_index=True)
        return np.bincount(owner[first], self.weight[bucket[first]], minlength=len(words))


def train(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> Model:
    """docs (doc_id, text), labels (doc_id, label 0 or 1)."""
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_labelled)
    joined = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # known: at most max_labelled rows
    rows = stored(joined.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "labelled")

    def count(batches):
        df, n = np.zeros((2, p.buckets), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for b in batches:
            for text, label in zip(b.column("text"), b.column("label").to_pylist(), strict=True):
                df[label, np.unique(_features(text.as_py(), p))] += 1
                n[label] += 1
        some = np.flatnonzero(df.sum(axis=0))
        yield batch(bucket=np.append(some, -1), n0=np.append(df[0, some], n[0]), n1=np.append(df[1, some], n[1]))

    sums = rows.select("text", "label").mapInArrow(released(count), "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    bucket, n0, n1 = (np.array(sums.column(c)) for c in ("bucket", "n0", "n1"))
    size0, size1 = int(n0[bucket < 0].sum()), int(n1[bucket < 0].sum())
    weight = np.zeros(p.buckets)
    if not size0 or not size1:
        forget(rows)
        share = min(max(size1 / max(size0 + size1, 1), 1e-9), 1 - 1e-9)
        return Model(weight, float(np.log(share / (1 - share))))
    share = size1 / (size0 + size1)
    ratio = np.log((n1 + p.smooth * share) / (share * (n0 + n1 + p.smooth))) - np.log((n0 + p.smooth * (1 - share)) / ((1 - share) * (n0 + n1 + p.smooth)))
    good = (bucket >= 0) & (np.abs(ratio) >= p.least_ratio) & (n0 + n1 >= p.least_documents)
    order = np.argsort(bucket[good])
    kept, ratio = bucket[good][order], ratio[good][order]
    chosen = docs.sparkSession.sparkContext.broadcast(kept)

    def select(b):
        out = []
        for text in b.column("text"):
            f = _features(text.as_py(), p)
            at = np.minimum(np.searchsorted(chosen.value, f), len(chosen.value) - 1)
            out.append(at[chosen.value[at] == f].tolist() if len(chosen.value) else [])
        yield batch(doc_id=b.column("doc_id"), label=b.column("label"), at=pa.array(out, pa.list_(pa.int32())))

    # A fixed order of rows makes the sums, and so the model, repeatable.
    data = map_arrow(rows, select, "doc_id long, label int, at array<int>").toArrow().sort_by("doc_id")
    forget(rows)
    y = np.array(data.column("label"), dtype=np.float64)
    lists = data.column("at").combine_chunks()
    sizes = np.array([len(x) for x in lists], dtype=np.int64) if len(y) else np.zeros(0, dtype=np.int64)
    row, col = np.repeat(np.arange(len(y)), sizes), np.array(lists.flatten(), dtype=np.int64)
    value, bias = _logistic(y, row, col, ratio, p)
    weight[kept] = value * ratio
    return Model(weight, bias)


def _logistic(y, row, col, ratio, p: Toxicity) -> tuple[np.ndarray, float]:
    """Coefficients of the scaled features and the intercept, by accelerated gradient steps."""
    n, x = len(y), ratio[col]
    scale = max(1.0, float(np.bincount(row, x * x, minlength=n).max(initial=0)) if n else 1.0)
    v = u = np.zeros(len(ratio))
    bias = c = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    step = 4.0 / (1 + np.mean(np.bincount(row, x * x, minlength=n)) * max(1.0, np.sqrt(scale / 100)))
    for k in range(p.steps):
        z = np.bincount(row, x * u[col], minlength=n) + c
        e = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        grad = np.bincount(col, x * e[row], minlength=len(ratio)) / n + p.l2 * u
        v_new, b_new = u - step * grad, c - step * e.mean()
        momentum = k / (k + 3)
        u, c = v_new + momentum * (v_new - v), b_new + momentum * (b_new - bias)
        v, bias = v_new, b_new
    return v, bias


def _scores(batches, m: Model, p: Toxicity):
    """(batch, scores of its texts) for each batch."""
    cache: dict[str, float] = {}
    for b in batches:
        texts, out, at = b.column("text"), [], 0
        while at < len(texts):
            lists, size = [], 0
            while at < len(texts) and (size < 1 << 20 or not lists) and len(lists) < 4096:
                t = texts[at].as_py() or ""
                lists.append(set(t.lower().replace("\x02", " ").replace("\x03", " ").split()))
                size += len(t)
                at += 1
            if len(cache) > p.max_cached:
                cache.clear()
            new = list(set().union(*lists) - cache.keys())
            for lo in range(0, len(new), 50_000):
                part = new[lo : lo + 50_000]
                cache.update(zip(part, m.word_scores(part, p).tolist(), strict=True))
            # Sorted, so that a score doesn't depend on the order of a set.
            out += [sum(sorted(filter(None, map(cache.__getitem__, words)))) + m.bias for words in lists]
        yield b, 1 / (1 + np.exp(-np.clip(np.array(out, dtype=np.float64), -40, 40)))


def score(docs: DataFrame, model: Model, p: Toxicity = Toxicity()) -> DataFrame:
    """Per row of docs: doc_id, score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b, scores in _scores(batches, shared.value, p):
            yield batch(doc_id=b.column("doc_id"), score=scores)

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, score double")


def keep(docs: DataFrame, model: Model, p: Toxicity = Toxicity(), under: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores under `under`, with all their columns and without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b, scores in _scores(batches, shared.value, p):
            yield b.filter(pa.array(scores < under))

    return docs.mapInArrow(released(run), docs.schema)
