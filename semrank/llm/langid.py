"""Operator 3: language identification by string kernels.

Kernel: the blended spectrum of 1- to 3-grams, by presence: k(x, y) = |P(x) & P(y)| / sqrt(|P(x)| |P(y)|), P(x) being the set of
character n-grams of the whole lower-cased text with everything but letters as one space, hashed to `buckets`. Nyström:
`landmarks` learned documents per language give the feature map k(x, L) k(L, L)^(-1/2), over which one ridge regression per
language is fitted (targets +1 and -1); the highest output wins. Scoring is one matrix product of a block's presence matrix
with the landmarks' and one with the coefficients.

Learned from at most about `per_language` documents of each language and `most_rows` in all, chosen by a hash of doc_id and text;
rows that are repeated count once. Only their kernel rows and the landmarks' buckets come to the driver. Every language that
labels a text with letters is learned: where there are very many, each has fewer landmarks and documents, but at least one.

Defined results: `und` with score 0 for null texts and texts without a letter, or if nothing was learned. The score is the
winner's output mapped from -1..1 to 0..1. Rows that repeat a doc_id get the same answer; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semrank.llm.common import batch, map_arrow, released, stored
from semrank.llm.hashing import keys, mix

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """The lower-cased text with each run of other characters than letters (str.isalpha) as one space; stripped."""
    clean = _OTHER.sub(" ", text.lower()).strip(" ") if text else ""
    if clean and not clean.replace(" ", "").isalpha():  # numerics that \w holds and \d doesn't
        clean = " ".join("".join(c if c.isalpha() else " " for c in clean).split())
    return clean


@dataclass(frozen=True)
class LangId:
    orders: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 14
    landmarks: int = 16
    per_language: int = 1000
    most_landmarks: int = 4096
    most_rows: int = 20_000
    ridge: float = 1e-2
    rows: int = 256
    #: Characters of one step over a text.
    block: int = 1 << 20


def _mark(row: np.ndarray, text: str, p: LangId) -> None:
    """Sets the buckets of the text's n-grams."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    top = p.orders[-1]
    for at in range(0, len(chars), p.block):
        part = chars[at : at + p.block + top - 1].astype(np.uint32)
        for n in p.orders:
            if len(part) < n:
                continue
            k = (keys(60 + n, n) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
            h = part[: len(part) - n + 1] * k[0]
            for j in range(1, n):
                h += part[j : len(part) - n + 1 + j] * k[j]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(17)
            row[h % np.uint32(p.buckets)] = 1


def presence(texts: list, p: LangId) -> np.ndarray:
    """A row of 0 and 1 for each text; all 0 for null and for texts without a letter."""
    out = np.zeros((len(texts), p.buckets), dtype=np.float32)
    for i, t in enumerate(texts):
        clean = letters(t)
        if clean:
            _mark(out[i], f" {clean} ", p)
    return out


def kernel(found: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """k(x, l) of presence rows and landmark rows."""
    size = np.sqrt(np.maximum(found.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(marks.sum(axis=1), 1))[None, :]
    return (found @ marks.T) / size


@dataclass
class Model:
    langs: list[str]
    marks: list[np.ndarray]  #: buckets of each landmark
    coef: np.ndarray  #: landmarks x languages
    bias: np.ndarray

    def dense(self, p: LangId) -> np.ndarray:
        out = np.zeros((len(self.marks), p.buckets), dtype=np.float32)
        for row, at in zip(out, self.marks, strict=True):
            row[at] = 1
        return out


def train(docs: DataFrame, p: LangId = LangId()) -> Model:
    """docs (doc_id, text, lang); rows without lang are not used."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    known = known.withColumn("spread", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30))
    counts = stored(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    langs = sorted(r.lang for r in counts.select("lang").collect())  # a row per language, as the model has
    if not langs:
        return Model([], [], np.zeros((0, 0)), np.zeros(0))
    landmarks = max(1, min(p.landmarks, p.most_landmarks // len(langs)))
    per_language = max(1, min(p.per_language, p.most_rows // len(langs)))

    def chosen(n):
        """About n documents of each language: at least one of a language that has no more than n."""
        some = known.join(F.broadcast(counts), "lang").where(F.col("spread") * F.col("n") < 1.1 * n + 8)
        return some.dropDuplicates(["doc_id", "spread", "lang"])  # repeated rows count once

    def mark(b):
        rows = presence(b.column("text").to_pylist(), p)
        yield batch(lang=b.column("lang"), doc_id=b.column("doc_id"), marks=pa.array([np.flatnonzero(r).astype(np.int32) for r in rows], pa.list_(pa.int32())))

    found = map_arrow(chosen(4 * landmarks), mark, "lang string, doc_id long, marks array<int>").toPandas()
    found["key"] = [tuple(m) for m in found.marks]
    found = found[found.marks.map(len) > 0].sort_values(["lang", "doc_id", "key"], na_position="first").drop_duplicates("key")
    # Half of the landmarks are long texts, which share n-grams with everything; the others are as they come.
    found["rank"] = found.marks.map(len)
    parts = []
    for _, g in found.groupby("lang", sort=True):
        long = g.sort_values(["rank", "doc_id"], ascending=False).head(landmarks // 2)
        parts += [long, g.drop(long.index).head(landmarks - len(long))]
    marks = [np.array(m, dtype=np.int64) for part in parts for m in part.marks]
    model = Model(langs, marks, np.zeros((len(marks), len(langs))), np.zeros(len(langs)))
    if not marks:
        return Model([], [], np.zeros((0, 0)), np.zeros(0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(b):
        dense = shared.value.dense(p)
        texts = b.column("text").to_pylist()
        for at in range(0, len(texts), p.rows):
            k = kernel(presence(texts[at : at + p.rows], p), dense)
            yield batch(lang=b.column("lang").slice(at, len(k)), doc_id=b.column("doc_id").slice(at, len(k)), k=pa.array(list(k.astype(np.float64)), pa.list_(pa.float64())))

    data = map_arrow(chosen(per_language), rows, "lang string, doc_id long, k array<double>").toPandas()
    data = data[data.k.map(max) > 0].sort_values(["lang", "doc_id"], na_position="first")
    if not len(data):
        return Model([], [], np.zeros((0, 0)), np.zeros(0))
    k, dense = np.array(data.k.tolist()), model.dense(p).astype(np.float64)
    value, vector = np.linalg.eigh(kernel(dense, dense))
    inverse = np.where(value > 1e-8 * value.max(), 1 / np.sqrt(np.maximum(value, 1e-12)), 0)
    root = vector * inverse @ vector.T
    x = k @ root
    y = np.where(data.lang.to_numpy()[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    weight = 1 / data.groupby("lang").lang.transform("size").to_numpy()  # every language counts alike
    weight = weight / weight.sum()
    mx, my = weight @ x, weight @ y
    xc = (x - mx) * weight[:, None]
    coef = np.linalg.solve(xc.T @ (x - mx) + p.ridge / len(langs) * np.eye(x.shape[1]) * 0.01, xc.T @ (y - my))
    return Model(langs, marks, root @ coef, my - mx @ coef)


def predict(docs: DataFrame, model: Model, p: LangId = LangId()) -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, dense = shared.value, None
        for b in batches:
            texts = b.column("text").to_pylist()
            for at in range(0, len(texts), p.rows):
                part = texts[at : at + p.rows]
                names, scores = ["und"] * len(part), np.zeros(len(part))
                if m.langs:
                    dense = m.dense(p) if dense is None else dense
                    found = presence(part, p)
                    out = kernel(found, dense).astype(np.float64) @ m.coef + m.bias
                    best = out.argmax(axis=1)
                    for i in np.flatnonzero(found.any(axis=1)):
                        names[i] = m.langs[best[i]]
                        scores[i] = min(1.0, max(0.0, (out[i, best[i]] + 1) / 2))
                yield batch(doc_id=b.column("doc_id").slice(at, len(part)), lang_pred=pa.array(names, pa.string()), score=scores)

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, lang_pred string, score double")
