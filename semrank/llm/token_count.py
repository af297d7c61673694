"""Operator 5: exact token counts of whole texts, huge ones by overlap resynchronisation.

Texts of up to `chunk` characters are encoded whole. Longer ones are cut into overlapping chunks, which Spark deals out; each
chunk is encoded alone with offsets. Two neighbouring chunks are spliced at a position where both have a pre-token boundary
with the same token behind it. Such a boundary is stable: the split into pre-tokens reads forward and looks one character
ahead, so from a common boundary on both agree, and a boundary of the left chunk that lies `margin` characters before its end
(more than any added token and the look-ahead) is one of the whole text. The count is the sum of the parts between splices.
Documents of which some pair of chunks doesn't align are cut again with chunks and overlaps twice as long, until all align
or the text is one chunk.

Equal huge texts are counted once. Defined results: null counts as empty, 0 tokens; special strings inside texts are the
library's special tokens; nothing is truncated. One row comes out for each row, other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semrank.llm.common import batch, map_arrow, stored
from semrank.llm.tokens import encoder, groups


@dataclass(frozen=True)
class Counting:
    path: str
    chunk: int = 1 << 16
    overlap: int = 1 << 10
    margin: int = 64


def _short(docs: DataFrame, p: Counting) -> DataFrame:
    def run(b):
        texts = b.column("text").to_pylist()
        enc = encoder(p.path)
        width = np.dtype(enc.dtype).itemsize
        for lo, hi in groups(texts):
            counts = [len(x) // width for x in enc.ids(texts[lo:hi])]
            yield batch(doc_id=b.column("doc_id").slice(lo, hi - lo), n_bytes=b.column("n_bytes").slice(lo, hi - lo), n_tokens=pa.array(counts, pa.int64()))

    return map_arrow(docs, run, "doc_id long, n_bytes long, n_tokens long")


def _chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, no, start, last, part) of texts (key, text)."""

    def cut(b):
        for key, text in zip(b.column("key").to_pylist(), b.column("text"), strict=True):
            text, at, no = text.as_py(), 0, 0
            while True:
                last = at + chunk >= len(text)
                yield batch(key=pa.array([key]), no=pa.array([no], pa.int32()), start=pa.array([at], pa.int64()), last=pa.array([last]), part=pa.array([text[at : at + chunk]]))
                if last:
                    break
                at, no = at + chunk - overlap, no + 1

    return map_arrow(texts, cut, "key string, no int, start long, last boolean, part string")


def _boundaries(chunks: DataFrame, overlap: int, p: Counting) -> DataFrame:
    """(key, no, last, total, left, right): pre-token boundaries (pos, tok, before) in the overlap with each neighbour."""
    zone = "array<struct<pos:long,tok:int,before:long>>"

    def run(b):
        library = encoder(p.path).library
        for key, no, start, last, part in zip(*(b.column(c).to_pylist() for c in ("key", "no", "start", "last", "part")), strict=True):
            e = library.encode(part, add_special_tokens=False)
            word = np.array([-1 if w is None else w for w in e.word_ids], dtype=np.int64)
            fresh = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (word[1:] < 0)))) if len(word) else np.zeros(0, dtype=np.int64)
            offsets, ids = e.offsets, e.ids  # each access copies the whole list
            rows = [(start + offsets[k][0], ids[k], int(k)) for k in fresh]
            left = [r for r in rows if no and start < r[0] < start + overlap]
            right = [] if last else [r for r in rows if start + len(part) - overlap < r[0] <= start + len(part) - p.margin]
            name = ("pos", "tok", "before")
            yield pa.RecordBatch.from_pylist([{"key": key, "no": no, "last": last, "total": len(e.ids), "left": [dict(zip(name, r, strict=True)) for r in left], "right": [dict(zip(name, r, strict=True)) for r in right]}], schema=wire)

    pairs = pa.list_(pa.struct([("pos", pa.int64()), ("tok", pa.int32()), ("before", pa.int64())]))
    wire = pa.schema([("key", pa.string()), ("no", pa.int32()), ("last", pa.bool_()), ("total", pa.int64()), ("left", pairs), ("right", pairs)])
    return map_arrow(chunks, run, f"key string, no int, last boolean, total long, left {zone}, right {zone}")


def _spliced(texts: DataFrame, p: Counting) -> DataFrame:
    """(key, n_tokens) of distinct huge texts (key, text)."""
    done, chunk, overlap = None, p.chunk, p.overlap
    while True:
        dealt = _chunks(texts, chunk, overlap).repartition("key", "no")
        ends = stored(_boundaries(dealt, overlap, p), "chunks")
        right = ends.select("key", "no", F.explode("right").alias("r")).select("key", "no", "r.pos", "r.tok", F.col("r.before").alias("upto"))
        left = ends.select("key", (F.col("no") - 1).alias("no"), F.explode("left").alias("l")).select("key", "no", "l.pos", "l.tok", F.col("l.before").alias("skip"))
        splice = right.join(left, ["key", "no", "pos", "tok"]).groupBy("key", "no").agg(F.min(F.struct("pos", "upto", "skip")).alias("s"))
        parts = (
            ends.select("key", "no", "last", "total")
            .join(splice.select("key", "no", "s.upto"), ["key", "no"], "left")
            .join(splice.select("key", (F.col("no") + 1).alias("no"), "s.skip"), ["key", "no"], "left")
        )
        upto = F.when(F.col("last"), F.col("total")).otherwise(F.col("upto"))
        skip = F.when(F.col("no") == 0, F.lit(0)).otherwise(F.col("skip"))
        counted = parts.groupBy("key").agg(F.sum(upto - skip).alias("n_tokens"), F.bool_and(upto.isNotNull() & skip.isNotNull()).alias("whole"))
        counted = stored(counted, "counted")
        good = counted.where("whole").select("key", "n_tokens")
        done = good if done is None else done.unionByName(good)
        rest = counted.where("not whole").select("key")
        if rest.isEmpty():
            return done
        texts, chunk, overlap = texts.join(rest, "key"), 2 * chunk, 2 * overlap


def token_counts(docs: DataFrame, p: Counting) -> DataFrame:
    """Per row of docs: doc_id, n_bytes (UTF-8), n_tokens."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = _short(docs.where(F.length("text") <= p.chunk), p)
    huge = docs.where(F.length("text") > p.chunk).withColumn("key", F.sha2("text", 256))
    counts = _spliced(huge.select("key", "text").dropDuplicates(["key"]), p)
    return short.unionByName(huge.select("doc_id", "n_bytes", "key").join(counts, "key").select("doc_id", "n_bytes", "n_tokens"))
