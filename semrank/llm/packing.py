"""Operator 6: vector bin packing of training examples into sequences, by the dot-product heuristic.

A sequence has three limits: tokens, segments (pieces) and loss-bearing tokens. One sequence is open at a time; of the pieces
that fit into what is left of all three, the one whose demand has the largest weighted dot product with what is left goes
next. Two forms:

* pack_examples(): instruction examples (tokens, loss tokens) stay whole.
* pack_documents(): documents may be cut, all their ids bear loss. Full-length heads of long documents are sequences of
  their own and only their tails are packed. When nothing fits, the longest piece left is cut to fill the sequence exactly;
  a sequence that can't be filled is cut into sequences whose lengths are powers of two, so no padding is needed.

Packing runs in shards of about `shard` pieces that are dealt out by a hash of the piece and its row, so a shard is bounded by
shard x max_tokens ids however long a document is and however often a row repeats. Four shards make a partition, so tasks
don't grow with the input. Ids travel as 2-byte integers where the vocabulary allows it.

Defined results: null text counts as empty (its document is the end id alone). Rows that repeat a doc_id are packed like
other rows. An example beyond a limit by itself gets a sequence of its own with `oversize` true. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semrank.llm.common import batch, released
from semrank.llm.tokens import at_spaces, encoder, groups


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 128
    loss: int = 4096


def fill(tokens: np.ndarray, loss: np.ndarray, limits: Limits, cut: bool) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length). cut: items may be cut, and loss counts all of an item's tokens."""
    most = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
    item = np.arange(len(tokens))
    start = np.zeros(len(tokens), dtype=np.int64)
    size = np.stack([tokens, np.ones(len(tokens)), loss]).astype(np.float64)
    weight = (size.mean(axis=1) / most if len(tokens) else most) / most**2
    out = []
    while len(item):
        left, row, live = most.copy(), [], np.ones(len(item), dtype=bool)
        while left[1] >= 1:
            fits = live & (size[0] <= left[0]) & (size[2] <= left[2])
            gap = int(min(left[0], left[2]))
            if cut and gap and (left[1] == 1 or not fits.any()) and live.any():
                k = int(np.argmax(np.where(live, size[0], -1)))
                if size[0, k] > gap:
                    row.append((int(item[k]), int(start[k]), gap))
                    start[k] += gap
                    size[0, k] -= gap
                    size[2, k] -= gap
                    left[[0, 2]] -= gap
                    break
            if not fits.any():
                break
            score = (weight * left) @ size
            k = int(np.argmax(np.where(fits, score, -1)))
            row.append((int(item[k]), int(start[k]), int(size[0, k])))
            left -= size[:, k]
            live[k] = False
        if not row:  # beyond a limit by itself
            k = int(np.argmax(live))
            row.append((int(item[k]), int(start[k]), int(size[0, k])))
            live[k] = False
        item, start, size = item[live], start[live], size[:, live]
        out += powers(row) if cut and left[0] > 0 else [row]
    return out


def powers(row: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The same tokens in sequences whose lengths are powers of two, the longest first."""
    out, left = [], sum(n for _, _, n in row)
    row = row[::-1]
    while left:
        room, now = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            k, at, n = row.pop()
            now.append((k, at, min(n, room)))
            if n > room:
                row.append((k, at + room, n - room))
            room -= min(n, room)
        out.append(now)
    return out


def pack_examples(examples: DataFrame, limits: Limits = Limits(), shard: int = 4096) -> DataFrame:
    """examples (example_id, tokens, loss_tokens) with sequence_id, segment, offset and oversize; examples stay whole."""
    shards = max(1, -(-examples.count() // shard))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("example_id", "ascending")])
        tokens, loss = (np.array(t.column(c).fill_null(0)) for c in ("tokens", "loss_tokens"))
        rows = [(k, s, i, at) for s, row in enumerate(fill(tokens, loss, limits, False)) for i, (k, at) in enumerate(zip([r[0] for r in row], np.cumsum([0] + [r[2] for r in row]).tolist()[:-1], strict=True))]
        first = t.column("shard")[0].as_py() << 32
        got = t.select(["example_id", "tokens", "loss_tokens"]).take(pa.array([r[0] for r in rows]))
        for name, values, kind in (("sequence_id", [first + r[1] for r in rows], pa.int64()), ("segment", [r[2] for r in rows], pa.int32()), ("offset", [r[3] for r in rows], pa.int64())):
            got = got.append_column(name, pa.array(values, kind))
        over = (tokens > limits.tokens) | (loss > limits.loss)
        return got.append_column("oversize", pa.array(over[[r[0] for r in rows]]))

    dealt = examples.select(F.col("example_id").cast("long"), F.col("tokens").cast("long"), F.col("loss_tokens").cast("long")).withColumn("shard", F.pmod(F.xxhash64("example_id"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(pack, "example_id long, tokens long, loss_tokens long, sequence_id long, segment int, offset long, oversize boolean")


def _pieces(docs: DataFrame, path: str, end_id: int, size: int) -> DataFrame:
    """(doc_id, start, length, doc_tokens, crc, ids, row): heads of `size` ids with their crc, the tail with its ids; row tells
    rows of one doc_id apart.
    """

    def run(b):
        texts = b.column("text").to_pylist()
        enc = encoder(path)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for lo, hi in groups(texts):
            parts = [list(at_spaces(t, 1 << 20)) for t in texts[lo:hi]]
            flat = enc.ids([x for p in parts for x in p])
            rows, at = [], 0
            for i, p in zip(range(lo, hi), parts, strict=True):
                ids = np.frombuffer(b"".join([*flat[at : at + len(p)], end]), dtype=enc.dtype)
                at += len(p)
                n = len(ids)
                for s in range(0, n, size):
                    part = ids[s : s + size]
                    whole = len(part) == size
                    rows.append((i, s, len(part), n, zlib.crc32(part.astype("<u4").tobytes()) if whole else None, None if whole else part.tobytes()))
            which, start, length, total, crc, ids = zip(*rows, strict=True)
            yield batch(doc_id=b.column("doc_id").take(pa.array(which)), start=pa.array(start, pa.int64()), length=pa.array(length, pa.int64()), doc_tokens=pa.array(total, pa.int64()), crc=pa.array(crc, pa.int64()), ids=pa.array(ids, pa.binary()), row=pa.array(which, pa.int64()))

    def task(batches):
        for b in batches:
            yield from run(b)
        encoder(path).trim()

    return docs.mapInArrow(released(task), "doc_id long, start long, length long, doc_tokens long, crc long, ids binary, row long")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, limits: Limits = Limits(), shard: int = 4096) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. path: a tokenizer file."""
    size = min(limits.tokens, limits.loss)
    limits = Limits(size, limits.segments, size)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # A text has at most as many ids as bytes, and its end.
    most = docs.agg(F.sum(F.floor((F.octet_length("text") + 1) / size) + 1)).first()[0] or 0
    shards = max(1, -(-most // shard))
    pieces = _pieces(docs, path, end_id, size)

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        start, length = np.array(t.column("start")), np.array(t.column("length"))
        crc, ids = t.column("crc"), t.column("ids")
        tails = np.flatnonzero(length < size)
        rows = [(int(k), int(start[k]), size, crc[k].as_py(), s, 0) for s, k in enumerate(np.flatnonzero(length == size))]
        s = len(rows)
        for row in fill(length[tails], length[tails], limits, True):
            at = 0
            for k, first, n in row:
                k = int(tails[k])
                raw = ids[k].as_py()
                part = np.frombuffer(raw, dtype=np.uint16 if len(raw) == 2 * length[k] else np.uint32)[first : first + n]
                rows.append((k, int(start[k]) + first, n, zlib.crc32(part.astype("<u4").tobytes()), s, at))
                at += n
            s += 1
        k, start, length, crc, s, at = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
        base = t.column("shard")[0].as_py() << 32
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table([t.column("doc_id").take(k), start, length, crc, t.column("doc_tokens").take(k), pa.array(np.array(s) + base), at], names=names)

    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-shards // 4))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(shards))).repartition(parts, "shard")
    return dealt.groupBy("shard").applyInArrow(pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
