"""Operator 9: passages that repeat across documents, by compaction of a De Bruijn graph of word k-mers.

Words are `[^\\x20\\x09-\\x0D]+` of the text, unchanged; an edge of the graph is a window of `window` consecutive words. A
window repeats if its word sequence also starts in a document with a smaller doc_id; all words of such a window go.

1. Texts whose whole word sequence an earlier document has are found by a cryptographic digest and take no part below.
2. Anchors: of the 5-word grams of a window, the one with the least hash. Equal windows have equal anchors, and about one
   gram in five is one, so grouping the anchors is a cheap and exact way to leave out nearly all windows that don't repeat.
3. Edges: windows whose anchor occurs in two documents, as 96-bit hashes with their coordinates (doc_id, position). Windows
   in a row that share an anchor travel as one row, dealt out by anchor. The smallest coordinate of an edge is its source.
4. Compaction: consecutive positions of a document whose sources are consecutive too form a nonbranching path, kept as one
   span (doc_id, start, length, source_doc, source_start).
5. Verification: the words of every span are compared with those at its source coordinates, by their digests. Equal windows
   have equal hashes under every seed, so a span that differs is all that a collision can do; then all starts again with
   another seed of the hashes.

Skew: anchors are aggregated with map-side combine before the shuffle, and a join gives each occurrence one row. Anchors of
at most `hot` documents meet in one task, so what is held at once is bounded; the edges of the others are aggregated to their
sources with map-side combine and joined back, one by one. Spans are gathered per document, never per passage; the spans of one
source that very many documents share stay in place while its digest is broadcast (common.lookup). The joins on the texts reuse
one shuffle by doc_id.

Defined results: null and empty texts have no words. Texts of fewer than `window` words keep all. Rows that repeat a doc_id,
with one text or with several, don't make each other's words repeated; each is held against the smaller doc_ids and gets its own
result. Rows with a null doc_id keep all words.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semrank.llm.common import batch, forget, lookup, map_arrow, released, repeated_ids, stored, text_key
from semrank.llm.hashing import SPACED, digest, digests, inside, ngrams, word_slices


@dataclass(frozen=True)
class Repeats:
    window: int = 13
    anchor: int = 5
    #: Documents of an anchor that may meet in one task.
    hot: int = 20_000
    #: Seeds of the hashes that are tried, should words differ from those at their sources.
    seeds: int = 4


def _window_anchors(words: np.ndarray, p: Repeats) -> np.ndarray:
    """Least gram hash of the window at each position (also across texts: see hashing.inside)."""
    grams = ngrams(words, p.anchor, seed=2)
    least, have, need = grams, 1, p.window - p.anchor + 1
    while have < need:
        step = min(have, need - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least


def _identified(docs: DataFrame) -> DataFrame:
    """(doc_id, k, text): the distinct texts of each doc_id that isn't null, told apart by k, which is 0 for a doc_id's only row.
    Texts move only where a doc_id repeats.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    repeated = repeated_ids(docs)
    if repeated.isEmpty():
        return docs.select("doc_id", F.lit(0).cast("long").alias("k"), "text")
    some = docs.join(repeated, "doc_id", "left_semi").select("doc_id", text_key().alias("k"), F.coalesce("text", F.lit("")).alias("text")).groupBy("doc_id", "k").agg(F.min("text").alias("text"))
    return docs.join(repeated, "doc_id", "left_anti").select("doc_id", F.lit(0).cast("long").alias("k"), "text").unionByName(stored(some, "documents"))


def _copies(docs: DataFrame, p: Repeats) -> DataFrame:
    """(doc_id, k) of the texts whose whole word sequence a smaller doc_id has."""

    def sign(b):
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            words = [SPACED.normal(t) for t in part.column("text").to_pylist()]
            full = [i for i, w in enumerate(words) if w.count(b" ") >= p.window - 1]
            if full:
                of, (f1, f2) = pa.array(full), digests([words[i] for i in full])
                yield batch(doc_id=part.column("doc_id").take(of), k=part.column("k").take(of), f1=f1, f2=f2)

    signed = stored(map_arrow(docs, sign, "doc_id long, k long, f1 long, f2 long"), "fingerprints")
    first = signed.groupBy("f1", "f2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last")
    out = stored(lookup(signed, stored(first.select("f1", "f2", "first", "n"), "firsts"), ["f1", "f2"]).where("doc_id > first").select("doc_id", "k"), "copies")
    forget(signed)
    return out


def _anchors(docs: DataFrame, p: Repeats, seed: int) -> DataFrame:
    """(anchor, doc_id, k), each once per row of docs."""

    def run(b):
        for lo, hi, words, offs in word_slices(b.column("text"), SPACED, seed):
            at, row = inside(offs, p.window)
            if not len(at):
                continue
            value = _window_anchors(words, p)[at]
            new = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1]))))
            value, row = value[new], row[new]
            order = np.lexsort((value, row))
            value, row = value[order], row[order]
            new = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1]))))
            of = pa.array(row[new] + lo)
            yield batch(anchor=value[new].astype(np.int64), doc_id=b.column("doc_id").take(of), k=b.column("k").take(of))

    return map_arrow(docs, run, "anchor long, doc_id long, k long")


def _edges(texts: DataFrame, p: Repeats, seed: int) -> DataFrame:
    """Windows of texts (doc_id, k, text, anchors) whose anchor is one of the row's: (anchor, doc_id, k, pos, hs, gs), the hashes
    of windows in a row with one anchor.
    """

    def run(b):
        lists = b.column("anchors")
        for lo, hi, words, offs in word_slices(b.column("text"), SPACED, seed):
            at, row = inside(offs, p.window)
            if not len(at):
                continue
            wanted = np.unique(np.array(lists.slice(lo, hi - lo).flatten()).astype(np.uint64))
            value = _window_anchors(words, p)[at]
            good = wanted[np.minimum(np.searchsorted(wanted, value), len(wanted) - 1)] == value
            at, row, value = at[good], row[good], value[good]
            if not len(at):
                continue
            new = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]))))
            h, g = ngrams(words, p.window, seed=3)[at], ngrams(words, p.window, seed=4)[at]
            cuts = pa.array(np.append(new, len(at)).astype(np.int32))
            hs = pa.ListArray.from_arrays(cuts, pa.array(h.view(np.int64)))
            gs = pa.ListArray.from_arrays(cuts, pa.array((g >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            of = pa.array(row[new] + lo)
            yield batch(anchor=value[new].view(np.int64), doc_id=b.column("doc_id").take(of), k=b.column("k").take(of), pos=(at - offs[:-1][row])[new].astype(np.int32), hs=hs, gs=gs)

    return map_arrow(texts, run, "anchor long, doc_id long, k long, pos int, hs array<long>, gs array<int>")


#: A run of covered windows and the coordinates of its source.
RUN = "doc_id long, k long, pos int, n int, source_doc long, source_k long, source_pos int"


def _paths(doc, k, pos, source_doc, source_k, source_pos) -> pa.RecordBatch:
    """Covered windows as runs with consecutive sources."""
    order = np.lexsort((pos, k, doc))
    doc, k, pos, source_doc, source_k, source_pos = (x[order] for x in (doc, k, pos, source_doc, source_k, source_pos))
    new = np.zeros(len(doc), dtype=bool)
    new[0] = True
    for x, step in ((doc, 0), (k, 0), (pos, 1), (source_doc, 0), (source_k, 0), (source_pos, 1)):
        new[1:] |= x[1:] != x[:-1] + step
    new = np.flatnonzero(new)
    n = np.diff(np.append(new, len(doc))).astype(np.int32)
    return batch(doc_id=doc[new], k=k[new], pos=pos[new].astype(np.int32), n=n, source_doc=source_doc[new], source_k=source_k[new], source_pos=source_pos[new].astype(np.int32))


def _meet(edges: DataFrame) -> DataFrame:
    """Runs of repeated windows (RUN) of edges whose equal windows fit in one task."""

    def solve(t: pa.Table):
        hs, gs = t.column("hs").combine_chunks(), t.column("gs").combine_chunks()
        sizes = np.diff(np.array(hs.offsets))
        row = np.repeat(np.arange(len(sizes)), sizes)
        step = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
        doc, k, pos = np.array(t.column("doc_id"))[row], np.array(t.column("k"))[row], np.array(t.column("pos"))[row] + step
        h, g = np.array(hs.flatten()), np.array(gs.flatten())
        order = np.lexsort((pos, k, doc, g, h))
        h, g, doc, k, pos = h[order], g[order], doc[order], k[order], pos[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        later = np.flatnonzero(doc > doc[first])
        if len(later):
            at = first[later]
            yield _paths(doc[later], k[later], pos[later], doc[at], k[at], pos[at])

    def run(batches):
        held = []
        for b in batches:
            anchors = np.array(b.column("anchor"))
            change = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
            if held and anchors[0] != held[-1].column("anchor")[-1].as_py():
                change = np.append(0, change)
            if len(change):
                cut = int(change[-1])
                done = [*held, b.slice(0, cut)]
                yield from solve(pa.Table.from_batches(done).combine_chunks())
                held = [b.slice(cut)]
            else:
                held.append(b)
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    return edges.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(released(run), RUN)


def _join(edges: DataFrame) -> DataFrame:
    """The same for edges with any number of equal windows."""
    each = edges.select("doc_id", "k", "pos", F.posexplode(F.arrays_zip("hs", "gs")).alias("i", "x")).select("doc_id", "k", (F.col("pos") + F.col("i")).alias("pos"), "x.hs", "x.gs")
    each = stored(each, "hot_edges")
    source = each.groupBy("hs", "gs").agg(F.min(F.struct("doc_id", "k", "pos")).alias("source"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("source.doc_id < last")
    found = lookup(each, stored(source.select("hs", "gs", "source", "n"), "sources"), ["hs", "gs"]).where("doc_id > source.doc_id")
    return found.select("doc_id", "k", "pos", F.lit(1).alias("n"), F.col("source.doc_id").alias("source_doc"), F.col("source.k").alias("source_k"), F.col("source.pos").alias("source_pos"))


def _repeats(docs: DataFrame, copies: DataFrame, p: Repeats, seed: int) -> DataFrame:
    """Runs (RUN) of windows that a smaller doc_id has too, by their hashes; whole-text copies are left out."""
    by = ["doc_id", "k"]
    anchors = _anchors(docs.join(copies.hint("shuffle_hash"), by, "left_anti"), p, seed)
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last")
    marked = anchors.join(shared.select("anchor", (F.col("n") > p.hot).alias("hot")).hint("shuffle_hash"), "anchor")
    wanted = stored(marked.groupBy(*by).agg(F.collect_set(F.when(~F.col("hot"), F.col("anchor"))).alias("anchors"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot")), "wanted")

    def texts(name):
        return docs.join(wanted.where(F.size(name) > 0).select(*by, F.col(name).alias("anchors")).hint("shuffle_hash"), by)

    return _meet(_edges(texts("anchors"), p, seed)).unionByName(_join(_edges(texts("hot"), p, seed)))


def _spans(found: DataFrame, p: Repeats) -> DataFrame:
    """Runs compacted to whole paths: (doc_id, k, start, length in words, source_doc, source_k, source_start)."""
    by = Window.partitionBy("doc_id", "k").orderBy("pos")
    last = lambda c: F.lag(c).over(by)
    more = (F.col("pos") == last("pos") + last("n")) & (F.col("source_doc") == last("source_doc")) & (F.col("source_k") == last("source_k")) & (F.col("source_pos") == last("source_pos") + last("n"))
    path = F.sum(F.when(more, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = found.withColumn("path", path).groupBy("doc_id", "k", "path")
    return rows.agg(F.min("pos").alias("start"), (F.sum("n") + p.window - 1).cast("int").alias("length"), F.first("source_doc").alias("source_doc"), F.first("source_k").alias("source_k"), F.min("source_pos").alias("source_start")).drop("path")


SPAN = ["doc_id", "k", "start", "length", "source_doc", "source_k", "source_start"]


def _with_source_words(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """spans with the digest of the words at their source."""
    at = ["source_doc", "source_k", "source_start", "length"]
    sources = spans.groupBy(*at).agg(F.count("*").alias("n"))
    by_doc = sources.groupBy(F.col("source_doc").alias("doc_id"), F.col("source_k").alias("k")).agg(F.collect_list(F.struct(F.col("source_start").alias("start"), "length", "n")).alias("wanted"))

    def read(b):
        for doc_id, k, text, wanted in zip(b.column("doc_id"), b.column("k"), b.column("text"), b.column("wanted"), strict=True):
            words, wanted = SPACED.normal(text.as_py()).split(b" "), wanted.values
            start, length = np.array(wanted.field("start")), np.array(wanted.field("length"))
            words_of = [digest(b" ".join(words[i : i + m])) for i, m in zip(start, length, strict=True)]
            same = lambda x, m=len(start): pa.array([x.as_py()] * m, pa.int64())
            yield batch(source_doc=same(doc_id), source_k=same(k), source_start=wanted.field("start"), length=wanted.field("length"), n=wanted.field("n"), words=pa.array(words_of, pa.binary()))

    known = map_arrow(docs.join(by_doc.hint("shuffle_hash"), ["doc_id", "k"]), read, "source_doc long, source_k long, source_start int, length int, n long, words binary")
    return lookup(spans, stored(known, "source_words"), at)


def repeats(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """(doc_id, k, start, length, source_doc, source_k, source_start, words): spans of `length` words from `start` on that a smaller
    doc_id has too, with the digest of the words at the source, not yet compared; whole-text copies of an earlier document are
    left out. k tells different texts of one doc_id apart.
    """
    docs = _identified(docs)
    return _found(docs, _copies(docs, p), p, 0)


def _found(docs: DataFrame, copies: DataFrame, p: Repeats, seed: int) -> DataFrame:
    spans = stored(_spans(_repeats(docs, copies, p, seed), p).select(*SPAN), "spans")
    return _with_source_words(spans, docs)


def deduplicate(docs: DataFrame, p: Repeats = Repeats(), texts: bool = True) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space; null unless texts)."""
    every = docs.select("doc_id", "text")
    docs = _identified(every)
    copies = _copies(docs, p)
    for seed in range(p.seeds):
        out = stored(_cut(every, docs, copies, _found(docs, copies, p, seed), texts), "kept")
        if out.where("not verified").isEmpty():
            return out.drop("verified")
        forget(out)
    raise RuntimeError(f"spans differ from their sources under each of {p.seeds} seeds")


def _cut(every: DataFrame, docs: DataFrame, copies: DataFrame, found: DataFrame, texts: bool) -> DataFrame:
    """Rows of deduplicate() and `verified`: whether the words of all of the row's spans are those at their sources."""
    by = ["doc_id", "k"]
    marks = found.groupBy(*by).agg(F.collect_list(F.struct("start", "length", "words")).alias("spans")).withColumn("copy", F.lit(False))
    marks = marks.unionByName(copies.select(*by, F.lit(None).cast(marks.schema["spans"].dataType).alias("spans"), F.lit(True).alias("copy")))
    none = every.where("doc_id is null").select("doc_id", "text", F.lit(None).cast(marks.schema["spans"].dataType).alias("spans"), F.lit(None).cast("boolean").alias("copy"))
    done = docs.join(marks.hint("shuffle_hash"), by, "left")
    repeated = docs.where("k <> 0")
    # A text of a repeated doc_id has as many results as rows.
    if not repeated.isEmpty():
        times = every.join(repeated.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id", text_key().alias("k")).agg(F.count("*").cast("int").alias("times"))
        done = done.join(times, by, "left").withColumn("time", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)))))
    rows = done.select(*none.columns).unionByName(none)

    def cut(b):
        out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": [], "verified": []}
        size, first = 0, 0
        for i, (text, spans, copy) in enumerate(zip(b.column("text"), b.column("spans"), b.column("copy"), strict=True)):
            words = (text.as_py() or "").encode().split()
            n, verified = len(words), True
            if copy.as_py():
                words = []
            elif spans.is_valid and len(spans):
                gone = np.zeros(n + 1, dtype=np.int64)
                at, length = (np.array(spans.values.field(c)) for c in ("start", "length"))
                verified = all(digest(b" ".join(words[x : x + m])) == source.as_py() for x, m, source in zip(at, length, spans.values.field("words"), strict=True))
                np.add.at(gone, at, 1)
                np.add.at(gone, at + length, -1)
                words = [words[j] for j in np.flatnonzero(np.cumsum(gone[:n]) == 0)]
            kept = b" ".join(words)
            out["n_words"].append(n)
            out["n_removed"].append(n - len(words))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept_text"].append(kept.decode() if texts else None)
            out["verified"].append(verified)
            size += len(kept)
            if size > 1 << 22 or i == b.num_rows - 1:
                yield batch(doc_id=b.column("doc_id").slice(first, i + 1 - first), n_words=pa.array(out["n_words"], pa.int64()), n_removed=pa.array(out["n_removed"], pa.int64()), kept_sha256=pa.array(out["kept_sha256"], pa.string()), kept_text=pa.array(out["kept_text"], pa.string()), verified=pa.array(out["verified"], pa.bool_()))
                out, size, first = {c: [] for c in out}, 0, i + 1

    return map_arrow(rows, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, verified boolean")
