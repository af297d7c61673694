"""Operator 11: a Merkle manifest of a dataset, with inclusion proofs from the preimages of a leaf's ancestors.

A row is a leaf, the digest of its fields. Per language the leaves ascend by doc_id; every `run` consecutive nodes have their
concatenated digests, the parent's preimage, hashed into one node, until one is left, the language's subroot. The subroots,
ordered by language, give the root in the same way.

1. Leaves get their places by ranges (operators.ranks), so a language that holds most rows lies in many tasks.
2. Up: the nodes of `height` levels are made together. A block is a row with up to run^height consecutive nodes. Level by level
   their digests are joined to the preimages of their parents and these hashed; the preimages are stored. The blocks' own digests
   are the nodes of the next pass; n leaves take log(n) / log(run^height) passes, three for 16 million.
3. Down: a block joins the path of its own node in the pass above: the preimages of all ancestors up to the root, each with the
   slot of the path's own child. From one such row all nodes of a block get their paths.
4. A leaf cuts its own 64 characters out of each preimage, what is left are its siblings; to fold, the digest so far is spliced
   into that slot and the result hashed.

Nothing is gathered beyond a block (256 digests) or joined on a node that many leaves share: a leaf meets its ancestors through
its block, one row each.

Defined results: null fields are `-`; an empty text is `0:`. A null doc_id comes first in its language. Rows that repeat a
doc_id are leaves of their own, ordered by their digests; equal rows get the places next to each other, in any order. A null
language is one of its own and comes first. Without rows there is no tree and no row. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semrank.llm.common import stored
from semrank.operators.ranks import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 64


@dataclass(frozen=True)
class Tree:
    #: Nodes that become one, and levels that are made in one pass: a block has run^height nodes.
    run: int = 2
    height: int = 8

    @property
    def block(self) -> int:
        return self.run**self.height


def leaf(fields: dict[str, Column]) -> Column:
    """Digest of a row's fields in the order of FIELDS: `-` for null, else byte count, colon, value."""
    text = [fields[c].cast("string") for c in FIELDS]
    return F.sha2(F.concat(*[F.when(x.isNull(), "-").otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)) for x in text]), 256)


def leaves(docs: DataFrame, changed_chars: Column | None = None) -> DataFrame:
    """(doc_id, grp, leaf, tampered, tie): grp is the language as a key that orders null first; tampered is the leaf with
    n_chars replaced by changed_chars where that is not null, else null.
    """
    fields = {c: F.col(c) for c in FIELDS}
    other = F.lit(None).cast("string") if changed_chars is None else F.when(changed_chars.isNotNull(), leaf(fields | {"n_chars": changed_chars}))
    grp = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    return docs.select("doc_id", grp.alias("grp"), leaf(fields).alias("leaf"), other.alias("tampered"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"))


def _blocks(nodes: DataFrame, p: Tree) -> DataFrame:
    """nodes (grp, pos, size, node): size is the number of nodes of the group on this level. (grp, block, size, members, p0 ...
    p<height - 1>, node): the preimages of the parents on each level of the block, none on levels above the group's last node,
    and the block's own digest.
    """
    members = F.array_sort(F.collect_list(F.struct("pos", *[c for c in nodes.columns if c not in ("grp", "pos", "size")])))
    out = nodes.groupBy("grp", F.expr(f"pos div {p.block}").alias("block"), "size").agg(members.alias("members")).withColumn("d0", F.col("members.node"))
    for k in range(p.height):
        more = F.col("size") > p.run**k
        cut = F.expr(f"transform(sequence(0, (size(d{k}) - 1) div {p.run}), i -> array_join(slice(d{k}, i * {p.run} + 1, {p.run}), ''))")
        out = out.withColumn(f"p{k}", F.when(more, cut).otherwise(F.array().cast("array<string>")))
        out = out.withColumn(f"d{k + 1}", F.when(more, F.transform(f"p{k}", lambda x: F.sha2(x, 256))).otherwise(F.col(f"d{k}")))
    return out.select("grp", "block", "size", "members", *[f"p{k}" for k in range(p.height)], F.get(f"d{p.height}", 0).alias("node"))


def _local_path(i: Column, p: Tree) -> Column:
    """Path of a block's member i to the top of the block: array of (preimage, slot)."""

    def step(k: int) -> Column:
        at, parent = F.floor(i / p.run**k), F.floor(i / p.run ** (k + 1)).cast("int")
        return F.when(F.col("size") > p.run**k, F.struct(F.get(f"p{k}", parent).alias("preimage"), (at - parent * p.run).cast("int").alias("slot")))

    return F.array_compact(F.array(*[step(k) for k in range(p.height)]))


def _climb(nodes: DataFrame, p: Tree, name: str) -> list[DataFrame]:
    """Blocks of every pass, the last of which has one block per group."""
    passes = []
    while True:
        blocks = stored(_blocks(nodes, p), f"{name}{len(passes)}")
        passes.append(blocks)
        if (blocks.agg(F.max("size")).first()[0] or 0) <= p.block:
            return passes
        # A group that has ended stays as its one node.
        nodes = blocks.select("grp", F.col("block").alias("pos"), F.expr(f"(size + {p.block - 1}) div {p.block}").alias("size"), "node")


def _with_paths(blocks: DataFrame, above: DataFrame, p: Tree) -> DataFrame:
    """(grp, pos, member, path, subroot, root) of the nodes of a pass; above: (grp, pos, path, subroot, root) of the blocks' own nodes."""
    joined = blocks.join(above.withColumnRenamed("pos", "block").withColumnRenamed("path", "up"), ["grp", "block"])
    paths = F.transform("members", lambda m, i: F.struct(m.alias("member"), F.concat(_local_path(i, p), "up").alias("path")))
    each = joined.select("grp", F.explode(paths).alias("x"), "subroot", "root")
    return each.select("grp", F.col("x.member.pos").alias("pos"), "x.member", "x.path", "subroot", "root")


def _descend(passes: list[DataFrame], above: DataFrame, p: Tree) -> DataFrame:
    """_with_paths() of the lowest pass; above: one row per group."""
    for k in reversed(range(1, len(passes))):
        above = _with_paths(passes[k], above, p).drop("member")
        # Blocks of this pass, one per node: 1 / block of the rows below.
        above = stored(above, f"paths{k}")
    return _with_paths(passes[0], above, p)


def siblings(path: Column) -> Column:
    """What is left of the preimages of a path without its own digests, level by level."""
    return F.array_join(F.transform(path, lambda x: F.overlay(x["preimage"], F.lit(""), x["slot"] * DIGEST + 1, F.lit(DIGEST))), "")


def fold(digest: Column, path: Column) -> Column:
    """The root that follows from a digest at the start of the path."""
    return F.aggregate(path, digest, lambda now, x: F.sha2(F.overlay(x["preimage"], now, x["slot"] * DIGEST + 1, F.lit(DIGEST)), 256))


def _tops(passes: list[DataFrame], p: Tree) -> DataFrame:
    """(grp, node): the last node of each group."""
    return passes[-1].select("grp", "node")


def manifest(docs: DataFrame, changed_chars: Column | None = None, p: Tree = Tree()) -> DataFrame:
    """Per row of docs: doc_id, leaf, subroot, root, proof (the siblings' digests, concatenated), path (array of preimage and slot,
    leaf to root), folded_root and verified. changed_chars: a column of docs, another n_chars for the rows where it is not null,
    whose leaf is then folded instead.
    """
    rows = stored(leaves(docs, changed_chars), "leaves")
    placed = numbered(rows, ["doc_id", "leaf", "tie"], ["grp"], "pos")
    sizes = stored(rows.groupBy("grp").agg(F.count("*").alias("size")), "languages")
    # One row per language; where they are few, adaptive execution broadcasts them, else it splits the large ones.
    nodes = placed.join(sizes, "grp").select("grp", "pos", "size", F.col("leaf").alias("node"), "doc_id", "tampered")
    passes = _climb(nodes, p, "blocks")
    tops = stored(_tops(passes, p), "subroots")
    n = tops.count()
    ranked = numbered(tops, ["grp"], name="pos").select(F.lit("").alias("grp"), "pos", F.lit(n).cast("long").alias("size"), "node", F.col("grp").alias("of"))
    upper = _climb(ranked, p, "tops")
    root = _tops(upper, p).select("grp", F.lit(0).cast("long").alias("pos"), F.expr("cast(array() as array<struct<preimage:string,slot:int>>)").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    above = _descend(upper, root, p).select(F.col("member.of").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", F.col("member.node").alias("subroot"), "root")
    found = _descend(passes, above, p)
    folded = fold(F.coalesce("member.tampered", "member.node"), F.col("path"))
    return found.select(
        F.col("member.doc_id").alias("doc_id"), F.col("member.node").alias("leaf"), "subroot", "root", siblings(F.col("path")).alias("proof"), "path", folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def verify(digest: Column, path: Column, root: Column) -> Column:
    """Whether a leaf's digest belongs to the root by its path."""
    return fold(digest, path) == root
