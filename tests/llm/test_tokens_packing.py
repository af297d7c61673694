"""Token counts and packing against the library itself."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from semrank.llm import packing, token_count
from semrank.llm.queries import op5_token_counts, op6_packing, tokenizer

SF = "/root/testdata/sf0.001"
ODD = ["", None, "   ", "\n\n", "a", "x" * 5000, "word " * 3000, "ünï cødé 漢字 🙂 ", "<|endoftext|> inside <|startoftext|>", "tab\tand\r\nlines   nbsp", "İstanbul ß ﬁ", "don't we'll 's  'S", "1234567 89", "é combining"]


def library(name):
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(tokenizer(name))


def test_counts_of_all_documents(spark):
    lib = library("byte_bpe_50k.json")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op5_token_counts(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(lib.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 512)


@pytest.mark.parametrize(("chunk", "overlap"), [(60, 20), (500, 100), (1 << 16, 1 << 10)])
def test_spliced_counts_of_odd_texts(spark, chunk, overlap):
    lib = library("byte_bpe_50k.json")
    made = spark.createDataFrame([(i, t, 0) for i, t in enumerate(ODD * 2)], "doc_id long, text string, n_tokens int")
    p = token_count.Counting(tokenizer("byte_bpe_50k.json"), chunk, overlap, margin=16)
    got = {r.doc_id: r.n_tokens for r in token_count.token_counts(made, p).collect()}
    assert got == {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(ODD * 2)}


def check_packing(rows, texts, lib):
    ids = {k: np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4") for k, t in texts.items()}
    done, sequences = {k: 0 for k in ids}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id]
        assert r.start == done[r.doc_id] and r.doc_tokens == len(own) and r.length > 0
        done[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert done == {k: len(x) for k, x in ids.items()}
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096 and len(s) <= 128
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.01 * sum(done.values())


def test_packing_of_all_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_packing(op6_packing(spark, SF).collect(), texts, library("word_bpe_49k.json"))


def test_packing_of_odd_texts(spark):
    made = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, shard string")
    check_packing(packing.pack_documents(made, tokenizer("word_bpe_49k.json")).collect(), dict(enumerate(ODD)), library("word_bpe_49k.json"))
    assert packing.pack_documents(made.limit(0), tokenizer("word_bpe_49k.json")).count() == 0


def test_examples_stay_whole_within_three_limits(spark):
    made = spark.range(500).select(F.col("id").alias("example_id"), (F.col("id") * 37 % 900 + 1).alias("tokens"), (F.col("id") * 13 % 300).alias("loss_tokens"))
    limits = packing.Limits(tokens=1000, segments=4, loss=400)
    rows = packing.pack_examples(made, limits, shard=100).collect()
    assert sorted(r.example_id for r in rows) == list(range(500))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for s in by.values():
        assert sum(r.tokens for r in s) <= 1000 and sum(r.loss_tokens for r in s) <= 400 and len(s) <= 4
