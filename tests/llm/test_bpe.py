"""Byte-level BPE (operator 7): chunks, stitching and the spread path equal the library."""

import base64
import hashlib
import random

import public_tokenizers as files
import pytest
import tiktoken
from pyspark.sql import functions as F

from leafpress.llm import bpe


@pytest.fixture(scope="module")
def own():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(files.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(7)
    parts = ["a" * 300, " " * 90, "\n\n", "it's ", "don't", "12345", "é🎉", "日本語の", "word ", " word", "\t \r\n", "...!?", "x" * 40 + " ", "'ll", "\U00010ee7"]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(120)] + ["a" * 5000 + " b" + " " * 5000 + "c", " " * 9000, "z" * 20000]


def test_stitched_chunks_equal_the_library(own):
    c = bpe.codec()
    for text in odd_texts():
        for chunk, overlap in ((16, 8), (64, 16), (40, 7), (5, 5), (bpe.CHUNK_CHARS, bpe.OVERLAP)):
            assert bpe.encode_text(c, text, chunk, overlap) == own.encode_ordinary(text), (chunk, text[:50])


def test_real_documents_are_stitched(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    c = bpe.codec()
    several = 0
    for t in texts:
        chunks = bpe.cut(t)
        out, broken = bpe.stitch([(at, bpe.split_chunk(c, some, k + 1 == len(chunks))) for k, (at, some) in enumerate(chunks)])
        if broken is None:
            assert "".join(p for some in out for p in some) == t
            several += len(out) > 1
    assert several > 50


def test_spread_texts_repeated_rows_and_clashing_names(spark, own):
    texts = [(k, t) for k, t in enumerate(odd_texts())] + [(None, "long " * 99), (5, "long " * 99), (5, "long " * 99), (6, None), (6, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("_id", "_text", "r1", "rows", "k", "ids", "last")})
    got = sorted(((r.doc_id if r.doc_id is not None else -1, list(r.ids), r.decoded_sha256) for r in bpe.encode_documents(df, chunk_chars=64, overlap=16, spread_chars=200).collect()))
    want = sorted((i if i is not None else -1, own.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)
    assert got == want
    assert bpe.encode_documents(df.where("false")).count() == 0


def test_op7_on_a_whole_table(spark, sf, own):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = bpe.op7_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
