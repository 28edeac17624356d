"""Near-dedup (operator 5): what is verified, and which rows the stage keeps."""

import random

from pyspark.sql import functions as F

from leafpress.llm import near_dup


def boilerplate(n):
    """Texts of 240 shared words and five of n/2 paragraphs, about 0.75 alike: they share buckets and aren't near copies."""
    rng = random.Random(n)
    shared = [f"w{k}" for k in range(240)]
    paragraphs = [[f"p{k}x{i}" for i in range(7)] for k in range(n // 2)]
    return [" ".join(shared + [w for p in rng.sample(paragraphs, 5) for w in p]) for _ in range(n)]


def searched(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sigs = near_dup.signatures(docs)
    classes = sigs.groupBy("cls", "bands").agg(F.min("doc_id").alias("rep"))
    return near_dup.search(docs, classes), classes


def groups(edges, n):
    root = list(range(n))
    for a, b in edges:
        old, new = root[a], root[b]
        root = [new if r == old else r for r in root]
    return {frozenset(k for k in range(n) if root[k] == r) for r in root}


def test_boilerplate_is_not_compared_in_all_pairs(spark):
    counts = {}
    for n in (200, 400):
        texts = boilerplate(n)
        found, classes = searched(spark, texts)
        pairs = found.checked.collect()
        assert len(pairs) == len({tuple(sorted((bytes(r.a), bytes(r.b)))) for r in pairs})  # none twice
        counts[n] = len(pairs)
        each = [near_dup.shingles(t) for t in texts]
        key = {bytes(r.cls): r.rep for r in classes.collect()}
        got = {tuple(sorted((key[bytes(r.a)], key[bytes(r.b)]))) for r in found.links().collect()}
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if near_dup.similarity(each[i], each[j]) >= near_dup.SIMILAR}
        assert got <= want and groups(got, n) == groups(want, n)
    print(counts)
    assert counts[400] < 400 * 399 / 2 / 2 and counts[400] < 3 * counts[200]


def test_stage_decides_by_row(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    near = a.replace("a7 ", "zz ")
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (7, c, 4), (7, c, 4), (None, c, 5), (None, d, 6), (None, d, 7), (8, near, 8), (9, None, 9), (9, None, 9), (10, "", 10), (None, None, 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls int").withColumns({n: F.lit("x") for n in ("_d", "_row", "_r1", "_r2", "r1", "_text", "rep", "key", "_kept", "root")})
    kept = near_dup.near_dup_stage(spark, df, "")
    assert kept.columns == df.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == sorted([(3, a), (5, b), (7, c), (0, d), (9, ""), (9, ""), (10, ""), (0, "")])
    classes = {(r.doc_id, r.class_id, r.copy_id) for r in near_dup.near_duplicates(df).collect()}
    assert classes == {(3, 3, 3), (5, 3, 3), (5, 5, 5), (7, 7, 7), (None, 7, 7), (None, None, None), (8, 3, 8), (9, 9, 9), (10, 10, 10)}
    assert near_dup.near_dup_stage(spark, df.where("false"), "").count() == 0


def test_long_text_gives_the_same_signature_in_slices(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    h, w = rng.integers(0, 2**63, 3000).astype(np.uint64), rng.integers(1, 9, 3000)
    doc = np.sort(rng.integers(0, 5, 3000))
    whole = near_dup.bag_min_hash(doc, h, w, 5)
    monkeypatch.setattr(near_dup, "_SEEDS", 100)
    assert (near_dup.bag_min_hash(doc, h, w, 5) == whole).all()


def test_consumed_tables_are_deleted(spark):
    import os

    docs = spark.createDataFrame(list(enumerate(boilerplate(30) + [" ".join(f"a{k}" for k in range(60))] * 3)), "doc_id long, text string")
    near_dup.near_duplicates(docs).count()
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(os.listdir(root))
    out = near_dup.near_duplicates(docs)
    left = set(os.listdir(root)) - before
    assert len(left) == 3, left  # signatures, classes and roots, which the result is read from
    assert out.count() == 33


def test_every_near_copy_of_a_whole_table_is_found(spark):
    """Classes equal those of all pairs that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    each = {r.doc_id: near_dup.shingles(r.text) for r in docs.collect()}
    ids = sorted(each)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i in ids:
        for h in each[i][0].tolist():
            holders.setdefault(h, []).append(i)
    pairs = {(a, b) for held in holders.values() if len(held) > 1 for x, a in enumerate(held) for b in held[x + 1 :]}
    for a, b in pairs:
        if near_dup.similarity(each[a], each[b]) >= near_dup.SIMILAR:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i in ids}
