"""The pipeline's stages, each against brute force on its own input."""

import hashlib
import importlib
import sys

import pytest

import corpus_pipeline
from leafpress.llm import quality
from leafpress.llm.common import stored

from .test_models import multiset
from .test_text_ops import cut_lines


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(100001, None, None, None, None), (100002, "", "en", "src0", 0)], docs.schema))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf)))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_of_documents_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dup", "mixing", "byte_bpe"]


def test_quality_keeps_what_the_classifier_accepts(spark, sf, stages):
    model = quality.fit(stages[0], spark.read.parquet(f"{sf}/labels.parquet"), "quality", ~quality.held_out_mod(3, 1))
    want = {r.doc_id for r in quality.classify(stages[0], model).where("predicted = 1").collect()}
    assert set(rows(stages[1])) == want
    judged = stages[0].join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("doc_id", "quality").collect()
    assert sum((r.doc_id in want) == bool(r.quality) for r in judged) >= 0.95 * len(judged)


def test_lines_go_as_brute_force_says(stages):
    before, after = rows(stages[1]), rows(stages[2])
    want = cut_lines([(i, r.text) for i, r in before.items()])
    assert set(after) == {i for i, (n, k, _) in want.items() if k < n or not k}
    for i, r in after.items():
        n, k, text = want[i]
        assert r.text == (before[i].text if before[i].text is None else text)
        assert r.n_chars == (len(text) if k else before[i].n_chars)


def test_one_of_each_near_duplicate_class_stays(stages):
    docs = rows(stages[2])
    sets = {i: multiset(r.text) for i, r in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            low = sum((sets[i] & sets[j]).values())
            if sets[i] and low >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - low):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert set(rows(stages[3])) == {find(i) for i in ids}


def test_mix_and_encoding(spark, stages):
    import base64

    import public_tokenizers as files
    import tiktoken

    assert set(rows(stages[4])) <= set(rows(stages[3])) and stages[4].groupBy("doc_id").count().where("count > 3").count() == 0
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(files.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in stages[4].collect()}
    got = stages[5].collect()
    assert len(got) == stages[4].count()
    for r in got:
        assert list(r.ids) == own.encode_ordinary(texts[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_input_passes_every_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_nothing_else_imports_the_subpackage():
    for name in [m for m in sys.modules if m.startswith("leafpress.") and not m.startswith("leafpress.llm")]:
        source = open(importlib.import_module(name).__file__).read()
        assert "leafpress.llm" not in source and "corpus_pipeline" not in source
