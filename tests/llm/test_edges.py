"""Edges that all operators share: clashing names, repeated rows, empty tables, nulls; and brute force for operator 3."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafpress.llm import ann, bpe, fingerprint, langid, line_dedup, mixing, near_dup, quality, toxicity, url_filter
from leafpress.llm import textkernel as tk

#: Names that operators use for themselves, and those of their results.
NAMES = """_text _id _d _row _r1 _r2 _h1 _h2 _n _t _w _o _i _s _z _copy _words _size _source _dup _kept _null _in0 _in1 _url _tld _suffix _of _root
r1 r2 n t bucket late after keep from end h range salt salts pos line key first part drop word bits cls rep bands root row size own met rest
score predicted worst_start worst_end lang_pred lang_score n_spans lang_spans n_lines n_dropped kept_text fingerprint copies dup target
ids n_tokens rows k last text_ host path rule verdict block_score length depth query_id vec_id_ dim b kind v asks""".split()
TEXT = "The first line of a text here\nand a second line that is longer\nThe end of it all"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeated rows, an empty and a long text, under every name an operator uses."""
    rows = [(1, TEXT, "en", "a", 10), (1, TEXT, "en", "a", 10), (2, TEXT, "en", None, 10), (None, TEXT + " more", None, "b", None), (3, None, "en", "a", None), (4, "", None, None, 0), (5, "long word " * 4000, "en", "b", 40000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.concat(F.lit(f"{c}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in NAMES))


def kept_as_given(out, names):
    for r in out.collect():
        assert all(r[c] == f"{c}/{'-' if r.doc_id is None else r.doc_id}" for c in names)


def test_operators_that_pass_columns_keep_them(spark, sf, odd):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = langid.identify(odd, langid.fit(docs, F.lit(True)))
    kept_as_given(lang, [c for c in NAMES if c not in ("lang_pred", "lang_score", "n_spans", "lang_spans")])
    good = quality.classify(odd, quality.fit(docs, labels, "quality", F.lit(True), max_rows=30))
    kept_as_given(good, [c for c in NAMES if c not in ("score", "predicted")])
    bad = toxicity.score_toxicity(odd, toxicity.fit(docs, labels, F.lit(True), max_rows=30))
    kept_as_given(bad, [c for c in NAMES if c not in ("score", "predicted", "worst_start", "worst_end")])
    lines = line_dedup.dedup_lines(odd)
    kept_as_given(lines, [c for c in NAMES if c not in ("n_lines", "n_dropped", "kept_text")])
    kept_as_given(fingerprint.fingerprint(odd), [c for c in NAMES if c != "fingerprint"])
    pages = odd.withColumn("url", F.lit("http://a.net/x"))
    kept_as_given(url_filter.judge(pages), [c for c in NAMES if c not in ("host", "path", "rule", "verdict", "block_score")])
    for out in (lang, good, bad, lines):
        assert out.count() == 7
        both = [tuple(r) for r in out.where("doc_id = 1").collect()]
        assert len(both) == 2 and both[0] == both[1]
    for make in (lambda d: langid.identify(d, langid.fit(docs, F.lit(True))), line_dedup.dedup_lines, fingerprint.fingerprint):
        assert make(odd.where("false")).count() == 0


def test_operators_that_make_rows_of_their_own(odd):
    assert near_dup.near_duplicates(odd).count() == bpe.encode_documents(odd).count() == fingerprint.compare_with_next(odd).count() == mixing.mix(odd).count() == 7
    vectors = odd.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    assert ann.nearest(vectors, F.lit(True), id_col="doc_id").count() > 0


def test_stages_keep_columns(spark, sf, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        kept_as_given(out, NAMES)
        assert stage(spark, docs.where("false"), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf).count() == 7


def grams(text):
    """The features of a text by plain loops, with the operator's hash of a tuple."""
    found = set()
    raw = tk.codes(text)
    case = tk.case_table()
    folded = [int(case[c]) if case[c] else int(c) for c in raw]
    h = lambda parts, salt: int(quality._hash([np.array([p]) for p in parts], salt)[0])
    for n in (1, 2, 3):
        found |= {h(folded[i : i + n], n) for i in range(len(folded) - n + 1)}
    shapes, before = [], None
    for word in text.split():
        kinds = [int(case[c]) for c in tk.codes(word)]
        tail = 0 if kinds[-1] else ord(word[-1])
        kind = (1 in kinds) + 2 * (2 in kinds) + 4 * (3 in kinds) + 8 * (kinds.count(1) > 1)
        shapes.append((tail * 16 + kind) * 2 + int(word.lower() == before))
        before = word.lower()
        found.add(quality._HALF + h([shapes[-1] * 8 + min(7, int(np.log2(len(word) + 1)))], 11))
    for n in (1, 2, 3):
        found |= {quality._HALF + h(shapes[i : i + n], 20 + n) for i in range(len(shapes) - n + 1)}
    return found


def test_op3_equals_brute_force(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    mark = np.zeros(quality.DIM, bool)
    texts = {r.doc_id: r.text for r in docs.collect()}
    each = {i: quality.features(t, mark) for i, t in texts.items()}
    for i in sorted(texts)[:25]:
        assert set(each[i].tolist()) == grams(texts[i])
    # Log-count ratios and scaled weights on dense vectors.
    y = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in texts}
    rows, marks = [each[i] for i in sorted(y)], np.array([y[i] for i in sorted(y)])
    p, q = (np.ones(quality.DIM) for _ in range(2))
    for ids, label in zip(rows, marks):
        (p if label else q)[ids] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[(p == 1) & (q == 1)] = 0
    weights, bias = quality._nbsvm(rows, marks, 4.0, 0.9)
    used = ratio != 0
    assert not weights[~used].any()
    dense = np.zeros(quality.DIM)
    dense[rows[0]] = 1
    assert quality._margins(weights, bias, rows[:1])[0] == pytest.approx(dense @ weights + bias)
    plain = (weights[used] / ratio[used] - np.median(weights[used] / ratio[used])) if used.any() else weights
    assert np.isfinite(plain).all()
    got = {r.doc_id: r for r in quality.op3_quality(spark, sf).collect()}
    model = quality.fit(docs, labels, "quality", ~quality.held_out_mod(3, 1))
    for i, r in got.items():
        dense[:] = 0
        dense[each[i]] = 1
        want = 1 / (1 + np.exp(-(model.a * (dense @ model.weights + model.bias) + model.b)))
        assert r.score == pytest.approx(want, abs=1e-6) and r.predicted == int(r.score >= 0.5)


def test_op8_and_op2_and_op6_and_op9_on_whole_tables(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    got = {r.doc_id: r for r in toxicity.op8_toxicity(spark, sf).collect()}
    model = toxicity.fit(docs, labels, ~quality.held_out_mod(4, 2))
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.score == pytest.approx(model.score_of(*toxicity.worst(model.weights, texts[i].text)[:2])) and r.predicted == int(r.score >= 0.3)
    more = "/root/testdata/sf0.01"  # few documents of sf0.001 have a label
    held = toxicity.op8_toxicity(spark, more).where("held_out").join(spark.read.parquet(f"{more}/labels.parquet"), "doc_id")
    right, n = held.selectExpr("avg(cast(predicted = toxic as double))", "count(*)").first()
    assert n > 50 and right > 0.9, right
    assert {r.doc_id for r in langid.op2_language_id(spark, sf).collect()} == set(texts)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    judged = url_filter.op6_url_filter(spark, sf)
    assert judged.count() == pages.count() and judged.where("verdict NOT IN ('allow', 'block')").count() == 0
    mixed = mixing.op9_cube_mixing(spark, sf).collect()
    taken, goal = Counter(), {}
    for r in mixed:
        assert r.size == len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", texts[r.doc_id].text) if w]) and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[r.source] += r.taken
        goal[r.source] = r.target
    assert len(mixed) == len(texts) and all(abs(taken[s] - g) <= 0.01 * g + 5 for s, g in goal.items())


def test_op8_without_tokens_or_labels_of_a_class(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "1 2 3"), (4, "no"), (5, "some words to score")], "doc_id long, text string")
    labels = lambda toxic: spark.createDataFrame([(k, t) for k, t in toxic.items()], "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id < 5"), labels({1: 0, 2: 1, 3: 1, 4: 0}), F.lit(True))
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(scores) == 5 and len(set(scores.values())) == 1 and 0 < scores[5] < 1
    for kind in (0, 1):  # one class
        model = toxicity.fit(docs, labels({5: kind}), F.lit(True))
        assert {r.predicted for r in toxicity.score_toxicity(docs, model).collect()} == {kind}
    empty = toxicity.fit(docs.where("false"), labels({5: 1}), F.lit(True))
    assert toxicity.score_toxicity(docs.where("false"), empty).count() == 0


def test_op8_long_tokens_are_not_kept():
    toxicity._kept_norm.cache_clear()
    long = bytes([1, 2, 3] * 50)
    assert toxicity.norm(long) == toxicity._norm(long) and toxicity._kept_norm.cache_info().currsize == 0
    assert toxicity.norm(long[:30]) == toxicity._norm(long[:30]) and toxicity._kept_norm.cache_info().currsize == 1


def test_op4_long_vectors_make_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_BYTES", 8 * 16 * 40)  # 40 rows of 16 components
    rng = np.random.default_rng(1)
    x = rng.standard_normal((150, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 30 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {q: [int(i) for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:5] for q in range(0, 150, 30)}
    assert np.mean([len(set(got[q]) & set(want[q])) for q in want]) >= 4.5
