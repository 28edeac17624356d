"""Models and rules against plain loops over a whole small table."""

import re

import numpy as np
import pytest

from leafpress.llm import langid, quality, url_filter


def test_op3_ratio_and_weights(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    mark = np.zeros(quality.DIM, bool)
    texts = {r.doc_id: r.text for r in docs.collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in texts}
    ids = sorted(y)[:40]
    rows, marks = [quality.features(texts[i][:400], mark) for i in ids], np.array([y[i] for i in ids])
    assert len(set(marks.tolist())) == 2
    counts = [{}, {}]
    for features, label in zip(rows, marks.tolist()):
        for f in features.tolist():
            counts[label][f] = counts[label].get(f, 1) + 1
    total = [quality.DIM + sum(v - 1 for v in c.values()) for c in counts]
    used = sorted({*counts[0], *counts[1]})
    ratio = np.array([np.log(counts[1].get(f, 1) / total[1]) - np.log(counts[0].get(f, 1) / total[0]) for f in used])
    pure, _ = quality._nbsvm(rows, marks, 4.0, 1.0)
    mixed, bias = quality._nbsvm(rows, marks, 4.0, 0.9)
    seen = np.zeros(quality.DIM, bool)
    seen[used] = True
    assert not pure[~seen].any() and not mixed[~seen].any()
    told = np.abs(ratio) > 1e-12
    plain = np.zeros(len(used))
    plain[told] = pure[used][told] / ratio[told]
    mean = np.abs(plain).sum() / told.sum()
    assert mixed[used] == pytest.approx(ratio * (0.1 * mean + 0.9 * plain), rel=1e-9, abs=1e-12)
    # The bounded number of epochs comes within a twentieth of the minimum that long plain descent on the dual finds.
    place = {f: k for k, f in enumerate(used)}
    x = np.zeros((len(rows), len(used) + 1))
    for i, features in enumerate(rows):
        for f in features.tolist():
            x[i, place[f]] = ratio[place[f]]
        x[i, -1] = 1.0
        x[i] /= np.sqrt(x[i] @ x[i])
    sign = np.where(marks == 1, 1.0, -1.0)
    cost = np.array([4.0 * len(marks) / (2 * (marks == m).sum()) for m in marks])
    loss = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - sign * (x @ w))).sum()
    alpha, best = np.zeros(len(rows)), np.zeros(len(used) + 1)
    for _ in range(300):
        for i in range(len(rows)):
            new = min(max(alpha[i] - (sign[i] * (x[i] @ best) - 1) / (x[i] @ x[i]), 0.0), cost[i])
            best += (new - alpha[i]) * sign[i] * x[i]
            alpha[i] = new
    assert loss(np.append(plain, bias)) <= 1.05 * loss(best)


def test_op6_host_path_and_rule(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in url_filter.op6_url_filter(spark, sf).collect():
        url = urls[r.page_id]
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = []
        for rule, says in url_filter.RULES:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((-len(rule), rule, says))
        assert (r.host, r.path, r.rule) == (host, path, min(fits)[1] if fits else None)
        assert r.verdict == min(fits)[2] if fits else r.verdict in ("allow", "block")


def test_op2_decides_each_text_alone(spark, sf):
    """What a slice of many texts gives is what each text gives by itself."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs, langid.F.coalesce(langid.F.pmod(langid.id_checksum(), langid.F.lit(5)) != 0, langid.F.lit(True)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in langid.op2_language_id(spark, sf).collect()}
    assert set(got) == set(texts)
    for i in sorted(texts)[:60]:
        lang, sure, _, _ = (c.to_pylist()[0] for c in langid._judged(model, [texts[i]], penalty=langid.SWITCH, with_spans=False))
        assert (got[i].lang_pred, got[i].score) == (lang, pytest.approx(sure)), i
