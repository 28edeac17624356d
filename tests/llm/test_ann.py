"""Nearest neighbours (operator 4): recall, and the share of vectors looked at where neighbours stand out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafpress.llm import ann


def truth(x, ids, k=20):
    out = {}
    for q in ids:
        s = x @ x[q]
        out[q] = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]
    return out


def test_op4_recall_on_a_whole_table(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    place = {r.vec_id: k for k, r in enumerate(rows)}
    got = {}
    for r in ann.op4_prefix_forest(spark, d).collect():
        got.setdefault(r.query_id, {})[r.rank] = r
    assert set(got) == {r.vec_id for r in rows if r.vec_id % 20 == 0}
    hits = 0
    for q, best in got.items():
        assert sorted(best) == list(range(1, 21))
        assert [(-best[k].score, best[k].vec_id) for k in range(1, 21)] == sorted((-r.score, r.vec_id) for r in best.values())
        assert all(r.score == pytest.approx(x[place[q]] @ x[place[r.vec_id]], rel=1e-12) for r in best.values())
        hits += len({place[r.vec_id] for r in best.values()} & set(truth(x, [place[q]])[place[q]]))
    assert hits / (20 * len(got)) >= 0.9


def test_clusters_are_found_in_a_part_of_the_block(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 64))
    x = centres[rng.integers(0, 60, 6000)] + 0.25 * rng.standard_normal((6000, 64))
    forest = ann.Forest(x)
    ids = range(0, 6000, 100)
    found = list(forest.search(x[list(ids)], 21))
    want = truth(x, ids)
    assert np.mean([len(set(f) & set(want[q])) for q, (f, _, _) in zip(ids, found)]) >= 18
    assert np.mean([looked for *_, looked in found]) < 0.25 * len(x)
    monkeypatch.setattr(ann, "BLOCK", 1000)  # several blocks, and a third of all rows are one vector
    x[0] *= 4  # longer than all others, so that its copies are nearest
    x[2000:4000] = x[0]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("dim", "b", "kind", "v", "query_id", "asks")})
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 1000 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q, best in got.items():
        near = [i for _, i in sorted(best)]
        if q in (0, 2000, 3000):  # equal vectors, in whatever block, come in the order of their ids
            s = x @ x[q]
            same = [i for i in np.flatnonzero(s >= s[q] - 1e-12) if i != q]
            assert near == sorted(near) and set(near) <= set(same) and near == same[:20]
        assert len(near) == 20
