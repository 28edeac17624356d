"""Centroid clustering (operator 13) against plain Lloyd rounds on Python integers."""

import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafpress.llm import elkan


def lloyd(rows, k, rounds, dim, scale=1024):
    """(id, cluster, distance) and centroids by definition."""
    kept = [(i, [math.floor(float(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [list(v) for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m))
    near = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, near(v), far(v, c[near(v)])) for i, v in kept), key=str), c


def check(spark, rows, k=8, rounds=10, dim=4, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, c = elkan.cluster(df, k, rounds, dim, **more)
    want, centroids = lloyd(rows, k, rounds, dim)
    assert c == centroids
    assert sorted((tuple(r) for r in found.select("vec_id", "cluster", "distance").collect()), key=str) == want


def test_equals_plain_rounds(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(i % 5, 1) for _ in range(4)]) for i in range(300)]
    rows += [(900 + i, [rng.choice([0.0, 1 / 1024, -1 / 2048]) for _ in range(4)]) for i in range(200)]  # ties
    rows += [(5, rows[5][1])] * 3 + [(None, rows[6][1]), (None, None), (1000, None), (1001, [1.0] * 3), (1002, [1.0] * 5), (1003, [1.0, float("nan"), 0.0, 0.0]), (1004, [1.0, float("-inf"), 0.0, 0.0]), (1005, [1.0, None, 0.0, 0.0])]
    rows += [(2000 + i, [7.0, 7.0, 7.0, 7.0]) for i in range(300)]  # one vector, a third of all rows
    for refresh in (1, 3, 4, 20):
        check(spark, rows, refresh=refresh)


def test_integers_beyond_64_bit_squares(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * 10 ** rng.randrange(0, 15) * 1.0 for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, c = elkan.cluster(df, 5, 4, 4)
    want, centroids = lloyd(rows, 5, 4, 4)
    assert c == centroids
    got = {r.vec_id: (r.cluster, r.distance) for r in found.collect()}
    assert got == {i: (j, d if d < 1 << 63 else None) for i, j, d in want}
    assert any(d is None for _, d in got.values())
    elkan.with_inertia(found, c).collect()


def test_few_equal_and_no_vectors(spark):
    check(spark, [(1, [1.0, 2.0, 3.0, 4.0]), (2, [1.0, 2.0, 3.0, 4.0]), (3, [0.0, 0.0, 0.0, 0.5])])
    check(spark, [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(20)])
    empty = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    found, c = elkan.cluster(empty, dim=4)
    assert found.count() == 0 and c == [] and elkan.with_inertia(found, c).count() == 0


def test_clashing_names(spark):
    rows = [(i, [float(i % 3), float(i), 0.0, 1.0], "x") for i in range(30)]
    names = ["_id", "v", "cluster", "n", "total", "upper", "lower", "distance", "inertia"]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, extra string").select("*", *(F.col("extra").alias(c) for c in names))
    found, _ = elkan.cluster(df, dim=4)
    assert found.columns == ["vec_id", "cluster", "distance"] and found.count() == 30


def test_bounds_skip_most_distances(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 10, (8, 16))
    rows = [(i, [float(x) for x in middle[i % 8] + rng.normal(0, 0.3, 16)]) for i in range(2000)]
    seen = []
    elkan.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dim=16, seen=seen)
    assert len(seen) == 10 and seen[0] > 2000 and sum(seen[5:]) < 0.25 * 5 * 2000 * 8


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=20), st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=5), st.data())
def test_assign_after_centroids_move(vectors, before, data):
    after = data.draw(st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=len(before), max_size=len(before)))
    v, a, b = np.array(vectors), np.array(before), np.array(after)
    n, k = len(v), len(a)
    own, upper, lower, _ = elkan.assign(v, a, a, np.zeros(n, np.int32), np.full(n, np.inf, np.float32), np.zeros((n, k), np.float32))
    for c, start in ((a, a), (b, a)):
        got, up, low, _ = elkan.assign(v, c, start, own, upper, lower)
        true = np.sqrt(((v[:, None] - c[None]) ** 2).sum(-1))
        assert got.tolist() == [min(range(k), key=lambda j: (((x - c[j]) ** 2).sum(), j)) for x in v]
        assert (up.astype(float) >= true[np.arange(n), got]).all() and (low <= true).all()


def test_query_on_a_whole_table(spark, sf):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, c = lloyd(rows, 8, 10, 64)
    got = elkan.op13_elkan_clusters(spark, sf).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    sums = {j: sum(d for _, x, d in want if x == j) for j in range(8)}
    for r in got:
        assert r.cluster_inertia == sums[r.cluster] and r.inertia == sum(sums.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


def test_the_store_is_cleared(spark):
    import os

    rows = [(i, [float(i), 1.0]) for i in range(20)]
    elkan.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dim=2)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(os.listdir(root))
    elkan.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dim=2)
    assert len(set(os.listdir(root)) - before) == 1  # the result alone
