"""Centroid clustering (operator 13): k-means on integer vectors with Elkan's bounds.

Each vector keeps an upper bound of the distance to its own centroid and a lower bound of that to every centroid. When
centroids move, bounds widen by how far; a centroid is looked at only if neither its lower bound nor half its distance
from the vector's own centroid lies above the upper bound. Bounds are single precision, rounded outward, and must lie strictly above, so
what is skipped is truly farther and ties are always compared, on exact integer squares.

Bounds are written once every ``refresh`` rounds, with the vectors they belong to; the rounds between widen them by the way that
centroids went since, and only read. Each task returns the sums of its clusters, which Spark adds up as decimals, so the driver gets
k times ``dim`` numbers a round whatever the table's size. No vector is shuffled, so equal vectors make no hot task.

Defined results: a vector is kept if it has exactly ``dim`` components, none of them null or non-finite, and every scaled one lies
within 2**62, as no long holds others. Null ids are kept and come after all hashes as starting centroids. Repeated rows count each; of
equal hashes the smaller vector starts. With fewer than k kept vectors there are as many centroids; equal centroids leave the larger number
empty, and an empty centroid stays where it is. Without a kept vector there are no rows. A distance or inertia that no long holds is null.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.llm.common import ROW_GROUP, discard, own_folder, stored, table

#: Within this, squares of 64 differences add up in 64 bits; beyond it Python's integers count.
SAFE = 1 << 27
_ROWS = 1 << 12
_SUMS = "cluster int, n long, total array<decimal(38,0)>"


def integer_vectors(df: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(_id, v array<long>) of the vectors that are kept."""
    x = F.col(f"`{vector_col}`")
    fine = (F.size(x) == dim) & F.forall(x, lambda e: F.coalesce(~F.isnan(e.cast("double")) & (F.abs(e.cast("double") * scale) < float(1 << 62)), F.lit(False)))
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col(f"`{id_col}`").alias("_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; of Python integers where 64 bits may not do."""
    d = v - c
    return (d * d).sum(-1)


def root(squares: np.ndarray, up: bool) -> np.ndarray:
    """Square roots in single precision, moved outward so that they bound the true ones."""
    x = np.sqrt(squares.astype(np.float64)).astype(np.float32)
    return np.nextafter(x, np.float32(np.inf if up else -np.inf))


def exact(values: np.ndarray, *others: np.ndarray) -> bool:
    return all(not x.size or max(int(x.max()), -int(x.min())) <= SAFE for x in (values, *others))


def assign(v: np.ndarray, c: np.ndarray, before: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid (ties: smaller number), new bounds, and how many distances were taken.

    ``own``, ``upper`` and ``lower`` held for the centroids ``before``.
    """
    own = own.copy()
    moved = root(squared(c, before), True).astype(np.float64)
    u = np.nextafter(upper.astype(np.float64) + moved[own], np.inf)
    low = np.nextafter(lower.astype(np.float64) - moved, -np.inf)
    half = root(squared(c[:, None], c[None]), False).astype(np.float64) / 2
    cost = np.zeros(len(v), v.dtype)

    def open_to(rows: np.ndarray, j: int | slice) -> np.ndarray:
        most = u[rows] if isinstance(j, int) else u[rows, None]
        return ~((low[rows, j] > most) | (half[own[rows], j] > most))

    every = np.arange(len(v))
    maybe = open_to(every, slice(None))
    maybe[every, own] = False
    some = np.flatnonzero(maybe.any(1))
    cost[some] = squared(v[some], c[own[some]])
    u[some], low[some, own[some]] = root(cost[some], True), root(cost[some], False)
    tried = len(some)
    for j in range(len(c)):
        rows = some[maybe[some, j]]
        rows = rows[open_to(rows, j)]
        if not len(rows):
            continue
        d = squared(v[rows], c[j])
        tried += len(rows)
        low[rows, j] = root(d, False)
        won = (d < cost[rows]) | ((d == cost[rows]) & (j < own[rows]))
        rows, d = rows[won], d[won]
        own[rows], cost[rows], u[rows] = j, d, root(d, True)
    out = np.float32(np.inf)
    return own, np.nextafter(u.astype(np.float32), out), np.nextafter(low.astype(np.float32), -out), tried


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(np.ascontiguousarray(values).ravel(), kind))


def _step(c: list[list[int]], before: list[list[int]] | None, keep: bool, last: bool):
    """One round over the batches of a task. before: the centroids of the stored bounds; None if there are none."""
    k, dim = len(c), len(c[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, tried = np.zeros(k, np.int64), np.zeros((k, dim), object), 0
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                b = whole.slice(at, _ROWS)
                n = b.num_rows
                v = b["v"].flatten().to_numpy().reshape(n, dim)
                now, old = np.array(c, object), np.array(before or c, object)
                small = exact(v, now, old)
                v, now, old = (x.astype(np.int64 if small else object) for x in (v, now, old))
                if before is None:
                    own, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf, np.float32), np.zeros((n, k), np.float32)
                else:
                    own, upper = b["cluster"].to_numpy(), b["upper"].to_numpy()
                    lower = b["lower"].flatten().to_numpy().reshape(n, k)
                own, upper, lower, looked = assign(v, now, old, own, upper, lower)
                tried += looked
                if last:
                    far = squared(v, now[own])
                    far = pa.array(far if small else [x if x < 1 << 63 else None for x in far], pa.int64())
                    yield pa.RecordBatch.from_arrays([b["_id"], pa.array(own, pa.int32()), far], ["_id", "cluster", "distance"])
                    continue
                for j in range(k):
                    mine = v[own == j]
                    count[j] += len(mine)
                    total[j] += mine.sum(0).astype(object)
                if keep:
                    none = [pa.nulls(n, t) for t in (pa.int64(), pa.list_(pa.decimal128(38, 0)))]
                    cols = [pa.array(own, pa.int32()), none[0], none[1], b["_id"], b["v"], pa.array(upper, pa.float32()), _lists(lower, pa.float32())]
                    yield pa.RecordBatch.from_arrays(cols, ["cluster", "n", "total", "_id", "v", "upper", "lower"])
        if last:
            return
        used = np.flatnonzero(count)
        # The task's share of distances that were taken travels as cluster -1.
        sums = pa.array([[Decimal(int(x)) for x in total[j]] for j in used] + [[Decimal(tried)]], pa.list_(pa.decimal128(38, 0)))
        cols = [pa.array([*used, -1], pa.int32()), pa.array([*count[used], 1], pa.int64()), sums]
        names = ["cluster", "n", "total"]
        if keep:
            cols += [pa.nulls(len(used) + 1, t) for t in (id_type[0], pa.list_(pa.int64()), pa.float32(), pa.list_(pa.float32()))]
            names += ["_id", "v", "upper", "lower"]
        yield pa.RecordBatch.from_arrays(cols, names)

    id_type: list[pa.DataType] = [pa.int64()]
    return run, id_type


def cluster(
    df: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: str = "3:", refresh: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", seen: list[int] | None = None
) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every kept vector after ``rounds`` rounds and a last assignment, and the final centroids.

    seen: if given, gets the number of distances that each round took.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    kind = df.schema[id_col].dataType
    vectors = integer_vectors(df, dim, scale, id_col, vector_col)
    first = vectors.orderBy(F.sha2(F.concat(F.lit(salt), F.col("_id").cast("string")), 256).asc_nulls_last(), "v").limit(k)
    c = [list(r.v) for r in first.select("v").collect()]
    if not c:
        return vectors.select(F.col("_id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), c
    held, at, folder = vectors, None, None
    for r in range(rounds):
        keep = r % refresh == 0
        run, id_type = _step(c, at, keep, False)
        id_type[0] = to_arrow_type(kind)
        if keep:
            made = held.mapInArrow(run, f"{_SUMS}, _id {kind.simpleString()}, v array<long>, upper float, lower array<float>")
            new = own_folder(spark)
            made.write.option("parquet.block.size", str(ROW_GROUP)).parquet(new)
            if folder:
                discard(spark, folder)
            rows = spark.read.schema(made.schema).parquet(new)
            held, at, folder = rows.where("n IS NULL").select("_id", "v", "cluster", "upper", "lower"), c, new
            sums = rows.where("n IS NOT NULL").select("cluster", "n", "total")
        else:
            sums = held.mapInArrow(run, _SUMS)
        added = sums.select("cluster", "n", F.posexplode("total").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
        new_c = [list(x) for x in c]
        for row in added:  # at most (k + 1) * dim rows
            if row.cluster >= 0:
                new_c[row.cluster][row.d] = int(row.x) // row.n
            elif seen is not None:
                seen.append(int(row.x))
        c = new_c
    run, _ = _step(c, at, False, True)
    out = stored(held.mapInArrow(run, f"_id {kind.simpleString()}, cluster int, distance long"))
    if folder:
        discard(spark, folder)
    return out.withColumnRenamed("_id", id_col), c


def with_inertia(clustered: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """clustered plus cluster_inertia, inertia and centroid_sha256; a side of at most k rows is broadcast."""
    spark = clustered.sparkSession
    if not centroids:
        return clustered.withColumns({"cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"), "centroid_sha256": F.lit("")})
    sums = {r.cluster: r.s for r in clustered.groupBy("cluster").agg(F.expr("if(count(distance) = count(*), sum(CAST(distance AS DECIMAL(38,0))), NULL)").alias("s")).collect()}
    fits = lambda x: int(x) if x is not None and x < 1 << 63 else None
    whole = None if None in sums.values() else fits(sum(sums.values()))
    rows = [(j, fits(sums.get(j, 0)), whole, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clustered.join(F.broadcast(facts), "cluster")


def op13_elkan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    return with_inertia(found, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(r: int) -> str:
    """The assignment to the centroids of round r, and the centroids after it."""
    return f"""
a{r} AS MATERIALIZED (SELECT i, vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT kept.*, c, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(kept.v, c{r}.m)])::BIGINT AS d FROM kept, c{r}) GROUP BY i, vec_id, v),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(f.m, c{r}.m) AS m FROM c{r} LEFT JOIN (
  SELECT c, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY p) AS m FROM (
    SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(len(v))) AS p FROM a{r}) GROUP BY c, p) GROUP BY c) f ON f.c = c{r}.c)"""


#: Ten rounds written out; each compares every vector with all centroids.
ORACLE_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and([coalesce(isfinite(x::DOUBLE), false) FOR x IN embedding])),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v AS m FROM kept ORDER BY sha256('3:' || vec_id) LIMIT 8),
{",".join(_round_sql(r) for r in range(11))}
SELECT vec_id, a10.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a10.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a10 JOIN c10 ON a10.c = c10.c
"""
