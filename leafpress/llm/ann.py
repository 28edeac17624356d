"""Approximate nearest neighbours (operator 4): a hash-prefix forest.

Vectors are dealt into blocks of bounded size. In each block a tree is the sorted array of
its vectors' 64-bit hash strings (signs of random projections, with one extra coordinate that
turns the largest inner product into the smallest angle). A query descends every tree to its
longest matching prefix and then ascends all trees together, to prefixes short enough for as many candidates as are
asked for; those are ranked by their exact inner product.

There are two passes. In the first, every block gives a query the candidates of two steps, and the best of all blocks
are merged. A query whose best were nearly all among the candidates of the first step (all but ``LATE``) is answered: its
neighbours stand out. For the others, as among independent directions, the second pass
ascends in every block until the trees together hold ``visits`` times the block's vectors.

A task streams: it builds the trees of a block once and then lets the queries pass, a slice at a time. Every
query meets every block, and the best of the blocks are merged.

Equal vectors of a block share one place in its trees, with the ``k`` + 1 smallest ids; no
query can need more of them, so a vector that fills a third of the table costs no candidates.
Block size and ``visits`` are fixed, so recall doesn't depend on the size of the table.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part. Vectors of different lengths are separate searches. Rows that repeat id and vector
count once; if one id has several vectors, its rows never find each other and an id is listed
once with its best score. A null id takes no part. Equal scores are ordered by id; a score is summed in one fixed order, so equal
vectors score alike in any block. An empty table gives no rows. Of the input only id and vector are read, so other
columns' names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafpress.llm.common import fitted, stored, table

TREES, BITS = 24, 64
VISITS = 1.0
BLOCK, QUERY_SLICE = 8192, 256
#: A block of long vectors has fewer rows, so that a task holds no more than this of them.
BLOCK_BYTES = 64 << 20
#: Candidates that the trees together hold in the first step, for each neighbour asked for; the second step has GROWTH times as many at least.
START, GROWTH = 16, 1.5
#: A query is answered by the first pass if at most this share of its best came from the second step alone.
LATE = 0.05
#: Free bits of the prefixes that are tried, from the longest prefix up.
LEVELS = range(BITS + 1)


class Forest:
    """Sorted hash strings of one block of distinct vectors."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = 11):
        self.x = vectors
        norms = np.sqrt((vectors * vectors).sum(1))
        self.scale = float(norms.max(initial=0.0)) or 1.0
        extra = np.sqrt(np.maximum(0.0, 1 - (norms / self.scale) ** 2))
        lifted = np.column_stack((vectors / self.scale, extra))
        rng = np.random.default_rng(seed)
        self.planes = [rng.standard_normal((lifted.shape[1], BITS)) for _ in range(trees)]
        self.trees = []
        for plane in self.planes:
            strings = self._strings(lifted, plane)
            order = np.argsort(strings, kind="stable")
            self.trees.append((strings[order], order))

    @staticmethod
    def _strings(lifted: np.ndarray, plane: np.ndarray) -> np.ndarray:
        return ((lifted @ plane) > 0).astype(np.uint64) @ (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(trees, levels, queries) first and last places of the strings that share a query's prefix of BITS - level bits."""
        n = np.sqrt((queries * queries).sum(1, keepdims=True))
        lifted = np.column_stack((queries / np.where(n > 0, n, 1), np.zeros(len(queries))))
        lo = np.zeros((len(self.trees), len(LEVELS), len(queries)), np.int32)
        hi = np.zeros_like(lo)
        for t, ((strings, _), plane) in enumerate(zip(self.trees, self.planes)):
            own = self._strings(lifted, plane)
            for k, level in enumerate(LEVELS):
                free = np.uint64((1 << level) - 1)
                lo[t, k] = np.searchsorted(strings, own & ~free, "left")
                hi[t, k] = np.searchsorted(strings, own | free, "right")
        return lo, hi

    def search(self, queries: np.ndarray, k: int, visits: float | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each query the vectors found that may be among the k best, whether the second step found them, and how many were looked at.

        Without visits two steps are made, of at least START * k and GROWTH times as many candidates in all trees.
        """
        lo, hi = self.ranges(queries)
        held = (hi - lo).sum(0)
        least = min(k, len(self.x))
        for q, query in enumerate(queries):
            seen, early = np.zeros(len(self.x), bool), np.zeros(len(self.x), bool)
            enough, steps = (START * k, 2) if visits is None else (visits * len(self.x), 1)
            while True:
                level = min(int(np.searchsorted(held[:, q], enough)), len(LEVELS) - 1)
                for (_, order), a, z in zip(self.trees, lo[:, level, q], hi[:, level, q]):
                    seen[order[a:z]] = True
                enough = GROWTH * max(1, held[level, q])
                if seen.sum() >= least:
                    steps -= 1
                    if not steps or level == len(LEVELS) - 1:
                        break
                    early = seen.copy()
            found = np.flatnonzero(seen)
            looked = len(found)
            if looked > k:
                score = self.x[found] @ query
                # Ties at the last place are settled by the exact sum, so those a rounding away come along.
                cut = np.partition(score, looked - k)[looked - k]
                found = found[score >= cut - 1e-9 * max(1.0, abs(cut))]
            # With all vectors looked at nothing is left for a further step.
            yield found, ~early[found] & (looked < len(self.x)), looked


def search_block(forest: Forest, ids: np.ndarray, first: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, visits: float | None) -> pa.RecordBatch:
    """(query_id, vec_id, score, late): up to k found rows of this block for each query. ids[first[f]:first[f + 1]] have vector f."""
    out: list[tuple] = []
    for q, (found, late, _) in zip(range(len(queries)), forest.search(queries, k + 1, visits)):
        score = (forest.x[found] * queries[q]).sum(1)
        rows = [(-s, i, x) for f, s, x in zip(found, score, late) for i in ids[first[f] : min(first[f + 1], first[f] + k + 1)] if i != query_ids[q]]
        rows.sort()
        out += [(query_ids[q], i, -s, bool(x)) for s, i, x in rows[:k]]
    kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64(), "late": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out) if out else ((),) * 4, kinds.values())], list(kinds))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _streamed(k: int, visits: float | None):
    """Batches sorted by dim, block and kind: a block's data rows build its forest, then its queries pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, forest, ids, first = None, [], None, None, None
        for b in batches:
            dim, of, kind = (b[c].to_numpy() for c in ("dim", "b", "kind"))
            edges = np.flatnonzero(np.concatenate(([True], (dim[1:] != dim[:-1]) | (of[1:] != of[:-1]) | (kind[1:] != kind[:-1]))))
            for i, j in zip(edges, [*edges[1:], b.num_rows]):
                part = b.slice(i, j - i)
                if (dim[i], of[i]) != block:
                    block, rows, forest = (dim[i], of[i]), [], None
                if kind[i] == 0:
                    rows.append((part["vec_id"].to_numpy(), _matrix(part["v"], dim[i])))
                    continue
                if forest is None and rows:
                    distinct, place = np.unique(np.concatenate([v for _, v in rows]) + 0.0, axis=0, return_inverse=True)
                    ids, place = np.concatenate([x for x, _ in rows]), place.ravel()
                    by = np.lexsort((ids, place))
                    ids, first = ids[by], np.searchsorted(place[by], np.arange(len(distinct) + 1))
                    forest, rows = Forest(distinct), []
                if forest is not None:
                    for at in range(0, part.num_rows, QUERY_SLICE):
                        some = part.slice(at, QUERY_SLICE)
                        yield search_block(forest, ids, first, some["vec_id"].to_numpy(), _matrix(some["v"], dim[i]), k, visits)

    return run


def usable(vector: Column) -> Column:
    return F.coalesce(
        (F.size(vector) > 0)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", visits: float = VISITS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows found nearest to each row that passes is_query."""
    v = F.col(f"`{vector_col}`")
    slim = rows.where(usable(v) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"), is_query.alias("asks"))
    slim = slim.withColumn("dim", F.size("v")).dropDuplicates(["vec_id", "v"])
    counts = slim.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("q"))
    # One row for each length of vectors.
    plan = stored(counts.where("q > 0").select("dim", F.ceil(F.col("n") / F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(BLOCK_BYTES / (8 * F.col("dim")))))).cast("int").alias("blocks")))
    dealt = slim.join(fitted(plan), "dim").withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), "blocks").cast("int"))
    data = dealt.select("dim", "b", F.lit(0).alias("kind"), "vec_id", "v")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(asked: DataFrame, visits: float | None) -> DataFrame:
        every = asked.select("dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.lit(1).alias("kind"), "vec_id", "v")
        met = data.unionByName(every).repartition("dim", "b").sortWithinPartitions("dim", "b", "kind")
        found = met.mapInArrow(_streamed(k, visits), "query_id long, vec_id long, score double, late boolean")
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.min("late").alias("late"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    brief = stored(best(dealt.where("asks"), None))
    answered = stored(brief.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("late").alias("late")).where((F.col("n") == k) & (F.col("late") <= LATE * k)).select("query_id"))
    rest = dealt.where("asks").join(fitted(answered), F.col("vec_id") == F.col("query_id"), "left_anti")
    return brief.join(fitted(answered), "query_id", "left_semi").unionByName(best(rest, visits)).select("query_id", "rank", "vec_id", "score")


def op4_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
