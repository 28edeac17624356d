"""Mixing sources to target weights (operator 9) by the cube method.

Each source has a target in words. Its documents all get the same expected number of
copies, target / source size: the whole part is taken outright and the fraction is an
inclusion probability that balanced sampling turns into 0 or 1. Balancing variables
are the document's size and the constant 1, so a sample keeps both the expected words
and the expected documents. The flight phase moves the probabilities of a few units at
a time along a null-space direction of their two constraints, with a random step whose
expectation is zero, until one of them reaches 0 or 1; at most two stay fractional.

Flights run in blocks of bounded size dealt by a hash of the row, so a source that
holds most rows is many blocks. What each block leaves (two units at most) flies again in
blocks of the next level, and so on until one block per source is left; only there the
landing problem is solved: over the flight's last units and a few of all sizes kept from
it, the rounding nearest to the words still due. Random numbers come from hashes, so reruns agree.

Defined results: a null text has size 0. A null source is a source of its own, last. A
source of size 0 has target 0. Rows that repeat an id are separate units. Targets stop at
3 times the source's size, so no document is taken more than 3 times. All sources at
their cap: the rest is not taken. An empty table gives no rows; a text of any length counts whole. Of the input only id,
text and source are read, so other columns' names can't clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafpress.llm.common import checkpoint, stored, table

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
BLOCK = 4096
#: Units beside the flight's last two over which the landing is solved, by trying every rounding.
LANDING = 10
_EPS = 1e-9


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> dict[str | None, float]:
    """Target words of each source, by repeating weights over sources in code-point order, null last.

    Together they share all words; a target above ``cap`` times its source stops there and the
    excess is shared again by weight among the rest until none is above.
    """
    order = [s for s in sorted((s for s in sizes if s is not None))] + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, free = float(sum(sizes.values())), {}, list(order)
    while free:
        left = total - sum(out.values())
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * share > cap * sizes[s]]
        if not over:
            return out | {s: weight[s] * share for s in free}
        out |= {s: cap * sizes[s] for s in over}
        free = [s for s in free if s not in over]
    return out


def flight(p: np.ndarray, x: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Inclusion probabilities after the flight phase over units in the given order.

    x: one balancing value per unit beside the constant 1. At most two results are
    fractional; sum(p) and sum(p*x) keep their values while three or more fly.
    """
    p = p.astype(float).copy()
    pending = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    flying, nxt, d = pending[:3], 3, 0
    while len(flying) == 3:
        a, b, c = flying
        # Null vector of [[1,1,1],[xa,xb,xc]].
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(flying, u) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(flying, u) if v)
        step = up if draws[d % len(draws)] * (up + down) < down else -down
        d += 1
        for i, v in zip(flying, u):
            p[i] = min(1.0, max(0.0, p[i] + step * v))
        still = [i for i in flying if _EPS < p[i] < 1 - _EPS]
        for i in flying:
            if i not in still:
                p[i] = float(round(p[i]))
        while len(still) < 3 and nxt < len(pending):
            still.append(pending[nxt])
            nxt += 1
        flying = still
    return p


def landing(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Round the few fractional units so that the words come nearest, then the documents."""
    left = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    picks = np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1
    words, documents = abs((picks - p[left]) @ x[left]), abs((picks - p[left]).sum(1))
    out = p.copy()
    out[left] = picks[np.lexsort((documents, words))[0]]
    return np.round(out)


def held_back(p: np.ndarray, n: int = LANDING) -> np.ndarray:
    """n fractional units spread over the given order, kept from the last flight for the landing."""
    pending = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    return pending[np.unique(np.linspace(0, len(pending) - 1, min(n, len(pending))).astype(int))] if len(pending) else pending


def _draws(seed: int, key: str, n: int) -> np.ndarray:
    digest = hashlib.blake2b(f"{seed}/{key}".encode(), digest_size=8).digest()
    return np.random.default_rng(int.from_bytes(digest, "little")).random(n)


def cube_sample(units: DataFrame, largest: int, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """units with every p turned into 0 or 1.

    Needs columns stratum, of (units in the stratum, at most ``largest``), h (a hash that orders and
    deals units), x (the balancing value) and p. Other columns pass.
    """
    schema = units.schema

    def fly(last: bool, level: int):
        def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            # Largest first: the units still fractional at the end are small, and so is the landing error.
            g = g.sort_values(["x", "h"], ascending=[False, True], kind="stable")
            p, x = g["p"].to_numpy(), g["x"].to_numpy()
            draws = _draws(seed, f"{level}/{key}", max(1, len(g)))
            if not last:
                return g.assign(p=flight(p, x, draws))[schema.names]
            flies = np.ones(len(g), bool)
            flies[held_back(p)] = False
            p = p.copy()
            p[flies] = flight(p[flies], x[flies], draws)
            return g.assign(p=landing(p, x))[schema.names]

        return run

    # As many even blocks as a stratum's units need; each leaves two units at most for the next level.
    blocks, most = F.ceil(F.col("of") / block), math.ceil(largest / block)
    done: DataFrame | None = None
    level = 0
    while True:
        last = most <= 1
        dealt = units.withColumn("_b", F.pmod(F.xxhash64("h", F.lit(level)), F.greatest(F.lit(1), blocks)))
        flown = dealt.groupBy("stratum", "_b").applyInPandas(fly(last, level), schema)
        if last:
            return flown if done is None else done.unionByName(flown)
        flown = checkpoint(flown)
        settled = (F.col("p") <= _EPS) | (F.col("p") >= 1 - _EPS)
        done = flown.where(settled) if done is None else done.unionByName(flown.where(settled))
        units = flown.where(~settled)
        blocks, most = F.ceil(2 * blocks / block), math.ceil(2 * most / block)
        level += 1


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = 42) -> DataFrame:
    """(id, source, size, source_size, target, copies, dup) for each row of docs.

    dup numbers rows that agree in id, source and size, from 0; such rows are interchangeable.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    slim = checkpoint(slim.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")))
    sums = slim.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("size"), F.sum("rows").alias("of")).collect()
    units_of = {r["source"]: int(r["of"]) for r in sums}
    sizes = {r["source"]: int(r["size"]) for r in sums}
    goal = targets(sizes, weights, cap)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    spark = docs.sparkSession
    facts = spark.createDataFrame(
        [(s, k, units_of[s], sizes[s], float(goal[s]), float(goal[s]) / sizes[s] if sizes[s] else 0.0) for k, s in enumerate(order)],
        "source string, stratum int, of long, source_size long, target double, rate double",
    )
    units = (
        slim.withColumn("dup", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
        .join(F.broadcast(facts) if len(order) <= 10_000 else facts, slim["source"].eqNullSafe(facts["source"]))
        .select("doc_id", slim["source"], "size", "source_size", "target", "dup", "stratum", "of", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"))
        .withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size", "dup"))
        .withColumn("x", F.col("size").cast("double"))
    )
    return cube_sample(units, max(units_of.values(), default=0), seed).withColumn("copies", (F.col("whole") + F.col("p")).cast("long")).drop("whole", "p", "h", "x", "stratum", "of")


def op9_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or repeated.

    Edges as in ``mix``: a null text has no words and a null source is its own; a document that repeats another's id,
    source and size is a unit of its own, taken as often as its number says (numbers are dealt by a hash of the row). An
    empty table stays empty. Columns pass through whatever their names.
    """
    units = stored(mix(docs).select(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_z"), "dup", "copies"))
    # Units that repeat id, source and size are told apart by their number; all others are found without one.
    several = units.where("dup > 0").select("_i", "_s", "_z").distinct()
    same = lambda a, b: a["_i"].eqNullSafe(b["_i"]) & a["_s"].eqNullSafe(b["_s"]) & (a["_z"] == b["_z"])
    names = docs.columns
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col("doc_id").alias("_d"), F.col("source").alias("_o"), word_count(F.col("text")).alias("_w"))
    match = lambda: F.col("_d").eqNullSafe(F.col("_i")) & F.col("_o").eqNullSafe(F.col("_s")) & (F.col("_w") == F.col("_z"))
    several = stored(several)
    if several.isEmpty():
        out = own.join(units.where("copies > 0").select("_i", "_s", "_z", "copies").hint("shuffle_hash"), match()).select("_row", "copies")
    else:
        alone = units.join(several, same(units, several), "left_anti").where("copies > 0").select("_i", "_s", "_z", "copies")
        out = own.join(alone.hint("shuffle_hash"), match()).select("_row", "copies")
        numbered = own.join(several.hint("shuffle_hash"), match(), "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("_d", "_o", "_w").orderBy(F.xxhash64("_row"))) - 1)
        out = out.unionByName(numbered.join(units.where("copies > 0"), match() & (F.col("_n") == F.col("dup"))).select("_row", "copies"))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*(F.col("_row").getField(c).alias(c) for c in names))
