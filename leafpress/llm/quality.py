"""Quality classifier (operator 3): naive Bayes support vectors.

Features are indicators of n-grams: 1- to 3-grams of characters (letters folded to their
case class, so marks, spacing and layout remain) and 1- to 3-grams of word shapes (case, length, the
mark a word ends with, whether it repeats the word before). Each indicator is scaled by the log
ratio of its smoothed counts in the two classes, and a linear hinge-loss model is fitted on the
scaled indicators by dual coordinate descent. Margins of models fitted without a fold calibrate
the score.

Training reads at most ``max_rows`` labelled documents of each class, chosen by a hash of
the id, so the driver holds a bounded sample. Every document is scored on its whole text.

Defined results: null and empty texts have no n-grams and get the score of the intercept.
Several labels for one id count as their maximum; a null label or id as none; an id with several texts
trains on the smallest. With labels of one class only, that class is predicted. Repeated rows are
scored each, an empty table gives no rows, a text of any length is read whole. Columns of the input pass through
whatever their names; those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.llm import textkernel as tk
from leafpress.llm.common import id_checksum, table, with_judgements
from leafpress.llm.linear import dual_coordinate_descent, platt, sigmoid

DIM = 1 << 18
_HALF = DIM >> 1
MAX_ROWS = 2500


def _hash(parts: Sequence[np.ndarray], salt: int) -> np.ndarray:
    h = np.full(len(parts[0]), salt, np.uint32)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ p.astype(np.uint32)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
    return h & np.uint32(_HALF - 1)


def features(text: str | None, mark: np.ndarray) -> np.ndarray:
    """Sorted ids of the n-grams that occur in the text. mark: a reusable bool array of DIM, all False."""
    if not text:
        return np.zeros(0, np.int32)
    raw = tk.codes(text)
    case = tk.case_table()[raw]
    folded = np.where(case > 0, case, raw).astype(np.uint32)
    for n in (1, 2, 3):
        if len(folded) >= n:
            mark[_hash([folded[k : len(folded) - n + 1 + k] for k in range(n)], n)] = True
    starts, ends = tk.runs(~tk.space_table()[raw])
    if len(starts):
        sums = [np.concatenate(([0], np.cumsum(case == k))) for k in (1, 2, 3)]
        upper, lower, digit = ((s[ends] - s[starts]) for s in sums)
        size = ends - starts
        tail = raw[ends - 1]
        tail = np.where(case[ends - 1] > 0, 0, tail)
        same = np.zeros(len(starts), np.uint32)
        words = tk.word_hashes(tk.lower_table()[raw], starts, ends)
        same[1:] = words[1:] == words[:-1]
        kind = (upper > 0) + 2 * (lower > 0) + 4 * (digit > 0) + 8 * (upper > 1)
        shape = (tail * 16 + kind) * 2 + same
        wide = shape * 8 + np.minimum(7, np.log2(size + 1).astype(np.uint32))
        mark[_HALF + _hash([wide], 11)] = True
        for n in (1, 2, 3):
            if len(shape) >= n:
                mark[_HALF + _hash([shape[k : len(shape) - n + 1 + k] for k in range(n)], 20 + n)] = True
    ids = np.flatnonzero(mark).astype(np.int32)
    mark[ids] = False
    return ids


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    a: float
    b: float

    def score(self, ids: np.ndarray) -> float:
        return float(sigmoid(np.float64(self.a * (self.weights[ids].sum() + self.bias) + self.b)))


def _nbsvm(rows: list[np.ndarray], y: np.ndarray, cost: float, beta: float, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights on plain indicators and intercept."""
    counts = np.full((2, DIM), alpha)
    for ids, label in zip(rows, y):
        counts[int(label)][ids] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[(counts == alpha).all(0)] = 0.0
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    # One more id for the intercept.
    data = [(np.append(ids, DIM), np.append(ratio[ids], 1.0)) for ids in rows]
    data = [(i, v / max(1e-9, np.sqrt(v @ v))) for i, v in data]
    w = dual_coordinate_descent(data, sign, DIM + 1, cost * share)
    plain = w[:DIM]
    # Interpolate with the mean weight, which keeps naive Bayes' evidence from all n-grams.
    mean = np.abs(plain).sum() / max(1, (ratio != 0).sum())
    return ratio * ((1 - beta) * mean + beta * plain), float(w[DIM])


def _margins(weights: np.ndarray, bias: float, rows: list[np.ndarray]) -> np.ndarray:
    return np.array([weights[ids].sum() + bias for ids in rows])


def train(rows: list[np.ndarray], y: np.ndarray, cost: float = 4.0, beta: float = 0.9, folds: int = 3) -> Model:
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(DIM), 0.0, 0.0, 0.0 if not len(y) else 30.0 if y[0] else -30.0)
    margins = np.zeros(len(y))
    for k in range(folds):
        out = np.arange(len(y)) % folds == k
        if len(set(y[~out].tolist())) < 2:
            continue
        w, b = _nbsvm([r for r, o in zip(rows, out) if not o], y[~out], cost, beta)
        margins[out] = _margins(w, b, [r for r, o in zip(rows, out) if o])
    w, b = _nbsvm(rows, y, cost, beta)
    return Model(w, b, *platt(margins, y))


def labelled(labels: DataFrame, label: str, where: Column, max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, y) of at most max_rows labelled ids of each class, those with the smallest hash."""
    one = labels.where(where & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    return one.where("y = 1").orderBy(F.xxhash64(id_col), id_col).limit(max_rows).unionByName(one.where("y = 0").orderBy(F.xxhash64(id_col), id_col).limit(max_rows))


def fit(docs: DataFrame, labels: DataFrame, label: str, where: Column, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """``where`` chooses the labels' rows that may be learned from."""
    chosen = labelled(labels, label, where, max_rows, id_col)  # at most 2 * max_rows ids, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen.withColumnRenamed(id_col, "_id")), "_id").groupBy("_id", "y").agg(F.min("_text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(DIM, bool)
        for batch in batches:
            for b, some in tk.slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays([b["_id"], b["y"], pa.array([features(t, mark).tobytes() for t in some], pa.binary())], ["doc_id", "y", "ids"])

    found = texts.select(F.col("_id").cast("long").alias("_id"), "y", "_text").mapInArrow(run, "doc_id long, y int, ids binary").toPandas().sort_values("doc_id")
    rows = [np.frombuffer(x, np.int32) for x in found["ids"]]
    order = np.random.default_rng(3).permutation(len(rows))
    return train([rows[i] for i in order], found["y"].to_numpy()[order])


def classify(docs: DataFrame, model: Model, keep: Sequence[str] | None = None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs (or its columns ``keep``) plus score (0 to 1) and predicted (1 if score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m, mark = shared.value, np.zeros(DIM, bool)

        def judge(texts: list) -> list[pa.Array]:
            score = [m.score(features(t, mark)) for t in texts]
            return [pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())]

        return judge

    return with_judgements(docs, docs.columns if keep is None else keep, text_col, make, "score double, predicted int")


def held_out_mod(modulus: int, rest: int) -> Column:
    return F.coalesce(F.pmod(id_checksum(), F.lit(modulus)) == rest, F.lit(False))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = fit(docs, labels, "quality", ~held_out_mod(3, 1))
    return classify(docs.withColumn("held_out", held_out_mod(3, 1)), model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "score", "predicted")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; it learns from the stage's own input.

    Edges as in the classifier: null and empty texts are judged by the intercept, repeated rows each, a null id is never
    learned from, an empty table stays empty. All columns pass through unchanged, also one named score or predicted.
    """
    labels = table(spark, sf_dir, "labels")
    model = fit(docs, labels, "quality", ~held_out_mod(3, 1))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "text")
    kept = classify(row, model).where("predicted = 1")
    return kept.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
