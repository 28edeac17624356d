"""Toxicity (operator 8): a subsequence string-kernel SVM with Nystroem landmarks.

The kernel compares two tokens by the three-letter subsequences they share, each weighted by
``DECAY`` to the power of its span, so inserted characters and gaps lower a match but don't
lose it. The letters of a subsequence lie within ``SPAN`` letters; a run of other characters inside a
token is one gap, which adds one to the span that is weighted, however long it is. Tokens are runs between
white space; single letters in a row are one token ("i d i o t"), whatever white space or tokens without
a letter stand between them. Landmarks are
tokens of the training sentences; the Nystroem map takes a token to its kernel values with
them, whitened by the landmarks' own kernel matrix, and a linear hinge-loss model is
fitted there by dual coordinate descent. Labels belong to documents: each round takes the highest
scoring tokens of toxic documents as the toxic ones; clean are tokens of clean documents, a bounded number at random
(``max_clean``) and the hardest of each document.

As the model is linear in kernel values with fixed landmarks, it is one weight per
three-letter subsequence: a document is scored exactly, on its whole text, by table look-ups. A
document's margin is that of its highest token; margins of documents left out of the fit
calibrate the score.

Defined results: null and empty texts, and texts without a token of three letters, get the
lowest score. Labels are read as in the quality classifier. With one class only, that
class is predicted; if no training text holds a token of three letters, every text gets the share of toxic ones. Repeated rows are scored each, an empty table gives no rows, a text of any length is scored
whole. Columns of the input pass through whatever their names; those named like a result are replaced.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.llm import textkernel as tk
from leafpress.llm.common import table, with_judgements
from leafpress.llm.linear import dual_coordinate_descent, logistic, sigmoid
from leafpress.llm.quality import held_out_mod, labelled

ORDER, SPAN, DECAY = 3, 9, 0.6
#: Symbol 0 is a gap, 1 to 26 the letters a to z, 27 to 59 those of U+00DF to U+00FF, 60 to 63 other letters.
BITS = 6
SYMBOLS = 1 << BITS
#: Digits and signs often written for a letter.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
PATTERNS = tuple((a, b) for a, b in combinations(range(1, SPAN), 2))
MAX_ROWS, MAX_TRAIN_CHARS, LANDMARKS = 1500, 20_000, 96


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    out = np.zeros(0x40000, np.uint8)
    for i in range(0x40000):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            base = unicodedata.normalize("NFKD", chr(low))[0]
            if 0xDF <= low <= 0xFF:
                out[i] = low - 0xDF + 27
            else:
                out[i] = ord(base) - 96 if "a" <= base <= "z" else 60 + i % 4
    for sign, letter in LOOKALIKES.items():
        out[ord(sign)] = ord(letter) - 96
    return out


def tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the text, and starts and ends of its tokens that have a letter."""
    raw = tk.codes(text)
    starts, ends = tk.runs(~tk.space_table()[raw])
    sym = symbol_table()[raw]
    letters = np.concatenate(([0], np.cumsum(sym > 0)))
    some = letters[ends] > letters[starts]
    starts, ends = starts[some], ends[some]
    if len(starts) > 1:
        single = (ends - starts) == 1
        glued = single[1:] & single[:-1]
        starts, ends = starts[np.concatenate(([True], ~glued))], ends[np.concatenate((~glued, [True]))]
    return sym, starts, ends


def subsequences(token: str | bytes) -> Counter:
    """Weight of each three-letter subsequence within SPAN; bytes are symbols already."""
    s = list(token) if isinstance(token, bytes) else symbol_table()[tk.codes(token)].tolist()
    at = [i for i, x in enumerate(s) if x]
    place = [i + k for i, k in enumerate(accumulate(int(k > 0 and at[k] - at[k - 1] > 1) for k in range(len(at))))]
    found: Counter = Counter()
    for i in range(len(at)):
        for a, b in PATTERNS:
            if i + b < len(at):
                found[(s[at[i]] * SYMBOLS + s[at[i + a]]) * SYMBOLS + s[at[i + b]]] += DECAY ** (place[i + b] - place[i] + 1)
    return found


def _norm(token: bytes) -> float:
    return float(np.sqrt(sum(v * v for v in subsequences(token).values()) or 1.0))


_kept_norm = lru_cache(maxsize=1 << 17)(_norm)


def norm(token: bytes) -> float:
    """Root of a token's kernel value with itself. Those of short tokens are kept, 8 MB at most; long ones hardly come again."""
    return _kept_norm(token) if len(token) <= 64 else _norm(token)


def bounds(weights: np.ndarray, text: str) -> tuple:
    """Of each token with three letters or more: kernel sum, lower bound of its norm, start, end; and all symbols."""
    sym, starts, ends = tokens(text)
    letters = np.concatenate(([0], np.cumsum(sym > 0)))
    ok = letters[ends] - letters[starts] >= ORDER
    starts, ends = starts[ok], ends[ok]
    if not len(starts):
        return np.zeros(0), np.zeros(0), starts, ends, sym
    # Letters alone, with their token and their place, where a run of other characters counts as one.
    first, last = letters[starts], letters[ends]
    at = np.flatnonzero(sym)
    n = len(at)
    token = np.full(n + SPAN, -1, np.int32)
    size = last - first
    token[np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.repeat(np.arange(len(starts), dtype=np.int32), size)
    place = np.arange(n + SPAN, dtype=np.int32)
    place[:n] += np.cumsum(np.diff(at, prepend=at[:1]) > 1)
    s = np.concatenate((sym[at], np.zeros(SPAN, np.uint8))).astype(np.int32)
    decay = DECAY ** np.arange(2 * SPAN, dtype=np.float32)
    total, square = np.zeros(n, np.float32), np.zeros(n, np.float32)
    i = np.flatnonzero(token[:n] >= 0)
    for b in range(2, SPAN):
        i = i[token[i + b] == token[i]]  # first letters whose token reaches b letters on; fewer for each b
        ends_ = (s[i] << 2 * BITS) + s[i + b]
        inner = np.zeros(len(i), np.float32)
        for a in range(1, b):
            inner += weights[ends_ + (s[i + a] << BITS)]
        weight = decay[np.minimum(place[i + b] - place[i] + 1, 2 * SPAN - 1)]
        total[i] += inner * weight
        square[i] += (b - 1) * weight * weight
    summed = [np.concatenate(([0.0], np.cumsum(x, dtype=np.float64))) for x in (total, square)]
    sums, squares = (x[last] - x[first] for x in summed)
    return sums, np.sqrt(np.maximum(squares, 1e-9)), starts, ends, sym


def worst(weights: np.ndarray, text: str | None) -> tuple[float, float, int, int]:
    """The two highest normalised kernel margins of tokens, at least 0, and where the highest is.

    A token's norm is at least the norm of its subsequences taken as different, so the
    quick bound falls from token to token and the search ends once it is below the second.
    """
    first, second, at = 0.0, 0.0, -1
    if text:
        sums, low, starts, ends, sym = bounds(weights, text)
        high = sums / low if len(sums) else sums
        for i in np.argsort(-high, kind="stable"):
            if high[i] <= second:
                break
            exact = float(sums[i]) / norm(sym[starts[i] : ends[i]].tobytes())
            if exact > first:
                first, second, at = exact, first, int(i)
            elif exact > second:
                second = exact
    return first, second, int(starts[at]) if at >= 0 else -1, int(ends[at]) if at >= 0 else -1


@dataclass
class Model:
    weights: np.ndarray  # one per three-letter subsequence; 0 where a letter is a gap
    a: np.ndarray  # of the two highest margins
    b: float

    def score_of(self, first: float, second: float) -> float:
        return float(sigmoid(np.float64(self.a[0] * first + self.a[1] * second + self.b)))


def _token_set(text: str) -> set[str]:
    _, starts, ends = tokens(text)
    return {text[a:b].lower() for a, b in zip(starts, ends)}


def _vectors(found: list[Counter], landmarks: list[Counter]) -> np.ndarray:
    """Normalised kernel values of tokens with landmarks, through explicit sparse products."""
    at = {u: k for k, u in enumerate(sorted({u for c in landmarks for u in c}))}
    dense = np.zeros((len(at), len(landmarks)))
    for m, c in enumerate(landmarks):
        size = np.sqrt(sum(v * v for v in c.values()))
        for u, v in c.items():
            dense[at[u], m] = v / size
    out = np.zeros((len(found), len(landmarks)))
    for i, c in enumerate(found):
        ids = [at[u] for u in c if u in at]
        if ids:
            out[i] = np.array([v for u, v in c.items() if u in at]) @ dense[ids]
    return out


def train(texts: list[str], y: np.ndarray, landmarks: int = LANDMARKS, rounds: int = 3, cost: float = 2.0, seed: int = 5, max_candidates: int = 400, max_clean: int = 6000, seeds_each: int = 2) -> Model:
    """The model of labelled texts.

    max_candidates: telling tokens that are tried as landmarks. max_clean: clean tokens, at random, that the first fit
    takes; the hardest token of every clean document joins them each round, whether drawn or not. seeds_each: tokens of a toxic
    document that it starts with. A token that a clean document holds isn't evidence against a toxic one.
    """
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(SYMBOLS**ORDER, np.float32), np.zeros(2), -30.0 if not len(y) or not y[0] else 30.0)
    rng = np.random.default_rng(seed)
    fold = np.arange(len(y)) % 4 == 0  # calibrates, takes no part in the fit
    each = [_token_set(t) for t in texts]
    n = [max(1, int(((y == k) & ~fold).sum())) for k in (0, 1)]
    seen = [Counter(), Counter()]
    for words, label, out in zip(each, y, fold):
        if not out:
            seen[int(label)].update(w for w in words if len(w) >= ORDER)
    odds = {w: np.log((c + 0.1) / n[1]) - np.log((seen[0][w] + 0.1) / n[0]) for w, c in seen[1].items()}
    ranked = sorted((w for w in odds if seen[1][w] >= 2) or odds, key=lambda w: (-odds[w] * min(seen[1][w], 20), w))
    # Landmarks: the most telling tokens that aren't near an earlier one, then clean ones at random.
    chosen: list[str] = []
    kept: list[Counter] = []
    for w in ranked[:max_candidates]:
        c = subsequences(w)
        if c and (not kept or _vectors([c], kept).max() / np.sqrt(sum(v * v for v in c.values())) < 0.85):
            chosen.append(w)
            kept.append(c)
        if len(chosen) == landmarks // 2:
            break
    clean = sorted(w for w in seen[0] if len(w) > ORDER)
    pool = [clean[i] for i in rng.permutation(len(clean))]
    for w in pool[: landmarks - len(chosen)]:
        if c := subsequences(w):
            kept.append(c)
    if not kept:  # no training text holds a token
        share = float(np.mean(y))
        return Model(np.zeros(SYMBOLS**ORDER, np.float32), np.zeros(2), float(np.log(share / (1 - share))))
    k_mm = _vectors(kept, kept) / np.sqrt([sum(v * v for v in c.values()) for c in kept])[:, None]
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    good = values > 1e-6
    whiten = vectors[:, good] / np.sqrt(values[good])

    cache: dict[str, np.ndarray] = {}

    def mapped(words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in cache]
        if new:
            z = (_vectors([subsequences(w) for w in new], kept) / np.array([norm(symbol_table()[tk.codes(w)].tobytes()) for w in new])[:, None]) @ whiten
            cache.update(zip(new, np.column_stack((z, np.ones(len(new))))))
        return np.array([cache[w] for w in words])

    negatives = set(pool[:max_clean])
    positives = {w for words, label, out in zip(each, y, fold) if label and not out for w in sorted(words, key=lambda w: (-odds.get(w, 0) * min(seen[1][w], 20), w))[:seeds_each] if odds.get(w, 0) > 2}
    table_ = np.zeros(SYMBOLS**ORDER, np.float32)
    bias = 0.0
    for _ in range(rounds):
        words = [*sorted(positives), *sorted(negatives - positives)]
        label = np.array([1.0] * len(positives) + [-1.0] * (len(words) - len(positives)))
        share = np.where(label > 0, len(words) / (2 * max(1, len(positives))), len(words) / (2 * max(1, len(words) - len(positives))))
        x = mapped(words)
        every = np.arange(x.shape[1])
        w = dual_coordinate_descent([(every, v) for v in x], label, x.shape[1], cost * share)
        beta, bias = whiten @ w[:-1], float(w[-1])
        table_[:] = 0
        for b, c in zip(beta, kept):
            size = np.sqrt(sum(v * v for v in c.values()))
            for u, v in c.items():
                table_[u] += b * v / size
        # Witness sentences of the next round: the highest tokens of toxic documents; of clean ones the hardest.
        for text, label_, out in zip(texts, y, fold):
            if out:
                continue
            top, _, i, j = worst(table_, text)
            word = text[i:j].lower()
            if label_ and top + bias > 0 and odds.get(word, 0) > 1:
                positives.add(word)
            elif not label_ and i >= 0:
                negatives.add(word)
        positives -= {w for w in positives if seen[0][w]}
    model = Model(table_.copy(), np.zeros(2), 0.0)
    held = [i for i in range(len(y)) if fold[i]]
    model.a, model.b = logistic(np.array([worst(model.weights, texts[i])[:2] for i in held]), y[held])
    return model


def fit(docs: DataFrame, labels: DataFrame, where: Column, label: str = "toxic", max_rows: int = MAX_ROWS, max_chars: int = MAX_TRAIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from at most max_rows labelled documents of each class, of at most max_chars characters."""
    chosen = labelled(labels, label, where, max_rows, id_col)  # at most 2 * max_rows ids, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.char_length("_text") <= max_chars).join(F.broadcast(chosen.withColumnRenamed(id_col, "_id")), "_id")
    found = rows.groupBy("_id", "y").agg(F.min("_text").alias("t")).toPandas().sort_values("_id")
    order = np.random.default_rng(3).permutation(len(found))
    return train([found["t"].iloc[i] for i in order], found["y"].to_numpy()[order])


def score_toxicity(docs: DataFrame, model: Model, keep: Sequence[str] | None = None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs (or its columns ``keep``) plus score (0 to 1), predicted, and the start and end of its worst token."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def judge(texts: list) -> list[pa.Array]:
            out = []
            for t in texts:
                first, second, i, j = worst(m.weights, t)
                s = m.score_of(first, second)
                out.append((s, int(s >= threshold), i if i >= 0 else None, j if i >= 0 else None))
            return [pa.array(c, k) for c, k in zip(zip(*out), (pa.float64(), pa.int32(), pa.int32(), pa.int32()))]

        return judge

    return with_judgements(docs, docs.columns if keep is None else keep, text_col, make, "score double, predicted int, worst_start int, worst_end int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out_mod(4, 2))
    return score_toxicity(docs.withColumn("held_out", held_out_mod(4, 2)), model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "score", "predicted")
