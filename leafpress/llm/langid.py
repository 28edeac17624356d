"""Language identification (operator 2).

A word is a run of letters. Its script narrows the languages that may label it to those
whose training text uses that script; each candidate scores the word by the log
probabilities of its character 3- and 4-grams. Viterbi over a document's words, with a
penalty for each change of language, labels the spans of mixed-language text. The document's
language is the one that holds most letters.

Counts come from at most ``max_docs`` documents per language, chosen by a hash of their id;
the model has a fixed number of buckets, whatever the corpus.

Defined results: a text that is null, empty or without letters has no spans, language
``und`` and score 0. Words in a script that no language uses are open to all languages.
Ties go to the language with the larger total score, then the smaller name. With no training
rows every language is ``und``. Repeated rows are judged each, an empty table gives no rows, a text of any length is
judged whole. Columns of the input pass through whatever their names; those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.llm import textkernel as tk
from leafpress.llm.common import id_checksum, table, with_judgements

BITS = 16
BUCKETS = 1 << BITS
SWITCH = 8.0
UNSEEN = -12.0


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # (2 * BUCKETS, languages): 3-grams, then 4-grams
    scripts: np.ndarray  # (scripts, languages) bool


def _grams(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the 3-gram and 4-gram that end at each code point; 0 stands for a word's edge."""
    c = code.astype(np.uint32)
    one, two, three = (np.concatenate((np.zeros(k, np.uint32), c[:-k] if k < len(c) else c[:0]))[: len(c)] for k in (1, 2, 3))
    with np.errstate(over="ignore"):
        h = c * np.uint32(0x9E3779B1) + one * np.uint32(0x85EBCA77) + two * np.uint32(0xC2B2AE3D)
        g = h + three * np.uint32(0x27D4EB2F)
        h, g = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D), (g ^ (g >> np.uint32(15))) * np.uint32(0x297A2D39)
    return h >> np.uint32(32 - BITS), (g >> np.uint32(32 - BITS)) + np.uint32(BUCKETS)


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points with 0 outside words, letter kinds, word starts and ends."""
    raw = tk.codes(text)
    kind = tk.letter_table()[raw]
    starts, ends = tk.runs(kind > 0)
    return np.where(kind > 0, tk.lower_table()[raw], 0), kind, starts, ends


def _count(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    grams, scripts = np.zeros(2 * BUCKETS, np.int64), np.zeros(len(tk.SCRIPTS), np.int64)
    for text in texts:
        if text:
            code, kind, starts, ends = _words(text)
            # Positions inside words and the one after each word, so that its end counts.
            here = np.concatenate((np.flatnonzero(kind > 0), ends[ends < len(code)]))
            for g in _grams(code):
                grams += np.bincount(g[here], minlength=2 * BUCKETS)
            scripts += np.bincount(tk.script_table()[np.minimum(code[kind == 2], 0x3FFFF)], minlength=len(scripts))
    return grams, scripts


def fit(docs: DataFrame, where: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", max_docs: int = 1500, alpha: float = 0.05) -> Model:
    """Learns from rows that pass ``where`` and have a language; at most about ``max_docs`` per language."""
    rows = docs.where(where & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return Model([], np.zeros((2 * BUCKETS, 0), np.float32), np.zeros((len(tk.SCRIPTS), 0), bool))
    langs = sorted(sizes)
    share = F.element_at(F.create_map(*[F.lit(v) for s in langs for v in (s, min(1.0, max_docs / sizes[s]))]), F.col(lang_col))
    unit = F.pmod(F.xxhash64(F.lit("train"), id_col, text_col), F.lit(1 << 20)) / float(1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for batch in batches:
            for b, texts in tk.slices(batch, "_text"):
                by: dict[str, list] = {}
                for s, t in zip(b["_lang"].to_pylist(), texts):
                    by.setdefault(s, []).append(t)
                for s, some in by.items():
                    new = _count(some)
                    found[s] = [x + y for x, y in zip(found[s], new)] if s in found else list(new)
        for s, (grams, scripts) in found.items():
            nz, ns = np.flatnonzero(grams), np.flatnonzero(scripts)
            at = np.concatenate((nz, ns + 2 * BUCKETS))
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(np.concatenate((grams[nz], scripts[ns])))], ["lang", "at", "n"])

    total = rows.where(unit < share).select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    full = np.zeros((2 * BUCKETS + len(tk.SCRIPTS), len(langs)))
    full[total["at"].to_numpy(), total["lang"].map({s: k for k, s in enumerate(langs)}).to_numpy(dtype=int)] = total["n"].to_numpy()
    grams, scripts = full[: 2 * BUCKETS], full[2 * BUCKETS :]
    scores = np.empty_like(grams)
    for part in (slice(0, BUCKETS), slice(BUCKETS, None)):
        used = max(1, int((grams[part].sum(1) > 0).sum()))
        scores[part] = np.maximum(np.log((grams[part] + alpha) / (grams[part].sum(0) + alpha * used)), UNSEEN)
    return Model(langs, (scores / 2).astype(np.float32), scripts >= 0.01 * np.maximum(1, scripts.sum(0)))


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best language of each word; documents of counts[d] words lie one after the other in scores.

    All documents advance together, longest first, so each step is one vector operation.
    """
    n_lang = scores.shape[1]
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    live = len(counts) - np.searchsorted(np.sort(counts), np.arange(counts.max(initial=0)), "right")
    back = np.empty(scores.shape, np.int16)
    v = np.zeros((len(counts), n_lang), np.float64)
    own = np.arange(n_lang, dtype=np.int16)[None, :]
    for t, n in enumerate(live):
        at, cur = first[:n] + t, v[:n]
        best = cur.argmax(1)
        top = cur[np.arange(n), best][:, None] - penalty
        back[at] = np.where(top > cur, best[:, None].astype(np.int16), own)
        v[:n] = np.maximum(cur, top) + scores[at]
    label = np.empty(len(scores), np.int16)
    state = v.argmax(1).astype(np.int16)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        at = first[:n] + t
        label[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return label


def label_words(model: Model, texts: list[str], penalty: float = SWITCH) -> tuple:
    """Per word of all texts: document, start, end, letters, language; and per document its totals."""
    doc, lo, hi, letters, score = [], [], [], [], []
    for d, text in enumerate(texts):
        if not text:
            continue
        code, kind, starts, ends = _words(text)
        if not len(starts):
            continue
        g3, g4 = _grams(code)
        each = model.scores[g3]
        each += model.scores[g4]
        # A word owns its letters and the position after it.
        if ends[-1] == len(code):
            each = np.vstack((each, np.zeros((1, each.shape[1]), np.float32)))
        edges = np.column_stack((starts, ends + 1)).ravel()
        summed = np.add.reduceat(each, np.minimum(edges, len(each) - 1), axis=0)[::2]
        if edges[-1] >= len(each):
            summed[-1] = each[starts[-1] :].sum(0)
        ok = model.scripts[tk.script_table()[code[starts]]]
        summed = np.where(ok | ~ok.any(1, keepdims=True), summed, summed.min() - 50.0)
        doc.append(np.full(len(starts), d))
        lo.append(starts)
        hi.append(ends)
        before = np.concatenate(([0], np.cumsum(kind == 2)))
        letters.append(before[ends] - before[starts])
        score.append(summed)
    if not doc:
        return (np.zeros(0, int),) * 5 + (np.zeros((len(texts), max(1, len(model.langs)))),) * 2
    doc, lo, hi, letters, score = map(np.concatenate, (doc, lo, hi, letters, score))
    counts = np.bincount(doc, minlength=len(texts))
    label = viterbi(score, counts, penalty)
    n, width = len(texts), len(model.langs)
    held = np.bincount(doc * width + label, letters, n * width).reshape(n, width)
    total = np.column_stack([np.bincount(doc, score[:, k], n) for k in range(width)])
    return doc, lo, hi, letters, label, held, total


#: Bytes of text that are labelled at a time: Viterbi takes a step for all documents of a slice together.
SLICE = 1 << 20


def identify(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = SWITCH, with_spans: bool = True, keep: Sequence[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) plus lang_pred, lang_score, n_spans and lang_spans (start, end,
    lang; null unless with_spans)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    results = "lang_pred string, lang_score double, n_spans int, lang_spans array<struct<start:int,end:int,lang:string>>"
    return with_judgements(docs, docs.columns if keep is None else keep, text_col, lambda: partial(_judged, shared.value, penalty=penalty, with_spans=with_spans), results, SLICE)


def _judged(m: Model, texts: list, *, penalty: float, with_spans: bool) -> list[pa.Array]:
    """Language, certainty, number of spans and spans of each text."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    size = len(texts)
    lang, sure, spans_n, spans = ["und"] * size, [0.0] * size, [0] * size, [[] for _ in texts]
    if m.langs:
        doc, lo, hi, _, label, held, total = label_words(m, texts, penalty)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
        spans_n = np.bincount(doc[new], minlength=size).tolist()
        letters = held.sum(1)
        rank = held + 1e-9 * (total - total.min(1, keepdims=True)) / (1 + np.abs(total).max(1, keepdims=True))
        best = rank.argmax(1)
        for d in np.flatnonzero(letters):
            lang[d], sure[d] = m.langs[best[d]], float(held[d, best[d]] / letters[d])
        if with_spans:
            at = np.flatnonzero(new)
            stop = hi[np.concatenate((at[1:], [len(doc)]))[: len(at)] - 1] if len(at) else hi[:0]
            for d, i, z, k in zip(doc[at], lo[at], stop, label[at]):
                spans[d].append({"start": int(i), "end": int(z), "lang": m.langs[k]})
    return [pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(spans_n, pa.int32()), pa.array(spans if with_spans else [None] * size, kind)]


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(id_checksum(), F.lit(5)) == 0, F.lit(False))
    model = fit(docs, ~held_out)
    fed = docs.select("doc_id", held_out.alias("held_out"), "text")
    out = identify(fed, model, with_spans=False, keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "n_spans")
