"""Operators 1, 7, 9 and 10 against brute force."""

import base64
import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from leafpress.llm import bpe, fingerprint, line_dedup, mixing

HARD = ["", None, "a", "short", "x" * 500, "Ünïcödé 🎉 " * 40, "same text " * 30, "same text " * 30, "\n\n\n", "tab\tand\r\nline\x0b ", "The end. " * 900, "日本語の文章です。" * 60, "ab" * 3000]


def docs(spark, texts, **more):
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def winnow(t):
    k, w = fingerprint.K, fingerprint.WINDOW
    if not t:
        return []

    def h(s):
        x = [xxh64_intdigest(c.encode(), seed=42) >> 16 << 16 for c in ((s[: k // 2], s[k // 2 :]) if len(s) >= k else (s,))]
        v = (x[0] ^ (x[1] << k // 2 if len(x) > 1 else 0)) & (1 << 64) - 1
        return (v - (1 << 64) if v >> 63 else v) >> 16

    g = [h(t[i : i + k]) for i in range(len(t) - k + 1)] or [h(t)]
    out = []
    for s in range(max(1, len(g) - w + 1)):
        least = min(g[s : s + w])
        p = max(i for i, x in enumerate(g[s : s + w]) if x == least) + s
        if not out or out[-1][1] != p:
            out.append((least, p))
    return out


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return 1.0 if not a and not b else len(a & b) / max(1, len(a | b))


def test_winnowing_equals_brute_force(spark):
    texts = [*HARD, "".join(random.Random(1).choices("abc ", k=2100 + 43)), "".join(random.Random(2).choices("ab", k=5000))]
    got = {r.doc_id: r for r in fingerprint.compare_with_next(docs(spark, texts, bucket=1, n="clash", t=2)).collect()}
    prints = [winnow(t) for t in texts]
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert [(x.hash, x.pos) for x in r.fingerprint] == prints[i]
        assert [(x.hash, x.pos) for x in r.edited_fingerprint] == winnow(edited)
        assert r.near_edited == pytest.approx(likeness(prints[i], winnow(edited)))
        assert r.near_next == pytest.approx(likeness(prints[i], prints[(i + 1) % len(texts)]))


def test_winnowing_across_buckets_and_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 3)
    rows = [(None, "no id " * 20), (5, "five " * 30), (5, "five again " * 20), *[(10 + 7 * k, f"text number {k} " * (k % 5 * 9)) for k in range(40)]]
    got = fingerprint.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 5)}
    for k in range(39):
        t, nxt = f"text number {k} " * (k % 5 * 9), f"text number {k + 1} " * ((k + 1) % 5 * 9)
        q = len(t) // 4
        assert by[10 + 7 * k].edited_sha256 == hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()
    t = f"text number 39 " * 36
    assert by[10 + 7 * 39].edited_sha256 == hashlib.sha256((t[: len(t) * 3 // 4] + "no id " * 20)[: len(t) * 3 // 4 + min(len(t) // 4, 120)].encode()).hexdigest()
    assert fingerprint.compare_with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert fingerprint.compare_with_next(spark.createDataFrame([(1, "alone")], "doc_id long, text string")).first().near_next == 1.0


def test_op1_on_a_whole_table(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in fingerprint.op1_winnowing(spark, sf).collect()}
    assert len(got) == len(rows)
    digest = lambda f: hashlib.sha256(",".join(f"{x & (1 << 64) - 1:X}@{p}" for x, p in f).encode()).hexdigest()
    for (i, t), (_, nxt) in zip(rows[:60], rows[1:]):
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (digest(winnow(t)), digest(winnow(edited)))
        assert (r.near_edited, r.near_next) == (pytest.approx(likeness(winnow(t), winnow(edited))), pytest.approx(likeness(winnow(t), winnow(nxt))))


def test_bpe_equals_the_library(spark):
    import public_tokenizers as files
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(files.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = "a\U00010ee7a it's we'll 12³½ \x1c x y  \n \t end   "
    texts = [*HARD, odd, "don't" * 200, " " * 700, "a" * 900 + " b", "it 's " * 150]
    for size, overlap in ((bpe.CHUNK_CHARS, bpe.OVERLAP), (64, 16), (40, 7)):
        got = {r.doc_id: r for r in bpe.encode_documents(docs(spark, texts, ids=1, k="x"), chunk_chars=size, overlap=overlap).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            ids = own.encode_ordinary(t or "")
            assert list(got[i].ids) == ids and got[i].n_tokens == len(ids), (size, i)
            assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    none = spark.createDataFrame([(None, "x y"), (1 << 60, "long id " * 30)], "doc_id long, text string")
    assert {r.doc_id for r in bpe.encode_documents(none, chunk_chars=32, overlap=8).collect()} == {None, 1 << 60}


def cut_lines(rows, least=10):
    space, holders = " \t\n\x0b\x0c\r", defaultdict(set)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(space))
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def test_line_dedup_equals_brute_force(spark):
    hot = "This line is everywhere"
    rows = [(0, None), (1, ""), (2, f"{hot}\nown line of two\n{hot}"), (3, f"  {hot.upper()}\t\nÉCOLE ÉCOLE É\nshort\n\n"), (4, "école École É\nshort\nÉCOLE ÉCOLE É\r"), (5, hot), (6, "a\n" * 200 + hot)]
    rows += [(k, f"{hot}\nline {k % 9} of several\nunique {k}") for k in range(10, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"line": F.lit(1), "drop_words": F.lit("x"), "n_lines": F.lit(0)})
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df).collect()}
    assert got == cut_lines(rows)
    assert line_dedup.dedup_lines(df.where("false")).count() == 0
    twice = df.unionByName(df.where("doc_id in (5, 6)"))
    assert sorted(map(tuple, twice.transform(line_dedup.dedup_lines).where("doc_id = 5").select("n_dropped").collect())) == [(1,), (1,)]
    other = spark.createDataFrame([(1, f"{hot}\na"), (1, f"b\n{hot}"), (2, hot), (None, hot)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.kept_text) for r in line_dedup.dedup_lines(other).collect()) == [(0, ""), (1, f"{hot}\na"), (1, f"b\n{hot}"), (2, "")]


def test_line_dedup_equals_its_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(duckdb.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({line_dedup.ORACLE_SQL})").fetchall())
    assert sorted(map(tuple, line_dedup.op10_line_dedup(spark, sf).collect())) == want


def test_targets_share_everything_and_stop_at_the_cap():
    sizes = {"b": 100, "a": 10, None: 50, "c": 0, "z": 500}
    goal = mixing.targets(sizes)
    assert goal["a"] == 30 and goal["c"] == 0 and sum(goal.values()) == pytest.approx(660)
    assert all(goal[s] <= 3 * n + 1e-9 for s, n in sizes.items())
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(0)
    x, p = rng.integers(0, 900, 300).astype(float), np.full(300, 0.3)
    hits = np.zeros(300)
    for k in range(300):
        q = mixing.flight(p, x, np.random.default_rng(k).random(300))
        assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * x).sum() - (p * x).sum()) < 1e-5
        assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
        hits += q
    assert abs(hits / 300 - 0.3).max() < 0.12 and abs(hits.mean() / 300 - 0.3) < 1e-6


def test_mix_comes_near_its_targets_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    rng = random.Random(3)
    rows = [(k, " ".join("w" for _ in range(rng.randrange(0, 90))), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(900)]
    rows += [(k, None, "b") for k in range(3)] + [(7, "x y z", "c")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    one, two = (sorted(map(tuple, mixing.mix(d).select("doc_id", "source", "size", "dup", "copies", "target").collect()), key=str) for d in (df, df.repartition(7)))
    assert one == two and len(one) == len(rows)
    taken = defaultdict(int)
    goal = {}
    for _, s, size, _, copies, target in one:
        assert 0 <= copies <= 3
        taken[s] += size * copies
        goal[s] = target
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 0.005 * goal[s] + 3
    kept = mixing.mixing_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    assert kept.count() == sum(r[4] for r in one) and kept.columns == ["doc_id", "text", "source"]
    assert mixing.mix(df.where("false")).count() == 0


def test_hash_arrays_are_moved_on_without_slices(spark):
    # A slice of an array costs more than the comparison it serves.
    plan = spark.range(1).select(fingerprint.winnow("CAST(id AS STRING)"))._jdf.queryExecution().analyzed().toString()
    assert "zip_with" in plan and "slice(" not in plan


def test_minima_around_a_window_and_a_block(spark):
    fp = fingerprint
    sizes = [0, 1, fp.K - 1, fp.K, fp._REACH, fp._REACH + 1, fp._REACH + 2, fp.BLOCK, fp.BLOCK + fp._REACH, fp.BLOCK + fp._REACH + 1, 2 * fp.BLOCK + 1]
    texts = ["".join(chr(97 + (i * i * 7 + i // 3) % k) for i in range(n)) for n in sizes for k in (1, 2, 26)]
    runs = r"transform(sequence(0, greatest(0, char_length(t) - 12)), i -> substring(t, i + 1, 12))"
    half = "(xxhash64(substring(r, {}, 6)) & -65536L)"
    value = f"IF(char_length(r) < 12, xxhash64(r) & -65536L, {half.format(1)} ^ shiftleft({half.format(7)}, 6) & -65536L)"
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fp.winnow("t").alias("got"), F.expr(f"transform({runs}, r -> shiftright({value}, 16))").alias("all"))
    for r in rows.collect():
        n = len(r["all"])
        windows = [range(a, min(a + fp.WINDOW, n)) for a in range(max(1, n - fp.WINDOW + 1))]
        kept = sorted({min(w, key=lambda i: (r["all"][i], -i)) for w in windows}) if r.t else []
        assert [(x.hash, x.pos) for x in r.got] == [(r["all"][i], i) for i in kept], len(r.t)
