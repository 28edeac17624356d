"""MinHash near-dedup (operator 5): BagMinHash signatures, banding, exact verification.

A document is the multiset of its five-word shingles (lower-cased runs of letters and
digits; a shorter text is one shingle). Each shingle owns Poisson processes over dyadic
weight intervals [0,1), [1,2), [2,4), ...; a point carries a time, a component and a weight
level, and counts for a document whose weight for the shingle exceeds the level. The first
counting point of each component is the signature, so two signatures agree in a component with
probability sum(min)/sum(max) of the weights: the weighted Jaccard similarity, without bias.
Points come in order of time and a document stops once all its components hold earlier ones.

Signatures are banded; in each bucket every document is checked against the bucket's leader, the one
that meets most others, on the full multisets. Shingles that only one class holds can't be shared: their weight
bounds a class's similarity to any other from above, exactly, and pairs that can't reach the threshold aren't made.

A bucket whose other members are then of one component is done. What is left is divided again, by shingles: two
multisets with the threshold's similarity share one of the rarest shingles that make up a fifth of the larger, or a ninth
of the smaller. Groups are therefore those of one rare shingle, and only pairs are made that have enough weight from it
on. Texts that share boilerplate but no rare shingle never meet. In these groups 4, 64, 1024, ... leaders meet the
others, until those that haven't led are of one component. Pairs that links have joined already are not verified, and
no pair twice; every other pair that shares a bucket is, so no link between components is lost. Texts with equal multisets are
one class and are searched once. Components of the links are found by alternating star contraction.

Hot groups: classes and leaders come from partial aggregates; joins by bucket, leader, node, root and
class stand alone above their shuffles, so adaptive execution splits their large partitions.

Defined results: texts without a word have no shingles; they are of one class only if their
text, stripped, is equal and not empty. Null, empty and blank texts are never duplicates. Repeated rows
with one id and text share a class; one id may hold several texts, each of its own class. A null id takes part; a
class takes the smallest id that isn't null. An empty table gives no rows. A text of any length is read whole, in
slices of its shingles. Of the input only id and text are read, so no other column's name can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafpress.llm import textkernel as tk
from leafpress.llm.common import BROADCAST_ROWS, Workspace, fitted, stored, table

SHINGLE = 5
SIMILAR = 0.8
#: At a similarity of 0.8 a pair shares a band with probability 0.99997, at 0.4 with 0.24.
BANDS, ROWS = 26, 5
COMPONENTS = BANDS * ROWS
#: Shingles whose points are made at a time.
_SEEDS = 1 << 15
#: Bounds on sums of similarities are kept wider by this.
_ROUNDING = 1e-9

U = np.uint64


def shingles(text: str | None, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and their counts."""
    if not text:
        return np.zeros(0, U), np.zeros(0, np.int64)
    raw = tk.codes(text)
    starts, ends = tk.runs(tk.word_table()[raw])
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64)
    w = tk.word_hashes(tk.lower_table()[raw], starts, ends)
    with np.errstate(over="ignore"):
        n = max(1, len(w) - width + 1)
        total = np.full(n, min(width, len(w)), U)
        for k in range(min(width, len(w))):
            total = (total ^ w[k : k + n]) * U(0x9E3779B97F4A7C15)
            total ^= total >> U(29)
    return np.unique(tk.mix64(total), return_counts=True)


def class_key(text: str | None, hashes: np.ndarray, counts: np.ndarray) -> bytes | None:
    """16 bytes that are equal for equal multisets; of the stripped text if it has no word; None if blank."""
    if len(hashes):
        return hashlib.blake2b(hashes.tobytes() + counts.tobytes(), digest_size=16).digest()
    bare = (text or "").strip()
    return hashlib.blake2b(bare.encode("utf-8", "surrogatepass"), digest_size=16, key=b"no word").digest() if bare else None


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two multisets (hashes, counts)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    return low / (int(a[1].sum()) + int(b[1].sum()) - low)


def bag_min_hash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int = COMPONENTS) -> np.ndarray:
    """(n_docs, m) signatures of 32-bit values; documents without elements get zeros.

    doc, element, weight: one row per distinct shingle of a document, all documents together.
    """
    best = np.full(n_docs * m, np.inf)
    mark = np.zeros(n_docs * m, np.uint32)
    limit = np.full(n_docs, np.inf)
    # One process per element and dyadic interval that its weight reaches: 0 is [0,1), j is [2^(j-1), 2^j).
    reach = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    for at in range(0, len(element), _SEEDS):
        part = slice(at, at + _SEEDS)
        _first_points(doc[part], element[part], weight[part], reach[part], best, mark, limit, m)
    return mark.reshape(n_docs, m)


def _first_points(doc, element, weight, reach, best: np.ndarray, mark: np.ndarray, limit: np.ndarray, m: int) -> None:
    """Lowers best, the time of each component's first point, by these elements' points; mark names it, limit is each document's latest."""
    rows = np.repeat(np.arange(len(element)), reach)
    level = np.arange(len(rows)) - np.repeat(np.cumsum(reach) - reach, reach)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    length = np.maximum(low, 1)
    with np.errstate(over="ignore"):
        seed = tk.mix64(element[rows] + (level.astype(U) + U(1)) * U(0xD1B54A32D192ED03))
    d, w, rate = doc[rows], weight[rows], m * length.astype(float)
    time = np.zeros(len(rows))
    step = 0
    while len(seed):
        ahead = 1 if step < 2 else 8  # points made in one go
        with np.errstate(over="ignore"):
            r = tk.mix64(seed[:, None] + (np.arange(step, step + ahead, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15))
            q = tk.mix64(r ^ U(0xA5A5A5A5A5A5A5A5))
        gap = -np.log1p(-((r >> U(11)).astype(float) / (1 << 53))) / rate[:, None]
        times = time[:, None] + np.cumsum(gap, axis=1)
        component = ((q >> U(32)) * U(m) >> U(32)).astype(np.int64)
        at_level = low[:, None] + ((q & U(0xFFFFFFFF)).astype(float) / (1 << 32) * length[:, None]).astype(np.int64)
        hit = (at_level < w[:, None]) & (times < limit[d][:, None])
        key, when, name = (d[:, None] * m + component)[hit], times[hit], (r & U(0xFFFFFFFF)).astype(np.uint32)[hit]
        np.minimum.at(best, key, when)
        won = when == best[key]
        mark[key[won]] = name[won]
        time = times[:, -1]
        step += ahead
        limit[:] = best.reshape(len(limit), m).max(1)
        on = time < limit[d]
        seed, d, w, rate, time, low, length = (x[on] for x in (seed, d, w, rate, time, low, length))


def band_keys(marks: np.ndarray) -> np.ndarray:
    """(n_docs, BANDS) 64-bit bucket keys."""
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U) * U(0xD1B54A32D192ED03), (len(marks), BANDS)).copy()
        for k in range(ROWS):
            out = tk.mix64(out ^ marks[:, k::ROWS][:, :BANDS].astype(U)) * U(0x9E3779B97F4A7C15)
    return out.view(np.int64)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, r1, r2, _text): r1 and r2 tell apart texts under one id."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("r1"), F.xxhash64(F.lit("row"), text).alias("r2"), text.alias("_text"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, r1, r2 long, cls binary, bands array<long>) for each row; cls null for blank texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, texts in tk.slices(batch, "_text"):
                each = [shingles(t) for t in texts]
                keys = [class_key(t, *s) for t, s in zip(texts, each)]
                size = np.array([len(s[0]) for s in each])
                element, weight = (np.concatenate([s[k] for s in each]) for k in (0, 1))
                made = band_keys(bag_min_hash(np.repeat(np.arange(len(texts)), size), element, weight, len(texts)))
                bands = [k.tolist() if n else [] for k, n in zip(made, size)]
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["r1"], b["r2"], pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "r1", "r2", "cls", "bands"])

    return _slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, r1 long, r2 long, cls binary, bands array<long>")


def pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """A multiset as bytes: its hashes, then its counts."""
    return hashes.astype("<u8").tobytes() + counts.astype("<u4").tobytes()


def unpack(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(bag) // 12
    return np.frombuffer(bag, "<u8", n), np.frombuffer(bag, "<u4", n, 8 * n)


def _bags(docs: DataFrame, needed: DataFrame, few: bool, id_col: str, text_col: str) -> DataFrame:
    """(cls, size, bag), one row for each needed class (cls, rep and, if there, r1 and r2 of one of its rows). If they are few, texts stay where they are."""
    keys = [c for c in ("r1", "r2") if c in needed.columns]
    of = needed.select("cls", "rep", *(F.col(k).alias(f"n{k}") for k in keys))
    same = F.col("doc_id").eqNullSafe(F.col("rep"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"n{k}"))
    found = _slim(docs, id_col, text_col).join(F.broadcast(of) if few else of.hint("shuffle_hash"), same).select("cls", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One id may stand for several texts; only the class's own counts.
        for batch in batches:
            for b, texts in tk.slices(batch, "_text"):
                each = [shingles(t) for t in texts]
                ok = [class_key(t, *s) == k for k, t, s in zip(b["cls"].to_pylist(), texts, each)]
                rows = [(int(s[1].sum()), pack(*s)) for s, o in zip(each, ok) if o]
                size, bag = zip(*rows) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([b["cls"].filter(pa.array(ok, pa.bool_())), pa.array(size, pa.int64()), pa.array(bag, pa.binary())], ["cls", "size", "bag"])

    return found.mapInArrow(run, "cls binary, size long, bag binary").dropDuplicates(["cls"])


def _verify(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """pairs (a, b) -> (a, b, s), s their similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [similarity(unpack(x.as_py()), unpack(y.as_py())) for x, y in zip(b["x"], b["y"])]
            yield pa.RecordBatch.from_arrays([b["a"], b["b"], pa.array(s, pa.float64())], ["a", "b", "s"])

    side = lambda c, bag: bags.select(F.col("cls").alias(c), F.col("bag").alias(bag))
    return pairs.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b").mapInArrow(run, "a binary, b binary, s double")


def _exploded(bags: DataFrame) -> DataFrame:
    """(cid, h, w) of each shingle of bags (cid, bag). Small numbers stand for classes: these rows are many, and they compress."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                b = batch.slice(k, 64)
                each = [unpack(x) for x in b["bag"].to_pylist()]
                cid = np.repeat(b["cid"].to_numpy(), [len(s[0]) for s in each])
                hashes, weights = (np.concatenate([s[k] for s in each]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(hashes.view(np.int64)), pa.array(weights.astype(np.int64))], ["cid", "h", "w"])

    return bags.select("cid", "bag").mapInArrow(run, "cid long, h long, w long")


def _own_weight(bags: DataFrame) -> DataFrame:
    """(cls, size, own): the weight of a class's shingles, and of those that no other class here has.

    Two classes share at most size - own of either, which bounds their similarity from above.
    """
    held = _exploded(bags).groupBy("h").agg(F.count("*").alias("n"), F.min("cid").alias("cid"), F.min("w").alias("w"))
    own = held.where("n = 1").groupBy("cid").agg(F.sum("w").alias("own"))
    return bags.select("cid", "cls", "size").join(own, "cid", "left").select("cls", "size", F.coalesce("own", F.lit(0)).alias("own"))


def _rare_shingles(bags: DataFrame, similar: float, work: Workspace) -> DataFrame:
    """(cid, key, rest): the shingles of which any two classes of that similarity share one; rest is a class's weight from there on.

    Let both multisets be sorted by how many classes hold a shingle, then by hash, and z be the first that they share. All
    that they share comes from z on, so what a class has before z weighs at most (1 - similar) of its size, and the
    rest of either, at z, is no less than what they share. Groups in which no two members of a size can share enough are left out.
    """
    once = _exploded(bags)
    held = once.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    shared = once.join(held, "h").join(bags.select("cid", "size"), "cid")
    mine = Window.partitionBy("cid")
    before = F.coalesce(F.sum("w").over(mine.orderBy("n", "h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = shared.withColumn("rest", F.sum("w").over(mine) - before)
    holds = lambda least: F.col("rest") >= (least - _ROUNDING) * F.col("size")
    rare, _ = work.keep(placed.where(holds(similar)).select("cid", F.col("h").alias("key"), "rest", holds(2 * similar / (1 + similar)).alias("short")))
    groups = rare.groupBy("key").agg(F.count("*").alias("n"), F.max("short").alias("some")).where("n > 1 AND some").select("key")
    return rare.join(groups, "key").drop("short")


def _bound(size: str, own: str, l_size: str, l_own: str) -> Column:
    """Upper bound of the similarity of two classes: they share no more than either shares with any."""
    most = F.least(F.col(size) - F.col(own), F.col(l_size) - F.col(l_own))
    return most / (F.col(size) + F.col(l_size) - most)


def _leaders(rows: DataFrame, n: int) -> DataFrame:
    """(key, leader, and the leader's root, size, own and rest): the n classes of each group that meet most others."""
    order = Window.partitionBy("key").orderBy(F.desc("met"), F.xxhash64("cls"), "cls")
    own = [F.col(c).alias(f"l_{c}") for c in ("root", "size", "own", "rest")]
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("key", F.col("cls").alias("leader"), *own)


class _Search:
    """What is known of pairs of classes, and their components so far, while leaders meet the members of their groups."""

    def __init__(self, bags: DataFrame, similar: float, work: Workspace):
        self.bags, self.similar, self.work = bags, similar, work
        self.checked: DataFrame | None = None  # (a, b, s) of verified pairs, a < b
        self.roots: DataFrame | None = None  # (cls, root) of linked classes; a component's root has no row
        self.roots_at, self.few_roots = "", True

    def verify(self, pairs: DataFrame) -> None:
        """Verifies pairs (a, b) that haven't been, and joins the components of those that are alike."""
        if self.checked is not None:
            pairs = pairs.join(self.checked.select("a", "b"), ["a", "b"], "left_anti")
        pairs, due = self.work.keep(pairs)
        # Few pairs need few bags, which are picked without moving the others.
        ids = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        bags = self.work.keep(self.bags.join(F.broadcast(ids), "cls", "left_semi"), slim=False)[0] if due["n"] <= BROADCAST_ROWS else self.bags
        new, _ = self.work.keep(_verify(pairs, bags))
        self.checked = new if self.checked is None else self.checked.unionByName(new)
        edges = new.where(F.col("s") >= self.similar).select("a", "b")
        if self.roots is None:
            self._now(components(edges, self.work).select(F.col("node").alias("cls"), "root"))
            return
        for c in ("a", "b"):
            edges = self.rooted(edges, c, "r").drop(c).withColumnRenamed("r", c)
        moved = components(edges, self.work)
        to = moved.withColumnRenamed("root", "new")
        old = self.roots.join(to, F.col("root") == F.col("node"), "left").select("cls", F.coalesce("new", "root").alias("root"))
        self._now(old.unionByName(moved.select(F.col("node").alias("cls"), "root")))

    def _now(self, roots: DataFrame) -> None:
        before = self.roots_at
        self.roots, facts = self.work.keep(roots)
        self.roots_at, self.few_roots = facts["folder"], facts["n"] <= BROADCAST_ROWS
        if before:
            self.work.drop(before)

    def rooted(self, rows: DataFrame, of: str, into: str) -> DataFrame:
        """rows with the root of the class in column ``of``."""
        roots = self.roots.select(F.col("cls").alias("_of"), F.col("root").alias("_root"))
        roots = F.broadcast(roots) if self.few_roots else roots
        return rows.join(roots, F.col(of) == F.col("_of"), "left").withColumn(into, F.coalesce("_root", of)).drop("_of", "_root")

    def links(self) -> DataFrame:
        """(a, b) of the pairs found alike; with their components they say all, as pairs within a component aren't verified."""
        return self.checked.where(F.col("s") >= self.similar).select("a", "b")

    def meet(self, rows: DataFrame, n: int) -> tuple[DataFrame, int]:
        """One round of rows (key, cls, root, met, size, own, rest) with n leaders a group; returns the rows that go on, and how many."""
        leaders, led = self.work.keep(_leaders(rows, n))
        leaders = F.broadcast(leaders) if led["n"] <= BROADCAST_ROWS else leaders
        # In the group of the first shingle that a pair shares, both have from there on all that they share.
        due = F.least("rest", "l_rest") * (1 + self.similar) >= (F.col("size") + F.col("l_size")) * self.similar - _ROUNDING * F.col("size")
        alike = due & (_bound("size", "own", "l_size", "l_own") >= self.similar) & (F.col("root") != F.col("l_root"))
        met = rows.join(leaders, (rows["key"] == leaders["key"]) & alike)
        self.verify(met.select(F.least("leader", "cls").alias("a"), F.greatest("leader", "cls").alias("b")).distinct())
        # Leaders have met all of their group. The others go on unless they are of one component.
        left = rows.join(leaders.select("key", F.col("leader").alias("cls")), ["key", "cls"], "left_anti").drop("root")
        return self.open_groups(self.rooted(left, "cls", "root"))

    def open_groups(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """Rows of groups with members of several components, and how many."""
        rows, facts = self.work.keep(rows)
        several = rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
        out, left = self.work.keep(rows.join(several, "key", "left_semi"))
        self.work.drop(facts["folder"])
        return out, left["n"]


def links(docs: DataFrame, classes: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b) links between classes (cls, rep, bands) whose similarity is at least ``similar``."""
    return search(docs, classes, similar, id_col, text_col).links()


def search(docs: DataFrame, classes: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> _Search:
    """The pairs verified to find the links between classes."""
    work = Workspace(docs.sparkSession)
    rows = classes.select("cls", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows, _ = work.keep(rows.join(shared, "key"))
    needed, found = work.keep(rows.groupBy("cls").agg(F.sum("n").alias("met")).join(classes.drop("bands"), "cls"))
    bags, _ = work.keep(_bags(docs, needed, found["n"] <= BROADCAST_ROWS, id_col, text_col).withColumn("cid", F.monotonically_increasing_id()), slim=False)
    # Classes whose own shingles weigh too much have no partner.
    facts, _ = work.keep(_own_weight(bags).where(F.col("size") - F.col("own") >= similar * F.col("size")).join(needed.select("cls", "met"), "cls"))
    found = _Search(bags, similar, work)
    first = rows.select("key", "cls").join(facts.withColumns({"rest": F.col("size"), "root": F.col("cls")}), "cls")
    left, going = found.meet(found.open_groups(first)[0], 1)
    n = 4
    if going:
        alone, _ = work.keep(left.select("cls").distinct().join(bags, "cls"), slim=False)
        rare = _rare_shingles(alone, similar, work).join(alone.select("cid", "cls"), "cid").join(facts, "cls").select("key", "cls", "met", "size", "own", "rest")
        rows, going = found.open_groups(found.rooted(rare, "cls", "root"))
        while going:
            rows, going = found.meet(rows, n)
            n *= 16
    return found


def components(edges: DataFrame, work: Workspace | None = None) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the component's smallest node.

    Alternates large-star and small-star steps; each only joins nodes with their smallest
    neighbour, so a node with very many neighbours is never gathered. A step's table goes when the next one is written.
    """
    work = work or Workspace(edges.sparkSession)
    mark = {"hash": F.expr("sum(cast(xxhash64(a, b) as decimal(20,0)))")}
    e, facts = work.keep(edges.select("a", "b").where("a != b"), **mark)
    state = None
    while True:
        few = facts["n"] <= BROADCAST_ROWS
        both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        made = small.unionByName(least.select("a", F.col("m").alias("b")))
        before, at = state, facts["folder"]
        e, facts = work.keep((made.coalesce(1) if few else made).distinct(), **mark)
        work.drop(at)
        state = (facts["n"], facts["hash"])
        if state == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _placed(docs: DataFrame, similar: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, r1, r2, cls, root, class_id, copy_id) for each row."""
    sigs = stored(signatures(docs, id_col, text_col))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")
    classes = sigs.where("cls IS NOT NULL").groupBy("cls", "bands").agg(F.min(row).alias("row"))
    classes = stored(classes.select("cls", "bands", F.col("row.doc_id").alias("rep"), "row.r1", "row.r2"))
    found = search(docs, classes, similar, id_col, text_col)
    found.work.clear(found.roots_at)
    roots = found.roots
    placed = classes.select("cls", "rep").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = placed.groupBy("root").agg(F.min("rep").alias("class_id"))
    of = placed.join(least, "root").select("cls", "root", "class_id", F.col("rep").alias("copy_id"))
    return sigs.select("doc_id", "r1", "r2", "cls").join(of, "cls", "left")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, copy_id) for each row: the smallest id of its near-duplicate
    class, and of the documents with the same shingles. Blank texts: their own id in both."""
    return _placed(docs, similar, id_col, text_col).select("doc_id", F.expr("IF(cls IS NULL, doc_id, class_id)").alias("class_id"), F.expr("IF(cls IS NULL, doc_id, copy_id)").alias("copy_id"))


def one_of_each(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate class: the one with the smallest id that isn't null, among several the smallest
    hash of the text; of rows that repeat both, one. Rows whose text is null, empty or blank all stay."""
    rows = _placed(docs, similar, id_col, text_col).where("cls IS NOT NULL").groupBy("root", "doc_id", "r1", "r2").agg(F.count("*").alias("n"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")
    rows = stored(rows.withColumn("row", row))
    best = rows.groupBy("root").agg(F.min("row").alias("best"), F.sum("n").alias("all")).where("all > 1").select("root", "best")
    # One row for each text to drop, and for each text to keep that several rows repeat.
    verdict = rows.join(best, "root").where("row != best OR n > 1").select(F.col("doc_id").alias("_id"), F.col("r1").alias("_h1"), F.col("r2").alias("_h2"), (F.col("row") == F.col("best")).alias("_kept"))
    names = docs.columns
    text = F.col(f"`{text_col}`")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_d"), F.xxhash64(text).alias("_r1"), F.xxhash64(F.lit("row"), text).alias("_r2"))
    verdict = stored(verdict)
    same = F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_r1") == F.col("_h1")) & (F.col("_r2") == F.col("_h2"))
    out = own.join(fitted(verdict), same, "left_anti").select("_row")
    twice = verdict.where("_kept")
    if not twice.isEmpty():
        out = out.unionByName(own.join(fitted(twice), same).groupBy("_d", "_r1", "_r2").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row"))
    return out.select(*(F.col("_row").getField(c).alias(c) for c in names))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, as ``one_of_each`` says, which also settles ties; a text of any length is compared whole; an empty
    table stays empty. Columns pass through."""
    return one_of_each(docs)
