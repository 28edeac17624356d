"""Document fingerprints (operator 1), native: DataFrame expressions only.

Winnowing: every run of ``K`` characters has a hash that is rolled along the text: that of its first half, combined by exclusive or with that of
its second half, shifted. Each half is hashed once and serves the two runs that hold it, so no run is hashed afresh. Of each window of ``WINDOW`` hashes in a
row the smallest is kept, the rightmost if several are equal, with its position. Two texts that share a
passage of ``K + WINDOW - 1`` characters share a kept hash from it. A text is read in blocks that
overlap by one window, so a hash array never holds more than a block and long texts take
linear time. Window minima come from five doubling steps, each of an array with itself moved on: something put before it moves
an array far more cheaply than a slice does. What a window has beyond the block is ``NONE``, the least value, which marks the whole window.

``compare_with_next`` needs the document after each one. Documents are dealt to buckets by
quantiles of their id; the first document of each bucket is also sent to the bucket before it,
so every bucket finds its successors alone: texts are shuffled once, and no task sees all rows.
The edited text shares its beginning with the document, and so do their fingerprints: only the
two ends are fingerprinted apart.

Defined results: null and empty texts have an empty fingerprint; the likeness of two
empty ones is 1, of an empty and another one 0. A text shorter than K is one hash, one with fewer
hashes than a window is one window. Rows are ordered by id, nulls first, rows with one id by a hash
of their text; a table of one row is its own successor, an empty one gives no rows. Repeated rows are fingerprinted
each. ``fingerprint`` passes columns of the input through, whatever their names, and replaces one named like its result;
``compare_with_next`` reads id and text alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafpress.llm.common import table

K = 12
WINDOW = 32
BLOCK = 2048
BUCKET_ROWS, MAX_BUCKETS = 400, 4096
_REACH = K + WINDOW - 2  # characters of a window after its first


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: No hash: the low bits of one hold a position, and are never all 0.
NONE = "(-9223372036854775807L - 1L)"


def _rolled() -> str:
    """The hashes of all runs of K characters of block b, between as many NONE as a half has characters.

    A hash keeps its high 48 bits; below stands the position of its run, reversed so that of equal hashes the rightmost is the smallest.
    """
    half = K // 2
    halves = rf"transform(regexp_extract_all(b, '(?s)(?=(.{{{half}}})).', 1), (c, i) -> (xxhash64(c) & -65536L) | (65535 - i))"
    runs = f"zip_with(concat(array_repeat(CAST(NULL AS BIGINT), {half}), c), c, (p, q) -> coalesce(p ^ shiftleft(q & -65536L, {half}), {NONE}))"
    return _let(halves, "c", runs)


def _minima() -> str:
    """The distinct minima of all windows of block b, by position: of its one window if it is the text's first and shorter, of none if it is a later one."""
    body, step = f"m{WINDOW}", WINDOW
    while step > 1:
        step //= 2
        body = _let(f"zip_with(concat(array_repeat({NONE}, {step}), m{step}), m{step}, (p, q) -> IF(q < p, q, p))", f"m{2 * step}", body)
    full = f"array_remove(array_distinct({_let(_rolled(), 'm1', body)}), {NONE})"
    short = f"IF(char_length(b) >= {K}, array_min(array_remove({_rolled()}, {NONE})), (xxhash64(b) & -65536L) | 65535)"
    return f"CASE WHEN char_length(b) > {_REACH} THEN {full} WHEN j = 0 THEN array({short}) ELSE CAST(array() AS ARRAY<BIGINT>) END"


def winnow(text: str, offset: str = "0L") -> Column:
    """array<struct<hash,pos>> of the hashes kept from column ``text`` (not null), by position.

    Positions count code points from ``offset``, a column name or literal.
    """
    found = f"transform({_minima()}, x -> named_struct('hash', shiftright(x, 16), 'pos', {offset} + j * {BLOCK}L + (65535 - (x & 65535L))))"
    blocks = rf"regexp_extract_all({text}, '(?s)(?=(.{{1,{BLOCK + _REACH}}})).{{1,{BLOCK}}}', 1)"
    return F.expr(_let(f"flatten(transform({blocks}, (b, j) -> {found}))", "f", _ADJACENT))


#: Neighbouring blocks keep a shared position each; positions never fall, so such pairs are adjacent.
_ADJACENT = "filter(f, (x, i) -> i = 0 OR x.pos != get(f, i - 1).pos)"


def joined(first: str, second: str) -> Column:
    """The fingerprint of a text from those of its beginning and of its end, which overlap by a window less one."""
    return F.expr(_let(f"concat({first}, {second})", "f", _ADJACENT))


def fingerprint(docs: DataFrame, text_col: str = "text", into: str = "fingerprint") -> DataFrame:
    """docs plus the fingerprint of each text."""
    names = [c for c in docs.columns if c != into]
    fed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    return fed.select("_row", winnow("_t").alias(into)).select(*(F.col("_row").getField(c).alias(c) for c in names), F.col(f"`{into}`"))


def _hashes(found: str) -> Column:
    return F.expr(f"array_distinct(transform({found}, x -> x.hash))")


def _likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both)).cast("double")


def digest(found: str) -> Column:
    """Lower-case hex digest of a fingerprint: its hashes with their positions, in order."""
    return F.sha2(F.expr(f"array_join(transform({found}, x -> concat(hex(x.hash), '@', x.pos)), ',')"), 256)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint arrays, near_edited, near_next) of each row.

    The edited text is the text with its last quarter replaced by the beginning of the next row's.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("t"))
    facts = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("least")).first()
    parts = min(MAX_BUCKETS, math.ceil(facts["ids"] / BUCKET_ROWS))
    cuts = rows.agg(F.percentile_approx("doc_id", F.array(*(F.lit(k / parts) for k in range(1, parts))), F.lit(100_000))).first()[0] if parts > 1 else []
    # Quantiles are ids that occur, so each bucket begins with a row that has exactly its cut.
    firsts = sorted({facts["least"], *cuts}) if facts["ids"] else []
    cut = F.array(*map(F.lit, firsts)) if firsts else F.array().cast("array<bigint>")
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(cut, lambda c: c <= F.col("doc_id"))))
    none = facts["ids"] < facts["n"]  # rows without an id come first of all
    starts = F.coalesce(F.array_contains(cut, F.col("doc_id")), F.lit(False))
    leads = F.col("doc_id").isNull() if none else F.coalesce(F.col("doc_id") == F.lit(facts["least"]), F.lit(False))
    copies = F.array_compact(
        F.array(
            F.struct(F.col("bucket"), F.lit(0).alias("late")),
            F.when(starts, F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(1).alias("late"))),
            F.when(leads, F.struct(F.lit(len(firsts)).alias("bucket"), F.lit(2).alias("late"))),
        )
    )
    dealt = rows.withColumn("bucket", bucket).select("doc_id", "t", F.explode(copies).alias("to")).select("doc_id", "t", "to.bucket", "to.late")
    dealt = dealt.withColumns({"n": F.char_length("t"), "r1": F.xxhash64("t"), "r2": F.xxhash64(F.lit("row"), "t")})
    order = Window.partitionBy("bucket").orderBy("late", F.asc_nulls_first("doc_id"), "r1", "r2")
    seen = dealt.withColumn("after", F.coalesce(F.lead("t").over(order), F.lit("")))
    own = ["bucket", "late", "doc_id", "r1", "r2", "n"]
    kept = F.col("n") - F.floor(F.col("n") / 4)
    seen = seen.withColumn("keep", kept.cast("int"))
    # Where the unchanged beginning holds a window: its own windows, then those that reach into the end.
    seen = seen.withColumn("from", F.when(F.col("keep") > _REACH, F.col("keep") - _REACH).otherwise(0))
    seen = seen.withColumn("end", F.expr("substring(after, 1, n - keep)"))
    parted = seen.select(
        *own,
        "from",
        F.sha2(F.concat(F.expr("substring(t, 1, keep)"), "end"), 256).alias("edited_sha256"),
        F.expr(f"IF(keep > {_REACH}, substring(t, 1, keep), '')").alias("t_a"),
        F.expr("substring(t, from + 1, n)").alias("t_b"),
        # With nothing put in its place the beginning's own windows are all.
        F.expr("IF(from > 0 AND end = '', '', concat(substring(t, from + 1, keep - from), end))").alias("t_c"),
    )
    hashed = parted.select(*own, "edited_sha256", winnow("t_a").alias("f_a"), winnow("t_b", "from").alias("f_b"), winnow("t_c", "from").alias("f_c"))
    whole = hashed.select(*own, "edited_sha256", joined("f_a", "f_b").alias("fingerprint"), joined("f_a", "f_c").alias("edited_fingerprint"))
    sets = whole.withColumns({"h": _hashes("fingerprint"), "h_edited": _hashes("edited_fingerprint")})
    sets = sets.withColumn("h_next", F.lead("h").over(order)).where("late = 0")
    return sets.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", _likeness("h", "h_edited").alias("near_edited"), _likeness("h", "h_next").alias("near_next")
    )


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare_with_next(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", digest("fingerprint").alias("fingerprint"), digest("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next")
