"""Line dedup (operator 10), native: DataFrame expressions only.

Each line becomes (hash, document, position). Rows are dealt to tasks by ranges of the hash,
sorted by hash, document and position, and a streaming window carries each hash's first document on. A hash that
holds a large part of all rows would land in one range, so the ranges' rows are counted and those that hold more than their share are
salted by document, into as many parts as their load asks for. There, pass one finds the first document of each hash
in each part and pass two, over those firsts alone, the first of all. Lines are never text after the hash is taken.

The result is one sparse bitmap per document with dropped lines. ``drop_words``
holds only 64-bit words with a set bit (bit b of word w: line 64*w+b goes); all
other lines stay.

Defined results: a null or empty text is one empty line, which stays (keys shorter
than ``min_chars`` never go). Rows with the same id and text are one document and
get the same decision; rows with one id and different texts count as one holder
but are cut apart by their text. A null id counts as one document after all others. An empty table gives no rows;
a text of any length is read whole. Columns of the input pass through whatever their names; those named like a
result (n_lines, n_dropped, kept_text) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafpress.llm.common import ASCII_SPACE, ascii_lower, stored, table

_LAST_ID = (1 << 63) - 1
#: Ranges of the hash, as bits. A range with more than SHARE times the mean of all rows is salted.
_RANGE_BITS = 12
SHARE = 2


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text, _r1, _r2, and all columns as _row); _r1 and _r2 tell apart texts under one id."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    row = F.struct(*others) if others else F.struct(F.lit(0))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST_ID)).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_r1"), F.xxhash64(F.lit("row"), text).alias("_r2"), row.alias("_row"), F.col(f"`{text_col}`").isNull().alias("_null"))


def _first_holder(order: Window) -> Column:
    """The first document of each hash, carried along rows sorted by hash, document and position."""
    new = F.coalesce((F.lag("h1").over(order) != F.col("h1")) | (F.lag("h2").over(order) != F.col("h2")), F.lit(True))
    return F.last(F.when(new, F.col("_id")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(_id, _r1, _r2, n_dropped, drop_words array<struct<word,bits>>) of documents that lose lines."""
    lines = _keyed(docs, id_col, text_col).select("_id", "_r1", "_r2", F.posexplode(F.split("_text", "\n", -1)).alias("pos", "line"))
    key = F.btrim(F.col("line"), F.lit(ASCII_SPACE))
    # A hash is 128 bits: two 64-bit hashes with different seeds.
    keys = stored(
        lines.select("_id", "_r1", "_r2", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("_id", "_r1", "_r2", "pos", ascii_lower(F.col("key")).alias("key"))
        .select("_id", "_r1", "_r2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"))
        .withColumn("range", F.shiftrightunsigned("h1", 64 - _RANGE_BITS).cast("int"))
    )
    loads = keys.groupBy("range").agg(F.count("*").alias("n"))
    most = SHARE * (loads.agg(F.avg("n")).first()[0] or 1.0)
    # At most 2 ** _RANGE_BITS rows.
    heavy = F.broadcast(loads.where(F.col("n") > most).select("range", F.ceil(F.col("n") / most).cast("int").alias("salts")))
    calm = keys.join(heavy, "range", "left_anti")
    calm = calm.withColumn("first", _first_holder(Window.partitionBy("range").orderBy("h1", "h2", "_id", "pos")))
    hot = keys.join(heavy, "range").withColumn("salt", F.pmod(F.xxhash64("_id"), "salts").cast("int"))
    hot = hot.withColumn("first", _first_holder(Window.partitionBy("range", "salt").orderBy("h1", "h2", "_id", "pos")))
    # Rows that pass one has settled lie alone in pass two and are not compared again.
    hot = hot.withColumn("part", F.when(F.col("_id") > F.col("first"), F.lit(1) + F.pmod(F.xxhash64("_id", "pos"), F.lit(1 << 20))).otherwise(F.lit(0)))
    again = Window.partitionBy("h1", "h2", "part").orderBy("_id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    hot = hot.withColumn("first", F.least("first", F.first("_id").over(again)))
    own = ["_id", "_r1", "_r2", "pos", "first"]
    dropped = calm.select(*own).unionByName(hot.select(*own)).where(F.col("_id") > F.col("first"))
    # Identical rows yield the same positions twice, which bit_or absorbs.
    words = dropped.groupBy("_id", "_r1", "_r2", (F.col("pos") / 64).cast("int").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits")
    )
    return words.groupBy("_id", "_r1", "_r2").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("drop_words"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs plus n_lines, n_dropped and kept_text, the lines that stay joined by newlines."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    marks = bitmaps.select("_id", "_r1", "_r2", F.col("n_dropped").alias("_dropped"), F.map_from_entries("drop_words").alias("_words"))
    joined = _keyed(docs.select(*(F.col(f"`{c}`") for c in names)), id_col, text_col).join(marks.hint("shuffle_hash"), ["_id", "_r1", "_r2"], "left")
    kept = F.expr(
        r"""CASE WHEN _dropped IS NULL THEN _text ELSE array_join(filter(split(_text, '\n', -1), (x, i) ->
            (shiftright(coalesce(try_element_at(_words, CAST(i DIV 64 AS INT)), 0L), i % 64) & 1L) = 0L), '\n') END"""
    )
    count = F.char_length("_text") - F.char_length(F.replace(F.col("_text"), F.lit("\n"))) + 1
    given = {c: F.when(~F.col("_null"), F.col("_text")) if c == text_col else F.col("_row").getField(c) for c in names}
    return joined.select(*(given[c].alias(c) for c in names), count.cast("long").alias("n_lines"), F.coalesce("_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    return apply_bitmaps(docs, line_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
firsts AS (SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.*, coalesce(doc_id > first_id, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
