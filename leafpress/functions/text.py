"""Text assembly with native array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the complement of Unicode white space. A line isn't blank iff it holds a character outside Unicode white space.
NON_BLANK = r"[^\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Fixed value.
EMPTY_NOTICE = "Không có nội dung"


def is_blank(line: Column) -> Column:
    return ~line.rlike(NON_BLANK)


def lines(text: Column) -> Column:
    """Split at newlines alone; empty and trailing lines stay."""
    return F.split(text, "\n", -1)


def paragraph_array(text: Column) -> Column:
    """The lines that aren't blank, unstripped, in order."""
    return F.filter(lines(text), lambda x: x.rlike(NON_BLANK))


def paragraphs(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, para_no int, text) for each paragraph."""
    return df.select(id_col, F.posexplode(paragraph_array(F.col(text_col))).alias("para_no", "text"))


def fragment_texts(fragments: Column) -> Column:
    """The text of each recognised fragment, in recognizer order."""
    return F.transform(fragments, lambda f: f["text"])


def fold_fragments(fragments: Column) -> Column:
    """Fragments joined by newlines; no fragments give ''."""
    return F.array_join(fragment_texts(fragments), "\n")


def _fold(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, text): texts of a group joined in order; null if all of them are null."""
    ordered = F.array_sort(F.collect_list(F.struct("_order", "text")))
    return rows.groupBy(*keys).agg(F.when(F.count("text") > 0, fold_fragments(ordered)).alias("text"))


def sub_ranges(rows: DataFrame, ranges: int) -> DataFrame:
    """(_key, _order, text): each key's rows, dealt by ranges of the order and folded there; _order is then the number of the range."""
    dealt = rows.repartitionByRange(ranges, "_key", "_order", F.substring("text", 1, 64)).withColumn("_part", F.spark_partition_id())
    return _fold(dealt, ("_key", "_part")).select("_key", F.col("_part").alias("_order"), "text")


def join_ordered(df: DataFrame, key: str, order: str, text: str, most: int = 100_000) -> DataFrame:
    """(key, text): rows of a key joined by newlines in the given order, nulls first; null texts are passed by.

    Keys are counted first. One with more than ``most`` rows is folded in two steps, ranges of its order apart and then the ranges, so no task gets
    more than about ``most`` of its rows.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.col(text).alias("text"))
    loads = rows.groupBy("_key").agg(F.count("*").alias("n")).where(F.col("n") > most)
    hot = loads.agg(F.sum("n")).first()[0] or 0
    out = _fold(rows, ("_key",))
    if hot:
        loads = loads.select("_key")
        loaded = F.col("l._key").eqNullSafe(F.col("r._key"))
        parts = sub_ranges(rows.alias("l").join(loads.alias("r"), loaded, "left_semi"), -(-hot // most))
        out = _fold(rows.alias("l").join(loads.alias("r"), loaded, "left_anti"), ("_key",)).unionByName(_fold(parts, ("_key",)))
    return out.select(F.col("_key").alias(key), F.coalesce("text", F.lit("")).alias("text"))


def shown_text(text: Column) -> Column:
    """The text, or a notice if it is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(EMPTY_NOTICE))
