"""Dense numbers in a given order, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.session import written

_PLACE = (1 << 33) - 1


def dense_ids(df: DataFrame, order: Sequence[str], name: str = "id", after: int = 0) -> DataFrame:
    """df plus ``name``: after + 1, after + 2, ... in ascending order of the columns, nulls first.

    Rows are dealt by ranges of the order and sorted there; a range's rows follow those of the ranges before it, whose counts the driver adds
    up (one number a range). Ranges are sampled anew whenever they are computed, so the dealt rows are written once. The numbers are
    row_number()'s, the same in every run where the order tells all rows apart.
    """
    return numbered(df, order, name, after)[0]


def numbered(df: DataFrame, order: Sequence[str], name: str = "id", after: int = 0) -> tuple[DataFrame, int]:
    """What ``dense_ids`` returns, and the last number given (``after``, if there are no rows)."""
    spark = df.sparkSession
    place = F.col("_place")
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    counts = sorted(tuple(r) for r in dealt.groupBy(F.shiftright(place, 33)).count().collect())
    *starts, last = accumulate((n for _, n in counts), initial=after)
    ranges = spark.createDataFrame([(part, start) for (part, _), start in zip(counts, starts)], "_part long, _start long")
    made = dealt.join(F.broadcast(ranges), F.shiftright(place, 33) == F.col("_part"))  # one row a range
    return made.withColumn(name, F.col("_start") + place.bitwiseAND(F.lit(_PLACE)) + 1).drop("_place", "_part", "_start"), last
