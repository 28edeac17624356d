"""Turns of conversations in order, for operators 11 and 12.

Rows are dealt by ranges of (conversation, turn, role, first characters of the text) and sorted within them, so a conversation with a large
part of all rows lies in several tasks. Each task cuts its rows into blocks: a block belongs to one conversation and has at most ``rows``
turns and, unless a single turn is longer, ``size`` bytes. Block numbers rise with the order, over tasks too, which makes everything
that is folded per conversation a fold of blocks, then of the few rows that these give.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafpress.llm.common import fitted

BLOCK_ROWS, BLOCK_BYTES = 1 << 10, 1 << 20


def in_order(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text) in ranges, sorted. Nulls come first; rows of one turn follow by role and text."""
    own = rows.select(*(F.col(f"`{c}`").alias(k) for c, k in ((id_col, "conv"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))))
    return own.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")


class Cutter:
    """Deals the rows of a task, which come in order, to blocks."""

    def __init__(self, rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES):
        self.rows, self.size = rows, size
        self.part = TaskContext.get().partitionId() if TaskContext.get() else 0
        self.block, self.conv, self.n, self.bytes = (self.part << 33) - 1, object(), 0, 0

    def __call__(self, convs: Sequence, sizes: Sequence[int]) -> tuple[list[int], list[int]]:
        """Block, and place in it, of some rows of these conversations and sizes in bytes."""
        blocks, places = [], []
        for conv, size in zip(convs, sizes):
            if conv != self.conv or self.n == self.rows or (self.n and self.bytes + size > self.size):
                self.block, self.conv, self.n, self.bytes = self.block + 1, conv, 0, 0
            blocks.append(self.block)
            places.append(self.n)
            self.n += 1
            self.bytes += size
        return blocks, places


def portions(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose sizes add up to ``limit`` at most, or of one larger row."""
    ends, i = np.cumsum(sizes), 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield batch.slice(i, j - i)
        i = j


def shared_blocks(blocks: DataFrame) -> DataFrame:
    """(block, k) of conversations with several blocks, counted from 0 within the conversation; from (conv, block), one row a block."""
    every = Window.partitionBy("conv")
    return blocks.select("block", F.count("*").over(every).alias("_n"), (F.row_number().over(every.orderBy("block")) - 1).alias("k")).where("_n > 1").select("block", "k")


def folded(blocks: DataFrame, several: DataFrame, sums: Sequence[str], texts: Sequence[str], separator: str = "") -> DataFrame:
    """One row a conversation from (conv, block, sums, texts): sums added, and the SHA-256 of each text's blocks joined in order.

    A conversation of one block, as nearly all are, is hashed where it lies. The others' blocks (``several`` has their numbers) are
    streamed in order through one hash each, as such a digest can't be taken in parts; what a task holds is one hash and a batch.
    A block whose text is null adds nothing, not even a separator.
    """
    kind = blocks.schema["conv"].dataType.simpleString()
    marks = blocks.join(fitted(several.select("block", F.lit(True).alias("_more"))), "block", "left")
    ones = marks.where("_more IS NULL").select("conv", *sums, *(F.sha2(F.coalesce(t, F.lit("")), 256).alias(t) for t in texts))
    gap = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []

        def row() -> pa.RecordBatch:
            conv, added, hashes, _ = state
            cols = [conv, *(pa.array([x], pa.int64()) for x in added), *(pa.array([h.hexdigest()]) for h in hashes)]
            return pa.RecordBatch.from_arrays(cols, ["conv", *sums, *texts])

        for b in batches:
            numbers = [b[s].to_pylist() for s in sums]
            for i in range(b.num_rows):
                if not state or state[0][0] != b["conv"][i]:
                    if state:
                        yield row()
                    state[:] = [b["conv"].slice(i, 1), [0] * len(sums), [hashlib.sha256() for _ in texts], [False] * len(texts)]
                for k, values in enumerate(numbers):
                    state[1][k] += values[i]
                for k, t in enumerate(texts):
                    if b[t][i].is_valid:
                        state[2][k].update((gap if state[3][k] else b"") + b[t][i].as_py().encode())
                        state[3][k] = True
        if state:
            yield row()

    schema = ", ".join([f"conv {kind}", *(f"{s} long" for s in sums), *(f"{t} string" for t in texts)])
    rest = marks.where("_more").select("conv", "block", *(F.col(s).cast("long").alias(s) for s in sums), *texts)
    rest = rest.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(run, schema)
    return ones.unionByName(rest)


def offsets(lengths: Sequence[int], start: int = 0) -> list[int]:
    """Prefix sums: where each piece starts, and the end."""
    return list(accumulate(lengths, initial=start))
