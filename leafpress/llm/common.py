"""Helpers that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafpress.llm import textkernel as tk

#: Six ASCII white-space characters: U+0020 and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
ROW_GROUP = 16 << 20
#: Rows of a broadcast side; they hold a few numbers each, so that is some megabytes.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_checksum(column: str = "doc_id") -> Column:
    """crc32 of the id written as decimal text; null for a null id."""
    return F.crc32(F.col(column).cast("string"))


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leafpress-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage."""
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write as Parquet into the shared checkpoint folder and read back: like checkpoint, but compressed."""
    spark = df.sparkSession
    with_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/leafpress-{uuid.uuid4().hex}"
    # A small row group bounds what each task's writer buffers.
    df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def own_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder, for a table that its maker discards."""
    with_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/leafpress-{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder whose table nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Workspace:
    """Tables that an operator writes for itself, with their numbers of rows, and that it deletes once they are consumed.

    Rows are counted while they are written, so knowing a table's size takes no job. A table of at most BROADCAST_ROWS slim
    rows is read as one partition: what follows it in Spark needs no exchange, and a long series of small steps no thousands of tasks.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def keep(self, df: DataFrame, slim: bool = True, **facts: Column) -> tuple[DataFrame, dict]:
        """df as a table; and the facts (aggregates) of its rows, n among them. Rows that aren't slim stay spread, however few."""
        folder = own_folder(self.spark)
        seen = Observation()
        named = {"n": F.count(F.lit(1)), **facts}
        df.observe(seen, *(c.alias(k) for k, c in named.items())).write.option("parquet.block.size", str(ROW_GROUP)).parquet(folder)
        self.folders.append(folder)
        table = self.spark.read.schema(df.schema).parquet(folder)
        found = seen.get
        return (table.coalesce(1) if slim and found["n"] <= BROADCAST_ROWS else table), found | {"folder": folder}

    def drop(self, *folders: str) -> None:
        for folder in folders:
            discard(self.spark, folder)
            self.folders.remove(folder)

    def clear(self, *but: str) -> None:
        self.drop(*(f for f in list(self.folders) if f not in but))


def fitted(small: DataFrame) -> DataFrame:
    """A stored side of a join, of narrow rows: broadcast if it has at most BROADCAST_ROWS, else hashed where it lies."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small.hint("shuffle_hash")


def aside(names: Sequence[str]) -> list[Column]:
    """Columns under names of an operator's own, so that they can't clash with its columns."""
    return [F.col(f"`{c}`").alias(f"_in{k}") for k, c in enumerate(names)]


def restored(names: Sequence[str]) -> list[Column]:
    """What ``aside`` put out of the way, under its own names again."""
    return [F.col(f"_in{k}").alias(c) for k, c in enumerate(names)]


def with_judgements(docs: DataFrame, names: Sequence[str], text_col: str, make: Callable[[], Callable[[list], list[pa.Array]]], results: str, slice_bytes: int = tk.SLICE) -> DataFrame:
    """Columns ``names`` of docs plus ``results`` (DDL), which make()(texts) gives as arrays for some texts at a time.

    Texts become Python strings in slices of ``slice_bytes``, or one longer text, whatever a batch holds.
    """
    added = StructType.fromDDL(results)
    names = [c for c in names if c not in added.fieldNames()]
    others = [c for c in names if c != text_col]
    own = [f"_in{k}" for k in range(len(others))] + ["_text"] * (text_col in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make()
        for batch in batches:
            for part, texts in tk.slices(batch, "_text", slice_bytes):
                yield pa.RecordBatch.from_arrays([*(part[c] for c in own), *judge(texts)], [*own, *added.fieldNames()])

    fed = docs.select(*aside(others), F.col(f"`{text_col}`").alias("_text"))
    places = dict(zip(others, own)) | {text_col: "_text"}
    out = fed.mapInArrow(run, StructType([*(fed.schema[c] for c in own), *added.fields]))
    return out.select(*(F.col(places[c]).alias(c) for c in names), *added.fieldNames())


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z alone. For pure ASCII text lower() is the same and faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(
        F.translate(column, upper, upper.lower())
    )
