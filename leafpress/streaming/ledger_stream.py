"""A stream of order files into the ledger: each batch creates its scans and answers those that have ended."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafpress.operators.gates import COMPLETED, failed_status
from leafpress.operators.ledger import Ledger


class Stopped(RuntimeError):
    """Raised inside a batch to end the stream there, as a lost driver would."""


def process(batch: DataFrame, ledger: Ledger, batch_id: int, between=None) -> None:
    """Creates a scan for each order and, in a batch of its own, completes (F) or fails (O) it an hour and a half later. Any number of times, with the same outcome.

    between: called after the creation, where a test or demonstration stops the stream.
    """
    name = F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit(".png"))
    uploads = batch.select(name.alias("filename"), "o_orderstatus", "o_orderpriority", "o_orderdate")
    ledger.create(uploads, 2 * batch_id, F.col("o_orderdate"))
    if between:
        between(batch_id)
    pending = ledger.batch(2 * batch_id).select("scan_id", "filename")
    ok = F.col("o_orderstatus") == "F"
    ended = uploads.where("o_orderstatus IN ('F', 'O')").join(pending, "filename")
    changes = ended.select(
        "scan_id", F.when(ok, COMPLETED).otherwise(failed_status(F.col("o_orderpriority"))).alias("status"), F.when(ok, F.col("o_orderpriority")).alias("text_content"),
        (F.col("o_orderdate") + F.expr("INTERVAL 90 MINUTES")).alias("at"),
    )
    ledger.update(changes, 2 * batch_id + 1, F.col("at"))


def replayed(spark: SparkSession, landing: str, schema: StructType, ledger: Ledger, checkpoint: str, files: int) -> None:
    """The stream over what is in ``landing``: ended by an error in the middle of its second batch, started again, and its last batch run once more."""
    last: list[tuple[DataFrame, int]] = []

    def stop(batch_id: int) -> None:
        if batch_id == 1:
            raise Stopped("in the middle of a batch")

    def run(between) -> None:
        def each(batch: DataFrame, batch_id: int) -> None:
            process(batch, ledger, batch_id, between)
            last[:] = [(batch, batch_id)]

        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(landing)
        source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    try:
        run(stop)
    except StreamingQueryException as e:
        if Stopped.__name__ not in str(e):
            raise
    run(None)
    for batch, batch_id in last:
        process(batch, ledger, batch_id)
