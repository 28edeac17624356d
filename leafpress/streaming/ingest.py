"""Streaming ingestion: each new file of a landing folder is digitized once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leafpress.operators.ledger import Ledger
from leafpress.operators.recognize import EasyOcr, Recognizer
from leafpress.plans.digitize import process_batch
from leafpress.sources.images import read_uploads


def start(
    spark: SparkSession,
    landing: str,
    ledger: Ledger,
    out_folder: str,
    checkpoint: str,
    rejects: str | None = None,
    name: str = "easyocr",
    make: Callable[[], Recognizer] = EasyOcr,
    max_files: int = 100,
) -> StreamingQuery:
    """Processes what is there and stops (availableNow); restarting goes on where it ended.

    The checkpoint makes every file part of exactly one batch; a batch replayed after a crash
    overwrites its own ledger partitions and files. Rejected files stay and are listed in ``rejects``.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        refuse = (lambda refused: refused.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")) if rejects else None
        process_batch(batch, ledger, out_folder, batch_id, name, make, refuse)

    source = read_uploads(spark, landing, True, max_files)
    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
