"""The corpus pipeline: documents in, encoded documents out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Every
stage but the last returns the columns of documents; n_chars follows a changed text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.llm import bpe, line_dedup, mixing, near_dup, quality
from leafpress.llm.common import stored


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the first; a document that loses all of its lines goes, as nothing of it is left.

    Null and empty texts are one empty line, which stays. Repeated rows, null ids and ties (rows of one id hold their lines together) as in the operator. A text of
    any length is read whole. An empty table stays empty. Columns pass through whatever their names.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    out = line_dedup.dedup_lines(docs.select("doc_id", "text", row.alias("row")))
    emptied = (F.col("n_dropped") == F.col("n_lines")) & (F.col("n_dropped") > 0)
    given = {c: F.col("row").getField(c) for c in docs.columns if c != "text"}
    given["text"] = F.when(F.col("text").isNull(), F.lit(None).cast("string")).otherwise(F.col("kept_text"))
    if "n_chars" in given:
        given["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(given["n_chars"])
    return out.where(~emptied).select(*(given[c].alias(c) for c in docs.columns))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digests of ids and decoded bytes of every row.

    A null text is encoded as an empty one, repeated rows each; an empty table gives no rows; no column's name can clash. A text of any length is encoded whole;
    rows don't depend on each other, so there are no ties.
    """
    return bpe.encode_documents(docs)


STAGES = [
    ("quality", quality.quality_stage),
    ("line_dedup", line_stage),
    ("near_dup", near_dup.near_dup_stage),
    ("mixing", mixing.mixing_stage),
    ("byte_bpe", encode_stage),
]

#: Classifier, near-duplicate search, sampling and encoder can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
