"""Ordered gates: each returns the status code of the first check that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPLETED = "Completed"
FAILED = "Failed"


def has_prefix(value: Column, prefix: str) -> Column:
    """Case-sensitive prefix test; null and empty values fail."""
    return F.coalesce(value.startswith(prefix), F.lit(False))


def is_image_type(content_type: Column) -> Column:
    return has_prefix(content_type, "image/")


def upload_code(content_type: Column, saved: Column, valid: Column) -> Column:
    """400 for a wrong type, 500 if it wasn't saved, 400 for an unreadable image, else 201."""
    return (
        F.when(~is_image_type(content_type), 400)
        .when(~F.coalesce(saved, F.lit(False)), 500)
        .when(~F.coalesce(valid, F.lit(False)), 400)
        .otherwise(201)
    )


def download_code(found: Column, status: Column, file_exists: Column) -> Column:
    """404 for an unknown scan, 400 unless Completed, 404 for a missing file, else 200."""
    return F.when(~found, 404).when(status != COMPLETED, 400).when(~F.coalesce(file_exists, F.lit(False)), 404).otherwise(200)


def is_terminal(status: Column) -> Column:
    return (status == COMPLETED) | status.startswith(FAILED)


def failed_status(message: Column) -> Column:
    return F.concat(F.lit(f"{FAILED}: "), message)


def status_label(scan_id: Column, status: Column) -> Column:
    return F.format_string("ID: %d - %s", scan_id, status)


def only_when_completed(status: Column, value: Column, completed: str = COMPLETED) -> Column:
    return F.when(status == completed, value)


def download_requests(requests: DataFrame, scans: DataFrame, files: DataFrame) -> DataFrame:
    """requests (id) against scans (id, status, docx_path) and a listing of files (path): code, path and name."""
    known = scans.select(F.col("id").alias("_id"), "status", "docx_path")
    listed = files.select(F.regexp_replace("path", r"^file:/*", "/").alias("_path")).distinct()
    # Scans without a document get keys of their own, which no path equals: as nulls they would all meet in one task.
    key = F.coalesce("docx_path", F.concat(F.lit("\0"), F.coalesce(requests["id"].cast("string"), F.lit(""))))
    asked = requests.join(known, requests["id"] == F.col("_id"), "left").withColumn("_key", key)
    joined = asked.join(listed, F.col("_key") == F.col("_path"), "left")
    code = download_code(F.col("_id").isNotNull(), F.col("status"), F.col("_path").isNotNull())
    path = F.when(code == 200, F.col("docx_path"))
    return joined.select("id", code.alias("code"), path.alias("path"), F.substring_index(path, "/", -1).alias("download_name"))
