"""The digitization plan: uploads to cleaned pages, text, documents and ledger events.

Every stage carries struct<value, error>; a stage whose input failed is skipped, and the first
error becomes the scan's status, so a bad page never fails its task.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.functions.names import docx_name, extension
from leafpress.functions.text import fold_fragments
from leafpress.operators.gates import COMPLETED, failed_status, upload_code
from leafpress.operators.ledger import Ledger
from leafpress.operators.recognize import EasyOcr, Recognizer, recognizer_column
from leafpress.session import written
from leafpress.sources.docx import file_written, with_docx
from leafpress.sources.images import as_written, content_type, orientation, read_decoded, seen_pixels, turned, valid_image
from leafpress.sources.tiles import cleaned_pages, is_large


def accept(uploads: DataFrame) -> DataFrame:
    """Binary uploads (path, content, ...) plus code; cheap checks come before the content is looked at.

    The sender's type counts where uploads have a column content_type, else the one that the file's name suggests.
    """
    typed = uploads if "content_type" in uploads.columns else uploads.withColumn("content_type", content_type(F.col("path")))
    return typed.withColumn("code", upload_code(F.col("content_type"), F.col("content").isNotNull(), valid_image("content")))


def _texts(seen: DataFrame, name: str, make: Callable[[], Recognizer]) -> DataFrame:
    """Cleaned pages (clean[, ext], ...) to text and error, and what other columns there are."""
    rest = [c for c in seen.columns if c not in ("clean", "ext")]
    if "ext" in seen.columns:
        seen = seen.withColumn("clean", as_written("clean", "ext"))
    seen = seen.withColumn("found", recognizer_column(F.col("clean.value"), name, make))
    error = F.coalesce("clean.error", "found.error")
    return seen.select(*rest, F.when(error.isNull(), fold_fragments(F.col("found.value"))).alias("text"), error.alias("error"))


def recognized(pages: DataFrame, name: str = "easyocr", make: Callable[[], Recognizer] = EasyOcr) -> DataFrame:
    """pages (scan_id, pixels[, ext]) -> (scan_id, text, error), and what other columns there are; large pages are cleaned in tiles.

    With an extension the recognizer sees the cleaned page as its file would hold it; one that can't be written fails the scan.
    """
    return _texts(cleaned_pages(pages), name, make)


def _recognized_in_place(pages: DataFrame, name: str, make: Callable[[], Recognizer]) -> DataFrame:
    """Pages (scan_id, pixels, orientation, ext, ...) as in ``recognized``, but in one pass, which turns them too: a large page gets neither text nor error and stays as
    it is in the columns pixels and kind (its extension), which are null for all others."""
    large = is_large(F.col("pixels"))
    kept = pages.select("*", F.when(large, F.col("pixels")).alias("_pixels"), F.when(large, F.col("ext")).alias("kind"))
    small = F.col("kind").isNull()
    seen = kept.withColumn("clean", F.when(small, seen_pixels(F.when(small, F.col("pixels")), "orientation", "ext"))).drop("pixels", "ext")
    return _texts(seen.withColumnRenamed("_pixels", "pixels"), name, make)


def documents(texts: DataFrame, clock: Column) -> DataFrame:
    """(scan_id, text, error) plus docx_path and the package, or the error of building it; what other columns there are."""
    rest = [c for c in texts.columns if c not in ("scan_id", "text", "error")]
    built = with_docx(texts)
    error = F.coalesce("error", "docx.error")
    return built.select("scan_id", "text", error.alias("error"), F.when(error.isNull(), docx_name(F.col("scan_id"), clock)).alias("docx_path"), "docx.value", *rest)


def answered(texts: DataFrame, out_folder: str) -> DataFrame:
    """Recognised texts (scan_id, text, error, event_ts, ...) with their documents in place: docx_path, and the error of building or writing one. Computed once."""
    made = documents(texts, F.col("event_ts"))
    done = made.withColumn("wrote", file_written(made.sparkSession, out_folder, "docx_path", "value")).drop("value")
    return written(done.withColumn("error", F.coalesce("error", "wrote.error")).drop("wrote"))


def changes(written: DataFrame) -> DataFrame:
    """Ledger changes: Completed with text and path, or Failed with the message and neither."""
    ok = F.col("error").isNull()
    return written.select(
        "scan_id",
        F.when(ok, COMPLETED).otherwise(failed_status(F.coalesce("error", F.lit("")))).alias("status"),
        F.when(ok, F.col("text")).alias("text_content"),
        F.when(ok, F.col("docx_path")).alias("docx_path"),
    )


def _there(uploads: DataFrame, named: list[str]) -> DataFrame:
    """Decoded images of these uploads, but for those whose files are gone."""
    spark = uploads.sparkSession
    try:
        return read_decoded(spark, named)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        # Tasks look which files are still there: without its content, reading an upload asks for its status alone.
        known = {r[0] for r in uploads.select("path").collect()}
        return read_decoded(spark, [n for n in named if n in known])


def _aside(task: Callable[[], Any]) -> Callable[[], Any]:
    """Starts the task beside what follows, as its jobs leave the cluster idle in between; calling what this returns waits for it, and gives its result or raises its error."""
    end: dict[str, Any] = {}

    def run() -> None:
        try:
            end["value"] = task()
        except BaseException as e:  # noqa: BLE001
            end["error"] = e

    thread = InheritableThread(target=run)
    thread.start()

    def wait() -> Any:
        thread.join()
        if "error" in end:
            raise end["error"]
        return end["value"]

    return wait


def _numbered(judged: DataFrame, after: int) -> tuple[DataFrame, list[str]]:
    """The accepted files of a batch (scan_id, filename, orientation) with the ids that follow, by time and name, and their names.

    The names of one micro-batch are on the driver anyway, as listed by the source.
    """
    good = judged.where("code = 201").select("modificationTime", "path", "orientation").collect()
    good.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    rows = [(after + k, r[1], r[2]) for k, r in enumerate(good, 1)]
    return judged.sparkSession.createDataFrame(rows, "scan_id long, filename string, orientation int"), [r[1] for r in good]


def process_batch(
    uploads: DataFrame, ledger: Ledger, out_folder: str, batch_id: int, name: str = "easyocr", make: Callable[[], Recognizer] = EasyOcr, refuse: Callable[[DataFrame], None] | None = None
) -> DataFrame:
    """One batch of binary uploads through the whole plan; returns the rejected files with their code, after handing them to ``refuse``.

    Ids of a batch depend on the batch alone, files are rewritten with equal bytes and ledger
    partitions overwritten, so a replay changes nothing.
    """
    # Each file is read and judged once; what follows reads these slim rows.
    judged = written(accept(uploads).select("path", "modificationTime", "code", orientation("content").alias("orientation")))
    rejected = judged.where("code != 201").select("path", "code")
    refused = _aside(lambda: refuse(rejected)) if refuse else None
    try:
        _answer(uploads, judged, ledger, out_folder, batch_id, name, make)
    finally:
        if refused:
            refused()
    return rejected


def _answer(uploads: DataFrame, judged: DataFrame, ledger: Ledger, out_folder: str, batch_id: int, name: str, make: Callable[[], Recognizer]) -> None:
    """Creates the scans of a batch's accepted files, and completes or fails them."""
    after = ledger.last_id(2 * batch_id)
    good, named = _numbered(judged, after)
    decoded = _aside(lambda: _there(uploads, named)) if named else None
    try:
        ledger.create(good.drop("orientation"), 2 * batch_id, last=after + len(named))
    finally:
        files = decoded() if decoded else None
    if files is None:
        return
    pending = ledger.batch(2 * batch_id).select("scan_id", "filename", "event_ts").join(F.broadcast(good.select("filename", "orientation")), "filename")
    # Each page is decoded once, where Spark reads it: the slim rows of the batch go to the pages, whose files may be far smaller than their pixels.
    pages = files.join(F.broadcast(pending), F.col("filename") == F.col("path")).select("scan_id", "event_ts", "pixels", "orientation", extension(F.col("filename")).alias("ext"))
    # One pass from the pixels to the file, so that recognition runs once; changes are made from what is written here.
    done = answered(_recognized_in_place(pages, name, make), out_folder)
    found = done.agg(F.count("*").alias("all"), F.count("kind").alias("large")).first()
    slim = ("scan_id", "text", "error", "docx_path")
    ready = done.where("kind IS NULL").select(*slim)
    if found["large"]:
        large = done.where("kind IS NOT NULL").select("scan_id", "event_ts", turned("pixels", "orientation").alias("pixels"), F.col("kind").alias("ext"))
        ready = ready.unionByName(answered(recognized(large, name, make), out_folder).select(*slim))
    if found["all"] < len(named):
        none = F.lit(None).cast("string")
        lost = pending.join(done.select("scan_id"), "scan_id", "left_anti")
        ready = ready.unionByName(lost.select("scan_id", none.alias("text"), F.concat(F.lit("Image not found: "), "filename").alias("error"), none.alias("docx_path")))
    ledger.update(changes(ready), 2 * batch_id + 1)
