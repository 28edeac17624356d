"""Registered queries: each digitization operator on a column of the driver's tables, with its SQL twin."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.functions import jpeg, names, text
from leafpress.operators import gates, ledger, numbering
from leafpress.operators.recognize import PageSize
from leafpress.plans import statements
from leafpress.session import scratch, written
from leafpress.sources import docx, images, sink, tiles
from leafpress.streaming import ingest, ledger_stream, poll


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's paragraphs as the text of a completed scan, through the ledger's events and view."""
    docs = _t(spark, sf_dir, "documents")
    clock = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    made = ledger.create_events(docs.select(F.col("doc_id").alias("scan_id"), F.concat(F.lit("upload_"), F.col("doc_id").cast("string"), F.lit(".png")).alias("filename")), clock, 0)
    done = docs.select(F.col("doc_id").alias("scan_id"), F.lit(gates.COMPLETED).alias("status"), F.array_join(text.paragraph_array(F.col("text")), "\n").alias("text_content"), names.docx_name(F.col("doc_id"), clock).alias("docx_path"))
    return ledger.scans(made.unionByName(ledger.update_events(done, clock, 1)))


def content_type_gate(spark, d):
    return _t(spark, d, "pages").where(gates.has_prefix(F.col("url"), "https://")).select("page_id", "url")


def filename_ext(spark, d):
    return _t(spark, d, "pages").select("page_id", "url", names.extension(F.col("url")).alias("ext"))


def basename(spark, d):
    return _t(spark, d, "pages").select("page_id", "url", names.basename(F.col("url")).alias("base"))


def dirname(spark, d):
    return _t(spark, d, "pages").select("page_id", names.dirname(F.col("url")).alias("dir"))


def create_records(spark, d):
    uploads = _t(spark, d, "events").select(F.col("event_id").alias("scan_id"), names.upload_name(F.col("ts"), F.lit(".png")).alias("filename"), "ts")
    return ledger.create_events(uploads, F.col("ts"), 0).select(F.col("scan_id").alias("id"), "filename", "status")


def last_write_wins(spark, d):
    named = _t(spark, d, "events").select("event_id", "ts", names.upload_name(F.col("ts"), F.lit(".png")).alias("filename"))
    return ledger.latest(named, "filename", ("ts", "event_id"), ("event_id",))


def current_status(spark, d):
    rows = _t(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("status"))
    return ledger.latest(rows, "user_id", ("ts", "event_id"), ("event_id", "status"))


def update_status(spark, d):
    hit = F.col("o_orderkey") == 17
    return _t(spark, d, "orders").select(
        "o_orderkey", F.when(hit, gates.failed_status(F.lit("x"))).otherwise(F.col("o_orderstatus")).alias("status"), F.when(~hit, F.col("o_orderpriority")).alias("text_content")
    )


def get_by_id(spark, d):
    return ledger.get_by_id(_t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), 17, "o_orderkey")


def status_response(spark, d):
    s = F.col("o_orderstatus")
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), s.alias("status"), gates.only_when_completed(s, F.col("o_orderpriority"), "F").alias("text_content"))


def status_json(spark, d):
    s = F.col("o_orderstatus")
    body = F.to_json(F.struct(F.col("o_orderkey").alias("id"), s.alias("status"), gates.only_when_completed(s, F.col("o_orderpriority"), "F").alias("text_content")))
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), body.alias("body"))


def join_fragments(spark, d):
    return text.join_ordered(_t(spark, d, "conversations"), "conv_id", "turn", "text")


def paragraphs(spark, d):
    return text.paragraphs(_t(spark, d, "documents"), "doc_id")


def paragraphs_blank(spark, d):
    blanks = _t(spark, d, "documents").select("doc_id", F.replace(F.col("text"), F.lit(". "), F.lit(".\n \n")).alias("text"))
    return text.paragraphs(blanks, "doc_id")


def _asked(orders: DataFrame) -> DataFrame:
    """(id): every order's key, and for each one an id that no order has."""
    return orders.select(F.explode(F.array(F.col("o_orderkey"), -1 - F.col("o_orderkey"))).alias("id"))


def download_gate(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    asked = _asked(orders)
    done = F.when(F.col("o_orderstatus") == "F", gates.COMPLETED).otherwise(F.col("o_orderstatus"))
    joined = asked.join(orders, asked["id"] == orders["o_orderkey"], "left")
    return joined.select("id", gates.download_code(F.col("o_orderkey").isNotNull(), done, F.col("o_orderkey") % 2 == 1).alias("code"))


def ledger_replay(spark, d):
    """Events replayed in ten batches of time: a user's first event creates a scan, each batch's last event of a user updates it; compacted after every third.

    The ledger's folder lies in the shared scratch folder.
    """
    events = _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    span = events.agg(F.min("ts").cast("timestamp").cast("double").alias("low"), F.max("ts").cast("timestamp").cast("double").alias("high")).first()
    if span.low is None:
        return spark.createDataFrame([], "user_id long, event_id long, status string, first_id long")
    number = F.least(F.lit(9), F.floor((F.col("ts").cast("timestamp").cast("double") - span.low) / max(span.high - span.low, 1e-6) * 10)).cast("int")
    dealt = written(events.withColumn("number", number))
    firsts = written(dealt.groupBy("user_id").agg(F.min_by(F.struct("number", "event_id", "ts"), F.struct("ts", "event_id")).alias("f")).select("user_id", "f.*"))
    book = ledger.Ledger(spark, scratch(spark), bucket_size=64, compact_after=None)
    for n in range(10):
        new = firsts.where(F.col("number") == n).select(F.col("user_id").alias("scan_id"), F.col("event_id").cast("string").alias("filename"), "ts")
        book.create(new, 2 * n, F.col("ts"))
        last = ledger.latest(dealt.where(F.col("number") == n), "user_id", ("ts", "event_id"), ("event_id", "event_type", "ts"))
        book.update(last.select(F.col("user_id").alias("scan_id"), F.col("event_type").alias("status"), F.col("event_id").cast("string").alias("text_content"), "ts"), 2 * n + 1, F.col("ts"))
        if n % 3 == 2:
            book.compact()
    return book.scans(None).select(F.col("id").alias("user_id"), F.col("text_content").cast("long").alias("event_id"), "status", F.col("filename").cast("long").alias("first_id"))


def stream_ledger(spark, d):
    """Orders as a stream of files into the ledger: created and answered batch by batch, stopped by an error, restarted, and its last batch replayed.

    Files reach batches in no fixed order, so the ids are shown by what they must be: 1, 2, ... without a gap.
    """
    folder = scratch(spark)
    orders = _t(spark, d, "orders")
    orders.repartition(12, "o_orderkey").write.parquet(f"{folder}/landing")
    book = ledger.Ledger(spark, f"{folder}/ledger", compact_after=6)
    ledger_stream.replayed(spark, f"{folder}/landing", orders.schema, book, f"{folder}/checkpoint", files=3)
    state = book.scans(None)
    ids = state.agg((F.count("*") == F.count_distinct("id")).alias("distinct"), ((F.min("id") == 1) & (F.max("id") == F.count("*"))).alias("dense"))
    return state.crossJoin(F.broadcast(ids)).select("filename", "status", "created_at", "updated_at", "text_content", (F.col("distinct") & F.col("dense")).alias("dense_ids"))


def poll_outcomes(spark, d):
    """A scan for each user and day, polled until it completes (purchase), fails (error) or has been silent for six hours; the stream's last hours stay open."""
    folder = scratch(spark)
    events = _t(spark, d, "events")
    poll.in_time_order(events, "ts", f"{folder}/landing", 5)

    def updates(stream: DataFrame) -> DataFrame:
        kind = F.col("event_type")
        status = F.when(kind == "purchase", gates.COMPLETED).when(kind == "error", gates.failed_status(F.lit("error"))).otherwise("Pending")
        return stream.select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("scan_id"), status.alias("status"), "ts")

    return poll.polled(spark, f"{folder}/landing", events.schema, updates, 6 * 3_600_000, folder)


def sql_statements(spark, d):
    """A scan for each order through SQL text with named parameters: inserted, answered, and selected."""
    orders = _t(spark, d, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    table = statements.Statements(spark, f"scan_events_{uuid.uuid4().hex}", scratch(spark))
    orders.select(F.col("o_orderkey").alias("scan_id"), F.concat(F.lit("it's "), F.col("o_orderkey").cast("string")).alias("filename"), at.alias("at")).createOrReplaceTempView("new_uploads")
    table.insert("new_uploads")
    ok = F.col("o_orderstatus") == "F"
    ended = orders.where("o_orderstatus IN ('F', 'O')").select(
        F.explode(F.array(F.col("o_orderkey"), -1 - F.col("o_orderkey"))).alias("scan_id"), F.when(ok, gates.COMPLETED).otherwise(gates.failed_status(F.col("o_orderpriority"))).alias("status"),
        F.when(ok, F.col("o_orderpriority")).alias("text_content"), F.lit(None).cast("string").alias("docx_path"), (at + F.expr("INTERVAL 90 MINUTES")).alias("at"),
    )
    ended.createOrReplaceTempView("new_changes")
    table.update("new_changes")
    return table.select().drop("docx_path")


def dense_ids(spark, d):
    lines = _t(spark, d, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return numbering.dense_ids(lines, ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"))


def _order_ledger(spark, d) -> DataFrame:
    """Events of one scan per order: F completes and O fails an hour and a half later, P stays pending. Updates of unknown scans do nothing."""
    orders = _t(spark, d, "orders")
    key, later = F.col("o_orderkey"), F.col("at")
    uploads = orders.select(key.alias("scan_id"), names.upload_name(F.col("o_orderdate"), F.lit(".png"), key.cast("string")).alias("filename"), "o_orderdate")
    made = ledger.create_events(uploads, F.col("o_orderdate"), 0)
    ok = F.col("o_orderstatus") == "F"
    changes = orders.where("o_orderstatus IN ('F', 'O')").select(
        F.explode(F.array(key, -1 - key)).alias("scan_id"),
        F.when(ok, gates.COMPLETED).otherwise(gates.failed_status(F.col("o_orderpriority"))).alias("status"),
        F.when(ok, F.col("o_orderpriority")).alias("text_content"),
        F.when(ok, names.docx_name(key, F.col("o_orderdate"))).alias("docx_path"),
        (F.col("o_orderdate") + F.expr("INTERVAL 90 MINUTES")).alias("at"),
    )
    return made.unionByName(ledger.update_events(changes, later, 1))


def ledger_response(spark, d):
    """Insert, update, latest state and JSON of five or seven keys, through the ledger's own functions."""
    return ledger.status_response(ledger.scans(_order_ledger(spark, d)))


def download_listing(spark, d):
    """Every known and as many unknown scans asked for, against a listing that holds the documents of odd ids."""
    scans = ledger.scans(_order_ledger(spark, d))
    files = scans.where("docx_path IS NOT NULL AND id % 2 = 1").select(F.col("docx_path").alias("path"))
    return gates.download_requests(_asked(_t(spark, d, "orders")), scans, files)


def upload_gate(spark, d):
    kind = F.when(F.col("event_type") == "click", "text/plain").when(F.col("event_type") == "view", F.lit("image/png")).otherwise("image/jpeg")
    return _t(spark, d, "events").select("event_id", gates.upload_code(kind, F.col("event_type") != "error", F.col("value") > 10).alias("code"))


def text_fallback(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.shown_text(F.col("text")).alias("shown"))


def failed_status(spark, d):
    failed = _t(spark, d, "events").where("event_type = 'error'").select("event_id", gates.failed_status(F.col("props")).alias("status"))
    return failed.where(gates.is_terminal(F.col("status")))


def preprocess_path(spark, d):
    return _t(spark, d, "pages").select("page_id", names.preprocessed_path(F.col("url")).alias("path"))


def docx_name(spark, d):
    return _t(spark, d, "events").select("event_id", names.docx_name(F.col("event_id"), F.col("ts")).alias("path"))


def status_label(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", gates.status_label(F.col("o_orderkey"), F.col("o_orderstatus")).alias("label"))


def parse_id(spark, d):
    return _t(spark, d, "pages").select("page_id", F.coalesce(names.parse_id(names.basename(F.col("url"))), F.lit(-1)).cast("long").alias("number"))


def docx_paragraph_count(spark, d):
    return _t(spark, d, "documents").select("doc_id", (F.size(text.paragraph_array(F.col("text"))) + 1).alias("paragraphs"))


def docx_build(spark, d):
    """Paragraphs counted in the built packages, read back."""

    @F.pandas_udf("int")
    def count(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: len(docx.read_docx(x)[0]))

    built = docx.with_docx(_t(spark, d, "documents").select("doc_id", "text"))
    return built.select("doc_id", count(F.col("docx.value")).alias("paragraphs"))


def docx_content(spark, d):
    """Title, paragraphs and the sizes of their runs (in half points) of the built packages, read back."""

    kind = "struct<title:string,texts_sha256:string,runs:int,sizes:string>"

    def content(raw: pa.Array) -> pa.Array:
        rows = []
        for x in raw:
            texts, sizes = docx.read_docx(x.as_py())
            digest = hashlib.sha256("\n".join(texts[1:]).encode()).hexdigest()  # in place of the text, which would be held for the whole batch
            rows.append({"title": texts[0], "texts_sha256": digest, "runs": len(sizes), "sizes": ",".join(map(str, sorted(set(sizes))))})
        return pa.array(rows, pa.struct({"title": pa.string(), "texts_sha256": pa.string(), "runs": pa.int32(), "sizes": pa.string()}))

    content = F.arrow_udf(content, kind)
    built = docx.with_docx(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", content(F.col("docx.value")).alias("c"))
    return built.select("doc_id", "c.title", "c.texts_sha256", "c.runs", "c.sizes")


#: Small pages that a task cleans: some seconds of work.
PAGES_A_TASK = 250


def preprocess_pixels(spark, d):
    """The cleaning chain on a page of each embedding: pixel (i, j) is the sum of its i-th value and of the j-th of its second half.

    A vector that is null or has fewer than two values gives no page, and the row carries the error.
    """
    v = F.col("embedding")
    side = F.floor(F.size(v) / 2).cast("int")
    gray = lambda a, b: F.lpad(F.hex(F.pmod(F.floor((a + b) * 1000), F.lit(256))), 2, "0")
    half = lambda first: F.slice(v, first, F.greatest(side, F.lit(0)))
    data = F.unhex(F.array_join(F.flatten(F.transform(half(F.lit(1)), lambda a: F.transform(half(F.greatest(side, F.lit(0)) + 1), lambda b: gray(a, b)))), ""))
    # Cleaning a page takes far longer than making it, so pages are dealt evenly before it, to as many tasks as they need. They are made before they are dealt: the
    # optimizer left the call of Python in the plan, where it can't run, when its argument held these lambdas above a repartition.
    vectors = _t(spark, d, "embeddings").select("vec_id", "embedding")
    tasks = max(spark.sparkContext.defaultParallelism, -(-vectors.count() // PAGES_A_TASK))
    pages = vectors.select("vec_id", F.struct(side.alias("height"), side.alias("width"), F.lit(1).alias("channels"), data.alias("data")).alias("pixels")).repartition(tasks, "vec_id")
    out = pages.select("vec_id", images.clean_pixels("pixels").alias("c"))
    return out.select("vec_id", F.col("c.value.height").alias("height"), F.col("c.value.width").alias("width"), F.sha2("c.value.data", 256).alias("pixels_sha256"), F.col("c.error").alias("error"))


def download_content(spark, d):
    """Every document's package written as a file, all or nothing, and downloaded: the name, and what the file holds."""

    def content(raw: pa.Array) -> pa.Array:
        rows = []
        for x in raw:
            texts = docx.read_docx(x.as_py())[0]
            rows.append({"title": texts[0], "texts_sha256": hashlib.sha256("\n".join(texts[1:]).encode()).hexdigest()})  # in place of the text, which would be held for the whole batch
        return pa.array(rows, pa.struct({"title": pa.string(), "texts_sha256": pa.string()}))

    content = F.arrow_udf(content, "struct<title:string,texts_sha256:string>")
    folder = scratch(spark)
    docs = _t(spark, d, "documents").select("doc_id", "text")
    name = F.concat(F.lit("outputs/scan_"), F.col("doc_id").cast("string"), F.lit(".docx"))
    sink.write_all(docx.with_docx(docs).select(name.alias("path"), F.col("docx.value").alias("value")), folder)
    files = docx.downloads(docs.select(name.alias("path")), folder)
    number = F.regexp_extract("download_name", r"_(-?\d+)\.docx$", 1).cast("long")
    return files.select(number.alias("doc_id"), "download_name", content("content").alias("c")).select("doc_id", "download_name", "c.title", "c.texts_sha256")


def _stacked(spark, d) -> DataFrame:
    """Pages of up to 1,024 rows of 64 BGR pixels: row y is the y-th vector of the page by vec_id; vectors of another length, or with a null, are left out."""
    byte = lambda v: F.lpad(F.hex(F.pmod(v, F.lit(256))), 2, "0")
    kept = _t(spark, d, "embeddings").where((F.size("embedding") == 64) & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e)))
    line = F.array_join(F.transform("embedding", lambda e: F.concat(*(byte(f(F.floor(e.cast("double") * 1000).cast("long"))) for f in (lambda v: v, lambda v: F.floor(v / 7).cast("long"), lambda v: 3 * v + 11)))), "")
    rows = kept.select(F.floor(F.col("vec_id") / 1024).cast("long").alias("id"), "vec_id", line.alias("line"))
    pages = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "line"))).alias("lines"))
    return pages.select("id", F.size("lines").alias("height"), F.lit(64).alias("width"), F.lit(3).alias("channels"), F.unhex(F.array_join(F.transform("lines", lambda r: r["line"]), "")).alias("data"))


def gray_blur_pages(spark, d):
    """Gray and blur, in tiles, of stacked vectors."""
    return tiles.tiled(_stacked(spark, d), "blur", 48).select(F.col("id").alias("page"), "height", "width", F.sha2("data", 256).alias("pixels_sha256"))


def clean_in_tiles(spark, d):
    """The whole chain on stacked vectors, in tiles, beside the untiled one."""
    pages = written(_stacked(spark, d))
    whole = pages.repartition("id").select("id", images.clean_pixels(F.struct("height", "width", "channels", "data")).alias("c")).select("id", F.sha2("c.value.data", 256).alias("whole"))
    made = tiles.tiled(pages, "clean", 48).select("id", "height", "width", F.sha2("data", 256).alias("pixels_sha256"))
    return made.join(whole, "id").select(F.col("id").alias("page"), "height", "width", "pixels_sha256", (F.col("pixels_sha256") == F.col("whole")).alias("as_whole"))


def _small_pages(spark, d, height: int, width: int) -> DataFrame:
    """(vec_id, pixels) of vectors of 64 components: a gray page of that size, filled row by row."""
    kept = _t(spark, d, "embeddings").where((F.size("embedding") == height * width) & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e)))
    line = F.array_join(F.transform("embedding", lambda e: F.lpad(F.hex(F.pmod(F.floor(e.cast("double") * 1000).cast("long"), F.lit(256))), 2, "0")), "")
    return kept.select("vec_id", F.struct(F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(1).alias("channels"), F.unhex(line).alias("data")).alias("pixels"))


def oriented_pages(spark, d):
    """A page of 4 rows of each vector, turned by one of the eight orientations."""
    pages = _small_pages(spark, d, 4, 16)
    made = pages.select("vec_id", images.turned("pixels", (F.pmod("vec_id", F.lit(8)) + 1).cast("int")).alias("p"))
    return made.select("vec_id", "p.height", "p.width", F.lower(F.hex("p.data")).alias("pixels"))


def jpeg_blocks(spark, d):
    """The quantised coefficients of each vector as one 8 x 8 block, and whether what they restore stays within the quantiser's bound."""

    @F.pandas_udf("struct<coefficients:string,within:boolean>")
    def run(pages: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for data in pages["data"]:
            page = np.frombuffer(data, np.uint8).reshape(8, 8)
            off = np.abs(jpeg.lossy(page).astype(int) - page).max()
            rows.append((",".join(map(str, jpeg.coefficients(page).ravel().tolist())), bool(off <= jpeg.bound())))
        return pd.DataFrame(rows, columns=["coefficients", "within"])

    return _small_pages(spark, d, 8, 8).select("vec_id", run("pixels").alias("c")).select("vec_id", "c.*")


#: Small files that a task writes.
FILES_A_TASK = 250


def _dealt(pages: DataFrame) -> DataFrame:
    """Pages dealt evenly to as many tasks as their files need: writing a file takes far longer than reading its vector."""
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, -(-pages.count() // FILES_A_TASK))
    return pages.repartition(tasks, "vec_id")


_EXTENSIONS = (".png", ".jpg", ".bmp", ".tiff", ".xyz", ".JPEG")


def encoded_pages(spark, d):
    """A page of each vector written as a file of one of six extensions and read back by Spark's image source: lossless ones return every pixel,
    JPEG what quantisation leaves, within one gray; an extension that can't be written gives the error."""
    folder = scratch(spark)
    ext = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.pmod("vec_id", F.lit(len(_EXTENSIONS))) + 1).cast("int"))
    pages = written(_dealt(_small_pages(spark, d, 8, 8)).withColumn("ext", ext).withColumn("file", images.encoded_page("pixels", "ext")))
    clean = F.struct(F.col("pixels").alias("value"), F.lit(None).cast("string").alias("error"))
    seen = pages.select("vec_id", "ext", F.col("file.error").alias("error"), images.as_written(clean, "ext").alias("seen"))
    sink.write_all(pages.select(F.concat(F.lit("p"), F.col("vec_id").cast("string"), "ext").alias("path"), F.col("file.value").alias("value")), folder)
    back = images.read_decoded(spark, folder).select(F.regexp_extract("path", r"p(-?\d+)\.\w+$", 1).cast("long").alias("_id"), F.col("pixels").alias("back"))

    @F.pandas_udf("int")
    def off(a: pd.Series, b: pd.Series, channels: pd.Series) -> pd.Series:
        gray = lambda x, c: np.frombuffer(x, np.uint8).reshape(-1, int(c))[:, 0].astype(int)
        return pd.Series([None if x is None or y is None else int(np.abs(gray(x, 1) - gray(y, c)).max()) for x, y, c in zip(a, b, channels)], dtype="Int32")

    joined = seen.join(back, F.col("vec_id") == F.col("_id"), "left").withColumn("off", off("seen.value.data", "back.data", "back.channels"))
    kept = F.when(F.col("error").isNotNull(), F.col("_id").isNull()).when(F.lower("ext").isin(*images.LOSSY), F.col("off") <= 1).otherwise(F.col("off") == 0)
    return joined.select("vec_id", "ext", "error", F.col("error").eqNullSafe(F.col("seen.error")).alias("same_error"), F.coalesce(kept, F.lit(False)).alias("kept"))


_LANDED = (".png", ".txt", ".bmp", ".tiff", ".gif", ".PNG")


def digitize_stream(spark, d):
    """The whole plan as a stream: a file of each vector's page lands, is judged, cleaned, handed to a stand-in for the engine, written as a document and answered
    by the ledger; then every document is downloaded. Text files and damaged ones (.PNG) are refused, an extension without a writer fails."""
    folder = scratch(spark)
    ext = F.element_at(F.array(*map(F.lit, _LANDED)), (F.pmod("vec_id", F.lit(len(_LANDED))) + 1).cast("int"))
    pages = _dealt(_small_pages(spark, d, 4, 16)).withColumn("ext", ext)
    file = images.encoded_page("pixels", F.when(F.col("ext").isin(".txt", ".gif"), ".png").otherwise(F.lower("ext"))).getField("value")
    gif = F.unhex(F.lit("47494638396101000100800000000000ffffff2c00000000010001000002024401003b"))
    content = F.when(F.col("ext") == ".gif", gif).when(F.col("ext") == ".PNG", F.substring(file, 1, 40)).otherwise(file)
    sink.write_all(pages.select(F.concat(F.lit("v"), F.col("vec_id").cast("string"), "ext").alias("path"), content.alias("value")), f"{folder}/landing")
    book = ledger.Ledger(spark, f"{folder}/ledger")
    ingest.start(spark, f"{folder}/landing", book, f"{folder}/out", f"{folder}/checkpoint", f"{folder}/rejects", "page_size", PageSize, 2000).awaitTermination()

    @F.pandas_udf("string")
    def texts(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: "|".join(docx.read_docx(x)[0]))

    scans = written(book.scans(None))
    written_files = docx.downloads(scans.select("docx_path"), f"{folder}/out", "docx_path").select(F.col("path").alias("docx_path"), texts("content").alias("paragraphs"))
    answered = scans.join(written_files, "docx_path", "left")
    none = F.lit(None).cast("string")
    refused = spark.read.parquet(f"{folder}/rejects").select(names.basename(F.col("path")).alias("name"), "code", none.alias("status"), none.alias("text_content"), none.alias("paragraphs"))
    return answered.select(names.basename(F.col("filename")).alias("name"), F.lit(201).alias("code"), "status", "text_content", "paragraphs").unionByName(refused)


_UPLOAD = "'upload_' || strftime(ts, '%Y%m%d_%H%M%S') || '.png'"
_BLANK = r"[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_EXT = r"regexp_extract(url, '[^./][^/]*(\.[^./]*)\z', 1)"
_PARAGRAPHS = """WITH p AS (SELECT doc_id, [x FOR x IN string_split({text}, chr(10)) IF regexp_matches(x, '{blank}')] AS a FROM documents)
SELECT doc_id, unnest(range(len(a)))::int AS para_no, unnest(a) AS text FROM p"""

_ALL = {
    "content_type_gate": (content_type_gate, "SELECT page_id, url FROM pages WHERE starts_with(url, 'https://')"),
    "filename_ext": (filename_ext, f"SELECT page_id, url, {_EXT} AS ext FROM pages"),
    "basename": (basename, "SELECT page_id, url, split_part(url, '/', -1) AS base FROM pages"),
    "dirname": (dirname, r"""WITH h AS (SELECT page_id, left(url, length(url) - length(split_part(url, '/', -1))) AS h FROM pages)
        SELECT page_id, CASE WHEN regexp_matches(h, '^/*\z') THEN h ELSE regexp_replace(h, '/+\z', '') END AS dir FROM h"""),
    "create_records": (create_records, f"SELECT event_id AS id, {_UPLOAD} AS filename, 'Pending' AS status FROM events"),
    "last_write_wins": (last_write_wins, f"SELECT {_UPLOAD} AS filename, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1"),
    "current_status": (current_status, "SELECT user_id, event_id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "update_status": (update_status, "SELECT o_orderkey, CASE WHEN o_orderkey = 17 THEN 'Failed: x' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey <> 17 THEN o_orderpriority END AS text_content FROM orders"),
    "get_by_id": (get_by_id, "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 17"),
    "status_response": (status_response, "SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS text_content FROM orders"),
    "status_json": (status_json, """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN json_object('id', o_orderkey, 'status', o_orderstatus, 'text_content', o_orderpriority)::varchar
        ELSE json_object('id', o_orderkey, 'status', o_orderstatus)::varchar END AS body FROM orders"""),
    "join_fragments": (join_fragments, "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"),
    "paragraphs": (paragraphs, _PARAGRAPHS.format(text="text", blank=_BLANK)),
    "paragraphs_blank": (paragraphs_blank, _PARAGRAPHS.format(text="replace(text, '. ', '.' || chr(10) || ' ' || chr(10))", blank=_BLANK)),
    "download_gate": (download_gate, """SELECT r.id, CASE WHEN o_orderkey IS NULL THEN 404 WHEN o_orderstatus <> 'F' THEN 400 WHEN o_orderkey % 2 <> 1 THEN 404 ELSE 200 END AS code
        FROM (SELECT o_orderkey AS id FROM orders UNION ALL SELECT -1 - o_orderkey FROM orders) r LEFT JOIN orders ON r.id = o_orderkey"""),
    "ledger_response": (ledger_response, """SELECT o_orderkey AS id, CASE o_orderstatus
        WHEN 'F' THEN json_object('id', o_orderkey, 'filename', n, 'status', 'Completed', 'created_at', c, 'updated_at', u, 'text_content', o_orderpriority, 'docx_path', p)::varchar
        WHEN 'O' THEN json_object('id', o_orderkey, 'filename', n, 'status', 'Failed: ' || o_orderpriority, 'created_at', c, 'updated_at', u)::varchar
        ELSE json_object('id', o_orderkey, 'filename', n, 'status', 'Pending', 'created_at', c, 'updated_at', c)::varchar END AS body
        FROM (SELECT *, 'upload_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_' || o_orderkey || '.png' AS n, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS c,
          strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS u, 'outputs/scan_' || o_orderkey || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.docx' AS p FROM orders)"""),
    "download_listing": (download_listing, """SELECT id, code, CASE WHEN code = 200 THEN 'outputs/' || n END AS path, CASE WHEN code = 200 THEN n END AS download_name FROM (
        SELECT r.id, CASE WHEN o_orderkey IS NULL THEN 404 WHEN o_orderstatus <> 'F' THEN 400 WHEN o_orderkey % 2 <> 1 THEN 404 ELSE 200 END AS code,
          'scan_' || o_orderkey || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.docx' AS n
        FROM (SELECT o_orderkey AS id FROM orders UNION ALL SELECT -1 - o_orderkey FROM orders) r LEFT JOIN orders ON r.id = o_orderkey)"""),
    "upload_gate": (upload_gate, "SELECT event_id, CASE WHEN event_type = 'click' THEN 400 WHEN event_type = 'error' THEN 500 WHEN value > 10 THEN 201 ELSE 400 END AS code FROM events"),
    "text_fallback": (text_fallback, "SELECT doc_id, coalesce(nullif(text, ''), 'Không có nội dung') AS shown FROM documents"),
    "failed_status": (failed_status, "SELECT event_id, 'Failed: ' || props AS status FROM events WHERE event_type = 'error' AND starts_with('Failed: ' || props, 'Failed')"),
    "preprocess_path": (preprocess_path, f"SELECT page_id, left(url, length(url) - length({_EXT})) || '_preprocessed' || {_EXT} AS path FROM pages"),
    "docx_name": (docx_name, "SELECT event_id, 'outputs/scan_' || event_id || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '.docx' AS path FROM events"),
    "status_label": (status_label, "SELECT o_orderkey, 'ID: ' || o_orderkey || ' - ' || o_orderstatus AS label FROM orders"),
    "parse_id": (parse_id, "SELECT page_id, coalesce(try_cast(split_part(url, '/', -1) AS bigint), -1)::bigint AS number FROM pages"),
    "docx_paragraph_count": (docx_paragraph_count, f"SELECT doc_id, (len([x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{_BLANK}')]) + 1)::int AS paragraphs FROM documents"),
    "docx_build": (docx_build, f"SELECT doc_id, (len([x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{_BLANK}')]) + 1)::int AS paragraphs FROM documents"),
    "docx_content": (docx_content, f"""WITH p AS (SELECT doc_id, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{_BLANK}')] AS a FROM documents)
        SELECT doc_id, 'OCR Extracted Text' AS title, sha256(array_to_string(a, chr(10))) AS texts_sha256, len(a)::int AS runs, CASE WHEN len(a) > 0 THEN '24' ELSE '' END AS sizes FROM p"""),
    "preprocess_pixels": (preprocess_pixels, None),
    "clean_in_tiles": (clean_in_tiles, None),
    "download_content": (download_content, f"""WITH p AS (SELECT doc_id, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{_BLANK}')] AS a FROM documents)
        SELECT doc_id, 'scan_' || doc_id || '.docx' AS download_name, 'OCR Extracted Text' AS title, sha256(array_to_string(a, chr(10))) AS texts_sha256 FROM p"""),
    "oriented_pages": (oriented_pages, """WITH p AS (SELECT vec_id, ((vec_id % 8) + 8) % 8 + 1 AS o, [((floor(e::DOUBLE * 1000)::BIGINT % 256) + 256) % 256 FOR e IN embedding] AS a FROM embeddings
          WHERE len(embedding) = 64 AND list_bool_and([coalesce(NOT isnan(e), false) FOR e IN embedding])),
        q AS (SELECT vec_id, o, a, CASE WHEN o < 5 THEN 4 ELSE 16 END AS h, CASE WHEN o < 5 THEN 16 ELSE 4 END AS w FROM p),
        i AS (SELECT vec_id, o, a, h, w, k // w AS y, k % w AS x FROM q, range(64) r(k))
        SELECT vec_id, h::INT AS height, w::INT AS width, string_agg(printf('%02x', a[1 + CASE o WHEN 1 THEN y * 16 + x WHEN 2 THEN y * 16 + 15 - x WHEN 3 THEN (3 - y) * 16 + 15 - x WHEN 4 THEN (3 - y) * 16 + x
          WHEN 5 THEN x * 16 + y WHEN 6 THEN (3 - x) * 16 + y WHEN 7 THEN (3 - x) * 16 + 15 - y ELSE x * 16 + 15 - y END]), '' ORDER BY y, x) AS pixels FROM i GROUP BY vec_id, h, w"""),
    "encoded_pages": (encoded_pages, """WITH e AS (SELECT vec_id, ['.png', '.jpg', '.bmp', '.tiff', '.xyz', '.JPEG'][1 + ((vec_id % 6) + 6) % 6] AS ext FROM embeddings
          WHERE len(embedding) = 64 AND list_bool_and([coalesce(NOT isnan(x), false) FOR x IN embedding]))
        SELECT vec_id, ext, CASE ext WHEN '.xyz' THEN 'no image can be written as ''.xyz''' END AS error, true AS same_error, true AS kept FROM e"""),
    "jpeg_blocks": (jpeg_blocks, f"""WITH q(t) AS (VALUES ({[list(r) for r in jpeg.LUMINANCE]})),
        p AS (SELECT vec_id, k // 8 AS y, k % 8 AS x, ((floor(embedding[k + 1]::DOUBLE * 1000)::BIGINT % 256) + 256) % 256 - 128 AS v FROM embeddings, range(64) r(k)
          WHERE len(embedding) = 64 AND list_bool_and([coalesce(NOT isnan(e), false) FOR e IN embedding])),
        c AS (SELECT k // 8 AS u, k % 8 AS x, cos((2 * (k % 8) + 1) * (k // 8) * pi() / 16) / 2 / CASE WHEN k < 8 THEN sqrt(2) ELSE 1 END AS w FROM range(64) r(k)),
        halves AS MATERIALIZED (SELECT vec_id, y, u AS v, sum(p.v * w) AS s FROM p JOIN c USING (x) GROUP BY ALL),
        f AS (SELECT vec_id, c.u AS u, halves.v AS v, sum(s * w) AS s FROM halves JOIN c ON c.x = halves.y GROUP BY ALL)
        SELECT vec_id, string_agg(floor(s / greatest(1, (t[u + 1][v + 1] * {200 - 2 * jpeg.QUALITY} + 50) // 100) + 0.5 + 1e-6)::INT::VARCHAR, ',' ORDER BY u, v) AS coefficients, true AS within FROM f, q GROUP BY vec_id"""),
    "digitize_stream": (digitize_stream, """WITH e AS (SELECT vec_id, ['.png', '.txt', '.bmp', '.tiff', '.gif', '.PNG'][1 + ((vec_id % 6) + 6) % 6] AS ext FROM embeddings
          WHERE len(embedding) = 64 AND list_bool_and([coalesce(NOT isnan(x), false) FOR x IN embedding]))
        SELECT 'v' || vec_id || ext AS name, CASE WHEN ext IN ('.txt', '.PNG') THEN 400 ELSE 201 END AS code,
          CASE WHEN ext IN ('.png', '.bmp', '.tiff') THEN 'Completed' WHEN ext = '.gif' THEN 'Failed: no image can be written as ' || chr(39) || '.gif' || chr(39) END AS status,
          CASE WHEN ext IN ('.png', '.bmp', '.tiff') THEN '4 rows' || chr(10) || ' ' || chr(10) || '16 columns' END AS text_content,
          CASE WHEN ext IN ('.png', '.bmp', '.tiff') THEN 'OCR Extracted Text|4 rows|16 columns' END AS paragraphs FROM e"""),
    "gray_blur_pages": (gray_blur_pages, """WITH v AS (SELECT vec_id // 1024 AS page, row_number() OVER (PARTITION BY vec_id // 1024 ORDER BY vec_id) - 1 AS y, embedding FROM embeddings
          WHERE len(embedding) = 64 AND list_bool_and([coalesce(NOT isnan(e), false) FOR e IN embedding])),
        p AS (SELECT page, y, unnest(range(64)) AS x, unnest([floor(e::DOUBLE * 1000)::BIGINT FOR e IN embedding]) AS v FROM v),
        b AS (SELECT page, y, x, ((v % 256) + 256) % 256 AS b, ((floor(v / 7)::BIGINT % 256) + 256) % 256 AS g, (((3 * v + 11) % 256) + 256) % 256 AS r FROM p),
        gray AS MATERIALIZED (SELECT page, y, x, (9798 * r + 19235 * g + 3735 * b + 16384) >> 15 AS v, count(*) OVER (PARTITION BY page, x) AS h FROM b),
        taps(k, w) AS (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)),
        a AS MATERIALIZED (SELECT g.page, g.y, g.x, g.h, sum(w * s.v) AS v FROM gray g, taps JOIN gray s ON s.page = g.page AND s.y = g.y AND s.x = CASE WHEN g.x + k < 0 THEN -(g.x + k) WHEN g.x + k > 63 THEN 126 - g.x - k ELSE g.x + k END GROUP BY ALL),
        c AS (SELECT g.page, g.y, g.x, g.h, ((sum(w * s.v) + 128) // 256)::INT AS v FROM a g, taps JOIN a s ON s.page = g.page AND s.x = g.x
          AND s.y = CASE WHEN g.h < 3 THEN greatest(0, least(g.h - 1, g.y + k)) WHEN g.y + k < 0 THEN -(g.y + k) WHEN g.y + k >= g.h THEN 2 * g.h - 2 - g.y - k ELSE g.y + k END GROUP BY ALL)
        SELECT page, max(h)::INT AS height, 64 AS width, sha256(unhex(string_agg(printf('%02x', v), '' ORDER BY y, x))) AS pixels_sha256 FROM c GROUP BY page"""),
    "ledger_replay": (ledger_replay, """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS status, arg_min(event_id, (ts, event_id)) AS first_id
        FROM events GROUP BY user_id"""),
    "stream_ledger": (stream_ledger, """SELECT 'order_' || o_orderkey || '.png' AS filename, CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Failed: ' || o_orderpriority ELSE 'Pending' END AS status,
        o_orderdate AS created_at, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderdate + INTERVAL 90 MINUTE ELSE o_orderdate END AS updated_at,
        CASE o_orderstatus WHEN 'F' THEN o_orderpriority END AS text_content, true AS dense_ids FROM orders"""),
    "poll_outcomes": (poll_outcomes, """WITH u AS (SELECT user_id * 100 + day(ts) AS scan_id, CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'error' THEN 'Failed: error' ELSE 'Pending' END AS status, ts FROM events),
        s AS (SELECT *, row_number() OVER w AS n, lead(ts) OVER w AS next, max(ts) OVER () AS top FROM u WINDOW w AS (PARTITION BY scan_id ORDER BY ts, status)),
        e AS (SELECT scan_id, n, ts, status, CASE WHEN status <> 'Pending' THEN status WHEN next > ts + INTERVAL 6 HOUR THEN 'Stalled'
          WHEN next IS NULL AND epoch_ms(ts) + 21600000 < epoch_ms(top) THEN 'Stalled' END AS outcome FROM s)
        SELECT scan_id, arg_min(outcome, n) AS outcome, min(n) AS polls, arg_min(CASE outcome WHEN 'Stalled' THEN ts + INTERVAL 6 HOUR ELSE ts END, n) AS at FROM e WHERE outcome IS NOT NULL GROUP BY scan_id"""),
    "sql_statements": (sql_statements, """SELECT o_orderkey AS id, 'it''s ' || o_orderkey AS filename, CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Failed: ' || o_orderpriority ELSE 'Pending' END AS status,
        o_orderdate AS created_at, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderdate + INTERVAL 90 MINUTE ELSE o_orderdate END AS updated_at, CASE o_orderstatus WHEN 'F' THEN o_orderpriority END AS text_content FROM orders"""),
    "dense_ids": (dense_ids, """SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey,
        row_number() OVER (ORDER BY l_shipdate NULLS FIRST, l_orderkey NULLS FIRST, l_linenumber NULLS FIRST, l_partkey NULLS FIRST) AS id FROM lineitem"""),
}


def queries() -> dict:
    return {name: query for name, (query, _) in _ALL.items()} | {"scan_view": flagship}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _ALL.items() if sql} | {
        "scan_view": f"""SELECT doc_id AS id, 'upload_' || doc_id || '.png' AS filename, 'Completed' AS status, TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at,
        array_to_string([x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{_BLANK}')], chr(10)) AS text_content, 'outputs/scan_' || doc_id || '_20240101_000000.docx' AS docx_path FROM documents"""
    }
