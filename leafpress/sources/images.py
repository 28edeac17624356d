"""Image records: binary source, validity, decoding and cleaning."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.functions import jpeg, kernels

MAX_BYTES = 256 << 20
OPEN_COST = 256 << 10
UPLOAD = "path string, modificationTime timestamp, length long, content binary"
PIXELS = "struct<height:int,width:int,channels:int,data:binary>"
CLEANED = "struct<value:struct<height:int,width:int,channels:int,data:binary>,error:string>"


def read_uploads(spark: SparkSession, folder: str, streaming: bool = False, max_files: int = 100) -> DataFrame:
    """Landing folder as (path, modificationTime, length, content); pruning path columns skips the content. A file that vanishes before it is read has no row."""
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", str(MAX_BYTES))
    # A batch of a stream names its files one by one; Spark would look each up in a task of its own.
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(spark.sparkContext.defaultParallelism))
    # A small file costs a task about as much as so many bytes of a large one; by Spark's default a task reads at most 32, however small.
    spark.conf.set("spark.sql.files.openCostInBytes", str(OPEN_COST))
    if streaming:
        return spark.readStream.format("binaryFile").schema(UPLOAD).option("maxFilesPerTrigger", max_files).option("ignoreMissingFiles", "true").load(folder)
    return spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(folder)


def read_decoded(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """Decoded images as (path, pixels); undecodable files have height -1, and one that vanishes meanwhile has no row."""
    if not folder:
        return spark.createDataFrame([], f"path string, pixels {PIXELS}")
    i = F.col("image")
    pixels = F.struct(i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("channels"), i["data"].alias("data"))
    # The two sources write an empty authority differently: file:/// and file:/.
    path = F.regexp_replace(i["origin"], r"^(\w+):///", "$1:/")
    return spark.read.format("image").option("ignoreMissingFiles", "true").load(folder).select(path.alias("path"), pixels.alias("pixels"))


def content_type(path: Column) -> Column:
    """The media type that a file name's extension suggests, else application/octet-stream."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)\z", 1))
    kinds = F.create_map(*[F.lit(x) for kv in (("png", "image/png"), ("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("gif", "image/gif"), ("bmp", "image/bmp"), ("webp", "image/webp"), ("tif", "image/tiff"), ("tiff", "image/tiff")) for x in kv])
    return F.coalesce(F.try_element_at(kinds, ext), F.lit("application/octet-stream"))


def _png(raw: bytes) -> bool:
    at, seen_end, data = 8, False, False
    while at + 12 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        end = at + 12 + size
        if end > len(raw) or zlib.crc32(raw[at + 4 : end - 4]) != struct.unpack(">I", raw[end - 4 : end])[0]:
            return False
        if at == 8 and (kind != b"IHDR" or size != 13):
            return False
        data |= kind == b"IDAT"
        at = end
        if kind == b"IEND":
            seen_end = True
            break
    return seen_end and data


def _jpeg(raw: bytes) -> bool:
    at, frame = 2, False
    while at + 4 <= len(raw):
        if raw[at] != 0xFF:
            return False
        mark = raw[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xDA:
            return frame and raw.rstrip(b"\0").endswith(b"\xff\xd9")
        if mark == 0x01 or 0xD0 <= mark <= 0xD8:
            at += 2
            continue
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        at += 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    return False


def _tiff(raw: bytes, order: str) -> bool:
    """The chain of directories lies inside the file, and the first one holds entries."""
    (at,) = struct.unpack(f"{order}I", raw[4:8])
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack(f"{order}H", raw[at : at + 2])
        if not n or at + 2 + 12 * n + 4 > len(raw):
            return False
        (at,) = struct.unpack(f"{order}I", raw[at + 2 + 12 * n : at + 6 + 12 * n])
    return bool(seen) and not at


def is_valid_image(raw: bytes | None) -> bool:
    """Structural check: chunk checksums of PNG, the marker walk of JPEG, the directories of TIFF, headers of GIF, BMP and WebP. Never raises."""
    try:
        if not raw:
            return False
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
        if raw[:2] == b"\xff\xd8":
            return _jpeg(raw)
        if raw[:6] in (b"GIF87a", b"GIF89a"):
            return len(raw) > 13 and raw.rstrip(b"\0").endswith(b";")
        if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
            return raw[12:15] == b"VP8" and 8 + struct.unpack("<I", raw[4:8])[0] <= len(raw)
        if raw[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(raw, "<" if raw[:1] == b"I" else ">")
        if raw[:2] == b"BM":
            return len(raw) >= struct.unpack("<I", raw[2:6])[0] > 26
    except (struct.error, IndexError):
        pass
    return False


def _exif_orientation(tiff: bytes) -> int:
    """The orientation in a TIFF directory, of either byte order; 1 if it has none."""
    order = {b"II": "<", b"MM": ">"}[tiff[:2]]
    (at,) = struct.unpack(f"{order}I", tiff[4:8])
    (n,) = struct.unpack(f"{order}H", tiff[at : at + 2])
    for k in range(n):
        tag, kind, count = struct.unpack(f"{order}HHI", tiff[at + 2 + 12 * k : at + 10 + 12 * k])
        if tag == 0x0112 and kind == 3 and count == 1:
            (value,) = struct.unpack(f"{order}H", tiff[at + 10 + 12 * k : at + 12 + 12 * k])
            return value if 1 <= value <= 8 else 1
    return 1


def orientation_of(raw: bytes | None) -> int:
    """The orientation (1 to 8) that a JPEG's APP1 segment or a TIFF file notes; 1 for all else. Never raises."""
    try:
        if raw and raw[:4] in (b"II*\0", b"MM\0*"):
            return _exif_orientation(raw)
        if not raw or raw[:2] != b"\xff\xd8":
            return 1
        at = 2
        while at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] not in (0xDA, 0xD9):
            if raw[at + 1] == 0xFF or raw[at + 1] == 0x01 or 0xD0 <= raw[at + 1] <= 0xD8:
                at += 1 if raw[at + 1] == 0xFF else 2
                continue
            (size,) = struct.unpack(">H", raw[at + 2 : at + 4])
            if raw[at + 1] == 0xE1 and raw[at + 4 : at + 10] == b"Exif\0\0":
                return _exif_orientation(raw[at + 10 : at + 2 + size])
            at += 2 + size
    except (struct.error, KeyError, IndexError):
        pass
    return 1


def orientation(content: Column | str) -> Column:
    def read(raw: pd.Series) -> pd.Series:
        return raw.map(orientation_of).astype("int32")

    return F.pandas_udf(read, "int")(content)


def turned_row(row: tuple, orientation: int | None) -> tuple:
    """(height, width, channels, data) as they are to be seen."""
    h, w, c, data = row
    if orientation in range(2, 9) and data is not None and h > 0 and w > 0 and len(data) == h * w * c:
        made = kernels.oriented(np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(c)), int(orientation))
        h, w, data = *made.shape[:2], made.tobytes()
    return h, w, c, data


def turned(pixels: Column | str, orientation: Column | str) -> Column:
    """Pixels as they are to be seen; those that need no turn, or can't be turned, stay as they are."""

    def run(page: pd.DataFrame, how: pd.Series) -> pd.DataFrame:
        rows = [turned_row(r, o) for r, o in zip(page[["height", "width", "channels", "data"]].itertuples(index=False, name=None), how)]
        return pd.DataFrame(rows, columns=["height", "width", "channels", "data"]).astype({c: "Int32" for c in ("height", "width", "channels")})

    return F.pandas_udf(run, PIXELS)(pixels, orientation)


def valid_image(content: Column | str) -> Column:
    def check(raw: pd.Series) -> pd.Series:
        return raw.map(is_valid_image)

    return F.pandas_udf(check, "boolean")(content)


#: Pixels of equal pages that are cleaned as one stack.
STACK_PIXELS = 1 << 20


def clean_rows(rows: list[tuple]) -> list[dict]:
    """(height, width, channels, data) of pages to struct<value, error>; small pages of one size share the chain.

    Errors are values: a page that can't be cleaned carries the message.
    """
    out: list[dict] = [{}] * len(rows)
    alike: dict[tuple, list[int]] = {}
    for k, (h, w, c, data) in enumerate(rows):
        if pd.isna(h) or pd.isna(w) or not h > 0 or not w > 0:
            out[k] = {"value": None, "error": "image can't be decoded"}
        elif data is None or c not in (1, 3, 4) or len(data) != h * w * c:
            out[k] = {"value": None, "error": "pixels don't fill the image"}
        else:
            alike.setdefault((int(h), int(w), int(c)), []).append(k)
    for (h, w, c), places in alike.items():
        step = max(1, STACK_PIXELS // (h * w))
        for at in range(0, len(places), step):
            some = places[at : at + step]
            made = kernels.clean(np.stack([np.frombuffer(rows[k][3], np.uint8).reshape(h, w, c) for k in some]))
            for k, page in zip(some, made):
                out[k] = {"value": {"height": h, "width": w, "channels": 1, "data": page.tobytes()}, "error": None}
    return out


def clean_pixels(pixels: Column | str) -> Column:
    """struct<value pixels, error> of the cleaned page; all stages of the chain run in one pass over the batch."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(clean_rows(list(batch[["height", "width", "channels", "data"]].itertuples(index=False, name=None))), columns=["value", "error"])

    # Not to be moved into a filter or computed twice.
    return F.pandas_udf(run, CLEANED).asNondeterministic()(pixels)


def encode_png(height: int, width: int, data: bytes) -> bytes:
    """A single-channel PNG of the cleaned page."""
    rows = b"".join(b"\0" + data[k * width : (k + 1) * width] for k in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def encode_bmp(height: int, width: int, data: bytes) -> bytes:
    """A bitmap with a palette of 256 grays; rows from the last one up, each filled to four bytes."""
    palette = b"".join(bytes([k, k, k, 0]) for k in range(256))
    rows = b"".join(data[k * width : (k + 1) * width] + bytes(-width % 4) for k in range(height - 1, -1, -1))
    start = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", start + len(rows), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, len(rows), 2835, 2835, 256, 0) + palette + rows


def encode_tiff(height: int, width: int, data: bytes) -> bytes:
    """An uncompressed gray TIFF of one strip."""
    tags = ((256, 4, width), (257, 4, height), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, height), (279, 4, len(data)))
    at = 8 + len(data) + len(data) % 2
    entries = b"".join(struct.pack("<HHI", tag, kind, 1) + struct.pack("<I", value) for tag, kind, value in tags)
    return b"II*\0" + struct.pack("<I", at) + data + bytes(len(data) % 2) + struct.pack("<H", len(tags)) + entries + bytes(4)


def _jpeg_file(height: int, width: int, data: bytes) -> bytes:
    return jpeg.encode(np.frombuffer(data, np.uint8).reshape(height, width))


#: The writer of a page by the extension of its file.
WRITERS = {".png": encode_png, ".bmp": encode_bmp, ".tif": encode_tiff, ".tiff": encode_tiff, ".jpg": _jpeg_file, ".jpeg": _jpeg_file, ".jpe": _jpeg_file}
LOSSY = (".jpg", ".jpeg", ".jpe")


def encoded_page(page: Column | str, ext: Column | str) -> Column:
    """struct<value binary, error> of a cleaned page (CLEANED's value) as a file of that extension, whatever its case; an unknown one is an error."""

    @F.pandas_udf("struct<value:binary,error:string>")
    def run(pages: pd.DataFrame, exts: pd.Series) -> pd.DataFrame:
        rows = []
        for (h, w, data), e in zip(pages[["height", "width", "data"]].itertuples(index=False, name=None), exts):
            writer = WRITERS.get((e or "").lower())
            if data is None:
                rows.append((None, None))
            elif writer is None:
                rows.append((None, f"no image can be written as {e!r}"))
            else:
                rows.append((writer(int(h), int(w), data), None))
        return pd.DataFrame(rows, columns=["value", "error"])

    return run(page, ext)


def written_row(value: dict | None, error: str | None, ext: str | None) -> tuple[dict | None, str | None]:
    """A cleaned page (CLEANED) as a reader of its file sees it."""
    kind = (ext or "").lower()
    if error is None and value is not None and kind not in WRITERS:
        return None, f"no image can be written as {ext!r}"
    if value is not None and kind in LOSSY:
        page = np.frombuffer(value["data"], np.uint8).reshape(value["height"], value["width"])
        value = {**value, "data": jpeg.lossy(page).tobytes()}
    return value, error


def as_written(clean: Column | str, ext: Column | str) -> Column:
    """CLEANED as a reader of the written page sees it: JPEG loses some, the other formats nothing, and an extension that can't be written is the page's error."""

    def run(pages: pd.DataFrame, exts: pd.Series) -> pd.DataFrame:
        rows = [written_row(value, error, e) for (value, error), e in zip(pages[["value", "error"]].itertuples(index=False, name=None), exts)]
        return pd.DataFrame(rows, columns=["value", "error"])

    return F.pandas_udf(run, CLEANED).asNondeterministic()(clean, ext)


def seen_pixels(pixels: Column | str, orientation: Column | str, ext: Column | str) -> Column:
    """``turned``, ``clean_pixels`` and ``as_written`` in one call, so that pages of a task pass to Python and back once."""

    def run(page: pd.DataFrame, how: pd.Series, exts: pd.Series) -> pd.DataFrame:
        rows = [turned_row(r, o) for r, o in zip(page[["height", "width", "channels", "data"]].itertuples(index=False, name=None), how)]
        return pd.DataFrame([written_row(c["value"], c["error"], e) for c, e in zip(clean_rows(rows), exts)], columns=["value", "error"])

    return F.pandas_udf(run, CLEANED).asNondeterministic()(pixels, orientation, ext)
