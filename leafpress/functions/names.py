"""Path and file-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "yyyyMMdd_HHmmss"
#: The last dot of the last component, unless only dots stand before it.
EXTENSION = r"[^./][^/]*(\.[^./]*)\z"


def extension(path: Column) -> Column:
    """The suffix of the last path component with its dot, or ''."""
    return F.regexp_extract(path, EXTENSION, 1)


def stem(path: Column) -> Column:
    """The path without its extension."""
    return F.substring(path, F.lit(1), F.char_length(path) - F.char_length(extension(path)))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """What stands before the last slash; '' without one, '/' (or more slashes) for entries of the root."""
    head = F.substring(path, F.lit(1), F.char_length(path) - F.char_length(basename(path)))
    return F.when(head.rlike(r"^/*\z"), head).otherwise(F.regexp_replace(head, r"/+\z", ""))


def join_path(folder: Column, name: Column) -> Column:
    return F.concat_ws("/", folder, name)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, STAMP)


def upload_name(ts: Column, ext: Column, unique: Column | None = None) -> Column:
    """upload_<time><ext>; with ``unique`` two uploads of one second don't collide."""
    parts = [F.lit("upload_"), stamp(ts)] + ([F.lit("_"), unique] if unique is not None else [])
    return F.concat(*parts, ext)


def preprocessed_path(path: Column) -> Column:
    return F.concat(stem(path), F.lit("_preprocessed"), extension(path))


def docx_name(scan_id: Column, ts: Column, folder: str = "outputs") -> Column:
    return F.concat(F.lit(f"{folder}/scan_"), scan_id.cast("string"), F.lit("_"), stamp(ts), F.lit(".docx"))


def parse_id(text: Column) -> Column:
    """An integer route parameter, or null."""
    return text.try_cast("long")
