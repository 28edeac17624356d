"""Word documents: an OOXML package per text, a file sink, and readers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.functions.text import paragraph_array
from leafpress.sources.sink import opened, put_whole, qualified

#: The title, the run size in half points, the media type.
TITLE = "OCR Extracted Text"
HALF_POINTS = 24
MEDIA_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
#: Files that a task reads, and the bytes of them that it holds at a time (more, if one file is larger).
READS_A_TASK, READ_BYTES = 2000, 4 << 20

_MAIN = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    f'<Override PartName="/word/document.xml" ContentType="{MEDIA_TYPE}.main+xml"/>'
    '<Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
    "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
    "word/styles.xml": f'<w:styles xmlns:w="{_MAIN}"><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>'
    '<w:style w:type="paragraph" w:styleId="Title"><w:name w:val="Title"/><w:basedOn w:val="Normal"/><w:rPr><w:sz w:val="52"/></w:rPr></w:style></w:styles>',
}
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")


def _run(text: str, size: bool) -> str:
    pieces = re.split("([\t\r])", text)
    marks = {"\t": "<w:tab/>", "\r": "<w:br/>"}
    inner = "".join(marks.get(p) or f'<w:t xml:space="preserve">{escape(p)}</w:t>' for p in pieces if p)
    style = f'<w:rPr><w:sz w:val="{HALF_POINTS}"/></w:rPr>' if size else ""
    return f"<w:r>{style}{inner}</w:r>"


def build_docx(paragraphs: list[str], title: str = TITLE) -> bytes:
    """A package of a title and one 12-point paragraph per text; equal input gives equal bytes.

    Raises ValueError for characters that XML can't hold.
    """
    for p in paragraphs:
        if bad := _ILLEGAL.search(p):
            raise ValueError(f"text holds the control character U+{ord(bad[0]):04X}")
    body = f'<w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr>{_run(title, False)}</w:p>' + "".join(f"<w:p>{_run(p, True)}</w:p>" for p in paragraphs)
    parts = _PARTS | {"word/document.xml": f'<w:document xmlns:w="{_MAIN}"><w:body>{body}<w:sectPr/></w:body></w:document>'}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), _HEAD + xml, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def read_docx(raw: bytes) -> tuple[list[str], list[int]]:
    """Paragraph texts of a package, the title first, and the run sizes found."""
    from xml.etree import ElementTree

    w = f"{{{_MAIN}}}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    marks = {f"{w}tab": "\t", f"{w}br": "\r"}
    texts = ["".join(marks.get(x.tag, x.text if x.tag == f"{w}t" else "") or "" for x in p.iter()) for p in root.iter(f"{w}p")]
    return texts, [int(x.get(f"{w}val")) for x in root.iter(f"{w}sz")]


def _packages(paragraphs: pa.Array) -> pa.Array:
    """struct<value, error> of each list of paragraphs. Of a batch, which may hold thousands of long texts, one at a time becomes Python strings."""
    values, errors = [], []
    for p in paragraphs:
        value = error = None
        try:
            value = build_docx(p.as_py()) if p.is_valid else None
        except Exception as e:  # noqa: BLE001
            error = str(e)
        values.append(value)
        errors.append(error)
    return pa.StructArray.from_arrays([pa.array(values, pa.binary()), pa.array(errors, pa.string())], ["value", "error"])


def with_docx(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df plus docx struct<value binary, error string> built from the text's paragraphs."""

    build = F.arrow_udf(_packages, "struct<value:binary,error:string>")
    return df.withColumn("docx", build(paragraph_array(F.col(text_col))))


def file_written(spark: SparkSession, root: str, path: Column | str, value: Column | str) -> Column:
    """struct<bytes long, error string> of writing each value to root/path; null values are passed by (null, null). One bad file is its row's error.

    A file appears whole, by a rename; a retried task writes the same bytes again.
    """
    target = qualified(spark, root)

    def run(paths: pa.Array, values: pa.Array) -> pa.Array:
        system, base = opened(target)
        rows = []
        for p, v in zip(paths, values):
            row = {"bytes": None, "error": None}
            if v.is_valid:
                try:
                    put_whole(system, f"{base}/{p.as_py()}", v.as_py())
                    row["bytes"] = len(v.as_py())
                except Exception as e:  # noqa: BLE001
                    row = {"bytes": 0, "error": str(e)}
            rows.append(row)
        return pa.array(rows, pa.struct({"bytes": pa.int64(), "error": pa.string()}))

    # Not to be moved into a filter or done twice.
    return F.arrow_udf(run, "struct<bytes:long,error:string>").asNondeterministic()(path, value)


def write_files(df: DataFrame, root: str, path_col: str = "docx_path", value_col: str = "value") -> DataFrame:
    """Writes each binary value to root/path; returns (path, bytes, error), so that one bad file is that scan's failure. ``sink.write_all`` writes all or nothing.

    A root without a scheme lies on Hadoop's default file system. Nulls are passed by.
    """
    kept = df.select(F.col(path_col).alias("path"), F.col(value_col).alias("value")).where("value IS NOT NULL")
    return kept.select("path", file_written(df.sparkSession, root, "path", "value").alias("w")).select("path", "w.bytes", "w.error")


def read_downloads(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, download_name, media_type, content) of finished documents."""
    found = spark.read.format("binaryFile").load(paths)
    return found.select("path", F.substring_index("path", "/", -1).alias("download_name"), F.lit(MEDIA_TYPE).alias("media_type"), "content")


def downloads(paths: DataFrame, root: str, path_col: str = "path") -> DataFrame:
    """(path, download_name, media_type, content) of the documents at these paths below root, one row for each path; one that isn't there has none.

    Tasks open the files by their names, so neither a listing nor a status of each file stands on the driver, as with ``read_downloads``.
    """
    target = qualified(paths.sparkSession, root)
    asked = paths.select(F.col(path_col).alias("path")).where("path IS NOT NULL")
    tasks = max(paths.sparkSession.sparkContext.defaultParallelism, -(-asked.count() // READS_A_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(target)
        pack = lambda rows: pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["path", "content"])
        held, size = [], 0
        for batch in batches:
            for path in batch["path"]:
                try:
                    with system.open_input_file(f"{base}/{path}") as f:
                        held.append((path.as_py(), f.read()))
                except FileNotFoundError:
                    continue
                size += len(held[-1][1])
                if size >= READ_BYTES:
                    yield pack(held)
                    held, size = [], 0
        yield pack(held)

    # Opening a file takes far longer than reading its name, so names are dealt to as many tasks as the files need.
    found = asked.repartition(tasks, "path").distinct().mapInArrow(run, "path string, content binary")
    return found.select("path", F.substring_index("path", "/", -1).alias("download_name"), F.lit(MEDIA_TYPE).alias("media_type"), "content")
