import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafpress.functions import kernels
from leafpress.operators import ledger
from leafpress.operators.recognize import Embedded
from leafpress.plans.digitize import process_batch
from leafpress.sources import docx, images
from leafpress.streaming import ingest


def png(width, height, rows, kind=0, corrupt=False):
    def chunk(name, body):
        crc = zlib.crc32(name + body) ^ (1 if corrupt else 0)
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", crc)

    data = b"".join(b"\0" + r for r in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


GOOD = png(3, 2, [bytes([255, 0, 0, 0, 255, 0, 0, 0, 255]), bytes(9)], 2)


def test_validity():
    assert images.is_valid_image(GOOD)
    assert images.is_valid_image(png(2, 1, [b"\x01\x02"]))
    for bad in (png(3, 2, [bytes(9)] * 2, 2, corrupt=True), GOOD[:-8], b"plain text", b"", None, b"\xff\xd8", b"BM", GOOD[:20], b"\xff\xd8\xff"):
        assert not images.is_valid_image(bad)
    assert images.is_valid_image(b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\5abc\xff\xda\0\2xx\xff\xd9")
    assert images.is_valid_image(images.encode_png(1, 2, b"\0\xff"))


def test_decoding_and_errors_as_values(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(GOOD)
    (tmp_path / "b.png").write_bytes(b"nothing")
    (tmp_path / "c.png").write_bytes(png(2, 1, [b"\x05\x09"]))
    rows = {r.path.rsplit("/", 1)[1]: r for r in images.read_decoded(spark, str(tmp_path)).select("path", "pixels", images.clean_pixels("pixels").alias("c")).collect()}
    assert bytes(rows["a.png"].pixels.data[:9]) == bytes([0, 0, 255, 0, 255, 0, 255, 0, 0])  # BGR
    assert rows["a.png"].c.value.height == 2 and rows["a.png"].c.error is None
    assert rows["b.png"].c.value is None and "decoded" in rows["b.png"].c.error
    slim = images.read_uploads(spark, str(tmp_path)).select("path", "length")
    assert "content" not in slim._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_docx_round_trip():
    raw = docx.build_docx(["a & <b>", " lead", "tab\there", "x\ry"])
    texts, sizes = docx.read_docx(raw)
    assert texts == [docx.TITLE, "a & <b>", " lead", "tab\there", "x\ry"] and sizes == [24] * 4
    assert docx.read_docx(docx.build_docx([]))[0] == [docx.TITLE]
    assert docx.build_docx(["q"]) == docx.build_docx(["q"])
    with pytest.raises(ValueError):
        docx.build_docx(["bell\x07"])


def test_docx_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\n \nb", "outputs/1.docx"), (2, "bad\x01", "outputs/2.docx"), (3, None, "outputs/3.docx")], "id int, text string, docx_path string")
    made = docx.with_docx(df).select("id", "docx_path", "docx.value", "docx.error")
    errors = {r.id: r.error for r in made.collect()}
    assert errors[1] is None and "U+0001" in errors[2] and errors[3] is None
    wrote = docx.write_files(made, str(tmp_path)).collect()
    assert [w.path for w in wrote] == ["outputs/1.docx"]
    got = docx.read_downloads(spark, str(tmp_path / "outputs")).first()
    assert got.download_name == "1.docx" and docx.read_docx(bytes(got.content))[0] == [docx.TITLE, "a", "b"]


def test_ledger(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "events"))
    assert book.scans().count() == 0
    clock = F.to_timestamp(F.lit("2024-05-01 10:00:00"))
    ups = spark.createDataFrame([("b.png",), ("a.png",)], "filename string")
    book.create(ups, 0, clock)
    book.create(ups, 0, clock)  # a replay changes nothing
    assert [(r.id, r.filename, r.status) for r in book.scans().orderBy("id").collect()] == [(1, "a.png", "Pending"), (2, "b.png", "Pending")]
    later = F.to_timestamp(F.lit("2024-05-01 11:00:00"))
    book.update(spark.createDataFrame([(1, "Completed", "t", "p.docx"), (9, "Completed", "t", "p")], "scan_id long, status string, text_content string, docx_path string"), 1, later)
    one = book.get(1).first()
    assert (one.status, one.text_content, str(one.created_at), str(one.updated_at)) == ("Completed", "t", "2024-05-01 10:00:00", "2024-05-01 11:00:00")
    assert book.get(9).count() == 0
    book.update(spark.createDataFrame([(1, "Failed: boom")], "scan_id long, status string"), 2, later)
    one = book.get(1).first()
    assert (one.status, one.text_content, one.docx_path, one.filename) == ("Failed: boom", None, None, "a.png")
    book.create(spark.createDataFrame([("c.png",)], "filename string"), 3, clock)
    assert book.scans().selectExpr("max(id)").first()[0] == 3
    body = {r.id: r.body for r in ledger.status_response(book.scans()).collect()}
    assert body[2] == '{"id":2,"filename":"b.png","status":"Pending","created_at":"2024-05-01 10:00:00","updated_at":"2024-05-01 10:00:00"}'
    assert spark.sql("SELECT count(*) FROM scans WHERE status = 'Pending'").first()[0] == 2


def test_stream_processes_each_file_once(spark, tmp_path):
    class Broken:
        def recognize(self, page):
            raise RuntimeError("no engine")

    class Fixed:
        def recognize(self, page):
            return [([], f"{page.shape[0]}x{page.shape[1]}", 1.0), ([], " ", 0.2), ([], "end", 0.5)]

    land = tmp_path / "land"
    land.mkdir()
    (land / "a.png").write_bytes(GOOD)
    (land / "x.txt").write_bytes(b"text")
    (land / "y.png").write_bytes(b"junk")
    book = ledger.Ledger(spark, str(tmp_path / "events"))

    def go(make=Fixed, name="fixed"):
        ingest.start(spark, str(land), book, str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "rejects"), name, make).awaitTermination()
        return {r.id: r for r in book.scans().collect()}

    first = go()
    assert first[1].status == "Completed" and first[1].text_content == "2x3\n \nend" and len(first) == 1
    path = tmp_path / "out" / first[1].docx_path
    assert docx.read_docx(path.read_bytes())[0] == [docx.TITLE, "2x3", "end"]
    refused = {r.path.rsplit("/", 1)[1]: r.code for r in spark.read.parquet(str(tmp_path / "rejects")).collect()}
    assert refused == {"x.txt": 400, "y.png": 400}
    assert len(go()) == 1
    (land / "b.png").write_bytes(GOOD)
    second = go(Broken, "broken")
    assert len(second) == 2 and second[2].status == "Failed: no engine" and second[2].docx_path is None and second[1].status == "Completed"


def test_replayed_batch_changes_nothing(spark, tmp_path):
    (tmp_path / "land").mkdir()
    (tmp_path / "land" / "a.png").write_bytes(GOOD)
    book = ledger.Ledger(spark, str(tmp_path / "events"))
    ups = images.read_uploads(spark, str(tmp_path / "land"))
    for _ in range(2):
        process_batch(ups, book, str(tmp_path / "out"), 0, "embedded", Embedded).collect()
        assert book.events().count() == 2
    assert book.scans().first().status == "Completed"


def test_webp_and_tiff_are_known_and_broken_ones_refused():
    import struct

    webp = b"RIFF" + struct.pack("<I", 12) + b"WEBPVP8 " + b"\0" * 4
    tiff = b"II*\0" + struct.pack("<IH", 8, 1) + b"\0" * 12 + struct.pack("<I", 0)
    big = b"MM\0*" + struct.pack(">IH", 8, 1) + b"\0" * 12 + struct.pack(">I", 0)
    loop = tiff[:-4] + struct.pack("<I", 8)
    assert all(map(images.is_valid_image, (webp, tiff, big)))
    assert not any(map(images.is_valid_image, (webp[:14], b"RIFF" + webp[4:8] + b"WAVEfmt ", tiff[:-1], tiff[:6], loop, b"II*\0" + b"\0" * 4)))


def test_the_senders_type_counts(spark):
    from leafpress.plans.digitize import accept

    rows = [("a.png", bytearray(GOOD), "image/png"), ("b.bin", bytearray(GOOD), "image/png"), ("c.png", bytearray(GOOD), "text/plain"), ("d.png", bytearray(GOOD), None)]
    df = spark.createDataFrame(rows, "path string, content binary, content_type string")
    assert [r.code for r in accept(df).orderBy("path").collect()] == [201, 201, 400, 400]
    assert [r.code for r in accept(df.drop("content_type")).orderBy("path").collect()] == [201, 400, 201, 201]


def scalar_blur(g):
    h, w = g.shape
    mirror = lambda i, n: -i if i < 0 else 2 * n - 2 - i if i >= n else i
    t = kernels.BLUR_TAPS
    out = [[sum(t[a + 2] * t[b + 2] * int(g[mirror(y + a, h)][mirror(x + b, w)]) for a in range(-2, 3) for b in range(-2, 3)) for x in range(w)] for y in range(h)]
    return np.array([[(v + 128) // 256 for v in row] for row in out])


def scalar_threshold(g):
    h, w = g.shape
    r = kernels.THRESHOLD_BLOCK // 2
    k = [np.exp(-(i**2) / 8.0) for i in range(-r, r + 1)]
    norm = sum(k) ** 2
    near = lambda i, n: min(max(i, 0), n - 1)
    out = np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            mean = sum(k[a + r] * k[b + r] * int(g[near(y + a, h)][near(x + b, w)]) for a in range(-r, r + 1) for b in range(-r, r + 1)) / norm
            out[y, x] = 255 if int(g[y][x]) - int(mean + 0.5) > -kernels.THRESHOLD_OFFSET else 0
    return out


def scalar_denoise(g):
    h, w = g.shape
    t, s = kernels.TEMPLATE // 2, kernels.SEARCH // 2
    wide = np.pad(g.astype(float), s + t, "symmetric")
    out = np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            cy, cx = y + s + t, x + s + t
            home = wide[cy - t : cy + t + 1, cx - t : cx + t + 1]
            total = weight = 0.0
            for dy in range(-s, s + 1):
                for dx in range(-s, s + 1):
                    away = wide[cy + dy - t : cy + dy + t + 1, cx + dx - t : cx + dx + t + 1]
                    like = np.exp(-((home - away) ** 2).mean() / kernels.DENOISE_STRENGTH**2)
                    total += like * wide[cy + dy, cx + dx]
                    weight += like
            out[y, x] = int(total / weight + 0.5)
    return out


def test_kernels_equal_their_scalar_twins():
    rng = np.random.default_rng(4)
    page = rng.integers(0, 256, (24, 19)).astype(np.uint8)
    page[5:12, 4:9] = 30
    assert (kernels.blur(page) == scalar_blur(page)).all()
    assert (kernels.adaptive_threshold(page) == scalar_threshold(page)).all()
    two = kernels.adaptive_threshold(kernels.blur(page))
    assert (kernels.denoise(two) == scalar_denoise(two)).all()
