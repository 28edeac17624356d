"""Tiles against whole pages, the ordered fold of a hot group, and the transactional sink."""

import json
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafpress.functions import kernels, text
from leafpress.sources import docx, images, sink, tiles

PAGE = "id long, height int, width int, channels int, data binary"


def pages(spark, shapes):
    rng = np.random.default_rng(7)
    rows = []
    for k, (h, w, c) in enumerate(shapes):
        p = rng.integers(0, 256, (h, w, c)).astype(np.uint8)
        p[h // 3 : h // 2, : w // 2] = 30
        rows.append((k, h, w, c, bytearray(p.tobytes())))
    return rows, spark.createDataFrame(rows, PAGE)


@pytest.mark.parametrize("chain", ["blur", "clean"])
def test_tiles_equal_whole_pages(spark, chain):
    rows, df = pages(spark, [(130, 70, 3), (64, 64, 1), (1, 1, 3), (1, 90, 4), (97, 2, 1), (65, 20, 1), (66, 21, 1)])
    got = {r.id: r for r in tiles.tiled(df, chain, 32).collect()}
    for i, h, w, c, data in rows:
        whole = tiles.CHAINS[chain].run(kernels.to_gray(np.frombuffer(bytes(data), np.uint8).reshape(h, w, c)))
        assert (got[i].height, got[i].width) == (h, w) and bytes(got[i].data) == whole.tobytes(), (h, w)


def test_tiles_cover_a_page_once():
    for n, size, reach in ((1, 4, 2), (10, 4, 2), (12, 4, 20)):
        found = tiles.spans(n, size, reach)
        assert [i for a, b, _, _ in found for i in range(a, b)] == list(range(n))
        assert all(ta == max(0, a - reach) and tb == min(n, a + size + reach) for a, _, ta, tb in found)


def test_small_large_and_bad_pages(spark):
    rows, df = pages(spark, [(60, 50, 3), (10, 10, 1)])
    bad = spark.createDataFrame([(7, None, None, None, None), (8, -1, -1, -1, bytearray()), (9, 100, 100, 1, bytearray(5))], PAGE)
    both = df.unionByName(bad).select(F.col("id").alias("scan_id"), F.struct("height", "width", "channels", "data").alias("pixels"))
    got = {r.scan_id: r.clean for r in tiles.cleaned_pages(both, large=400, size=32).collect()}
    want = {r.scan_id: r.c for r in both.select("scan_id", images.clean_pixels("pixels").alias("c")).collect()}
    assert got == want and got[0].error is None and got[9].value is None


def folded(rows):
    out = {}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or ""))
        out[k] = "\n".join(t for _, _, t in mine if t is not None)
    return out


def test_ordered_fold(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "", "a", "b\nc"])) for _ in range(90)]
    rows += [(9, k, f"t{k}") for k in rng.sample(range(500), 500)] + [(8, k, None) for k in range(300)]
    df = spark.createDataFrame(rows, "conv long, turn long, said string").repartition(3)
    for most in (10, 100_000):
        assert {r.conv: r.said for r in text.join_ordered(df, "conv", "turn", "said", most).withColumnRenamed("text", "said").collect()} == folded(rows)


def test_a_group_of_a_million_rows(spark):
    n, most = 1_000_000, 100_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.pmod(F.col("id") * 7919, F.lit(n)).alias("o"), F.col("id").cast("string").alias("t"))
    parts = text.sub_ranges(df.select(F.col("k").alias("_key"), F.col("o").alias("_order"), F.col("t").alias("text")), n // most)
    sizes = [r.n for r in parts.select((F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"))) + 1).alias("n")).collect()]
    assert sum(sizes) == n and max(sizes) < 2 * most  # no task gets more than its sub-range
    (row,) = text.join_ordered(df, "k", "o", "t", most).select(F.split("text", "\n").alias("x")).select(F.size("x"), F.col("x")[0], F.col("x")[1], F.sha2(F.array_join("x", ","), 256)).collect()
    back = pow(7919, -1, n)
    assert row[0] == n and row[1] == "0" and row[2] == str(back)


def files_below(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if not f.endswith(".crc"))


def test_sink_writes_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    df = spark.range(40).select(F.format_string("a/%d.bin", "id").alias("path"), F.encode(F.col("id").cast("string"), "utf-8").alias("value"))
    sink.write_all(df.union(df.select(F.lit("b"), F.lit(None).cast("binary")).limit(1)), root)
    assert files_below(root) == sorted(f"a/{k}.bin" for k in range(40))
    sink.write_all(df.select("path", F.lit(bytearray(b"new")).alias("value")).where("path = 'a/3.bin'"), root)  # replaces
    assert (tmp_path / "out" / "a" / "3.bin").read_bytes() == b"new"
    before = files_below(root)
    broken = spark.range(40).select(F.when(F.col("id") == 33, "../x").otherwise(F.format_string("c/%d", "id")).alias("path"), F.lit(bytearray(b"x")).alias("value")).repartition(4)
    with pytest.raises(Exception, match="no file can be written"):
        sink.write_all(broken, root)
    assert files_below(root) == before and not os.path.exists(f"{root}/{sink.STAGING}/x")
    back = docx.read_downloads(spark, f"{root}/a").select("download_name", "content").collect()
    assert len(back) == 40


def test_sink_recovers(spark, tmp_path):
    root = str(tmp_path / "out")
    batch = pa.record_batch([pa.array(["d/1", "d/2"]), pa.array([b"one", b"two"])], ["path", "value"])
    done, dead = (sink.FileWriter(sink.qualified(spark, root)) for _ in range(2))
    message = done.write(iter([batch]))
    dead.write(iter([batch]))
    system, base = sink.opened(sink.qualified(spark, root))
    staged = f"{base}/{sink.STAGING}/{done.job}"
    sink.put(system, f"{staged}/{sink.NOTE}", json.dumps([message.folder]).encode())
    sink.move(system, f"{staged}/{message.folder}/d/1", f"{base}/d/1")  # the driver died here
    sink.recover(spark, root)
    assert files_below(root) == ["d/1", "d/2"]
    sink.recover(spark, root)
    assert (tmp_path / "out" / "d" / "2").read_bytes() == b"two"


def test_files_without_a_scheme_lie_on_the_default_file_system(spark, tmp_path):
    assert sink.qualified(spark, str(tmp_path)).startswith("file:/")
    df = spark.createDataFrame([("x/1", bytearray(b"v")), ("x", bytearray(b"w")), ("x/2", None)], "docx_path string, value binary").coalesce(1)
    got = {r.path: r for r in docx.write_files(df, str(tmp_path)).collect()}
    assert got["x/1"].bytes == 1 and got["x"].error and "x/2" not in got
    assert files_below(tmp_path) == ["x/1"]


def test_a_thresholded_page_is_denoised_by_counting(monkeypatch):
    rng = np.random.default_rng(5)
    exp, seen = np.exp, []
    for shape in ((9, 32, 32), (40, 64), (2, 1, 50), (1, 1)):
        page = np.where(rng.random(shape) < 0.3, 255, 0).astype(np.uint8)
        monkeypatch.setattr(kernels.np, "exp", lambda x: seen.append(np.size(x)) or exp(x))
        got = kernels.denoise(page)
        monkeypatch.undo()
        assert max(seen) == kernels.TEMPLATE**2 + 1  # a weight for each count, none for each pixel and shift
        gray = page.copy()
        gray.flat[0] ^= 1  # no longer of two values: distances by prefix sums, on nearly the same page
        assert np.abs(got.astype(int) - kernels.denoise(gray)).max() <= 2
    pages = np.where(rng.random((700, 8, 9)) < 0.3, 255, 0).astype(np.uint8)
    assert (np.stack([kernels.denoise(p) for p in pages]) == kernels.denoise(pages)).all()  # stacks are cut into blocks


def test_requests_without_a_document_are_spread(spark):
    from leafpress.operators import gates

    requests = spark.range(2000).select(F.when(F.col("id") < 1800, F.col("id")).alias("id"))  # unknown, pending and null ids
    scans = spark.range(0, 2000, 2).select("id", F.when(F.col("id") % 20 == 0, "Completed").otherwise("Pending").alias("status"), F.when(F.col("id") % 20 == 0, F.format_string("outputs/%d.docx", "id")).alias("docx_path"))
    files = scans.where("id % 40 = 0").select(F.col("docx_path").alias("path"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(old, ("-1", "false")):
            spark.conf.set(k, v)
        out = gates.download_requests(requests, scans, files)
        loads = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        codes = {r.code: r.n for r in out.groupBy("code").agg(F.count("*").alias("n")).collect()}
        right = out.where("code = 200 AND (download_name IS NULL OR path != concat('outputs/', id, '.docx'))").count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert codes == {404: 900 + 200 + 45, 400: 810, 200: 45} and right == 0
    assert max(loads) < 2 * 2000 / len(loads) and len(loads) == 4  # nulls in one task would be 1,910 of 2,000 rows


def test_packages_hold_one_text_at_a_time():
    import tracemalloc

    texts = pa.array([[f"{k} " + "word " * 4000, "end"] for k in range(1500)] + [None, ["bad\x01"]])  # 30 MB
    tracemalloc.start()
    made = docx._packages(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 << 20
    assert docx.read_docx(made[7]["value"].as_py())[0][1:] == texts[7].as_py()
    assert made[1500].as_py() == {"value": None, "error": None} and "U+0001" in made[1501]["error"].as_py()


def test_tasks_move_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sink, "finish", lambda *_: pytest.fail("moved by the driver"))
    seen = []
    move = sink.finish_on_workers
    monkeypatch.setattr(sink, "finish_on_workers", lambda s, root, job: seen.append(files_below(tmp_path / "out")) or move(s, root, job))
    sink.write_all(spark.range(0, 40, 1, 4).select(F.format_string("a/%d", "id").alias("path"), F.lit(bytearray(b"x")).alias("value")), str(tmp_path / "out"))
    assert len(seen[0]) == 41 and all(f.startswith(sink.STAGING) for f in seen[0])  # staged, with the note
    assert files_below(tmp_path / "out") == sorted(f"a/{k}" for k in range(40))


def test_documents_are_read_without_a_listing(spark, sf, tmp_path):
    from leafpress.plans import catalog

    (tmp_path / "a").mkdir()
    for name, value in (("a/1", b"x"), ("a/2", b""), ("3", b"yz"), ("a/other", b"not asked for")):
        (tmp_path / name).write_bytes(value)
    paths = spark.createDataFrame([("a/1",), ("a/2",), ("3",), ("a/1",), ("a/none",), (None,)], "path string")
    made = docx.downloads(paths, str(tmp_path))
    assert sorted((r.path, r.download_name, bytes(r.content)) for r in made.collect()) == [("3", "3", b"yz"), ("a/1", "1", b"x"), ("a/2", "2", b"")]
    assert docx.read_downloads(spark, str(tmp_path / "a")).inputFiles()  # what the driver holds of a listing
    for df in (made, catalog.download_content(spark, sf)):
        assert not [f for f in df.inputFiles() if not f.endswith(".parquet")] and "binaryFile" not in df._jdf.queryExecution().toString()
