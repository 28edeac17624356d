import os.path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafpress.functions import kernels, names, text
from leafpress.operators import gates

PATHS = ["a.png", ".bashrc", "a.tar.gz", "a.", "..a", "d.x/a", "/", "//", "/a", "a/b/", "", "...", "x/.y.z", "//a", "a//b", "d/..b.c", "no_ext", "ü.ñ"]


def test_paths_match_the_standard_library(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    for r in df.select("p", names.extension(F.col("p")).alias("e"), names.stem(F.col("p")).alias("s"), names.basename(F.col("p")).alias("b"), names.dirname(F.col("p")).alias("d")).collect():
        assert (r.s, r.e) == os.path.splitext(r.p)
        assert (r.d, r.b) == os.path.split(r.p)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab./ ü", max_size=12), min_size=30, max_size=30))
def test_random_paths(spark, paths):
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for r in df.select("p", names.extension(F.col("p")).alias("e"), names.basename(F.col("p")).alias("b"), names.dirname(F.col("p")).alias("d")).collect():
        assert r.e == os.path.splitext(r.p)[1] and (r.d, r.b) == os.path.split(r.p)


def test_blank_rule_is_python_strip_on_every_space(spark):
    points = [i for i in range(1, 0x3100)]
    df = spark.createDataFrame([(i, chr(i)) for i in points], "i int, c string")
    blank = {r.i for r in df.where(text.is_blank(F.col("c"))).collect()}
    assert blank == {i for i in points if not chr(i).strip()}


def test_paragraphs_split_at_newline_alone(spark):
    texts = ["", "\n", "a\n", "a\r\nb", " \nx\n　\n y ", "\x1c\n\t\n", None, "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in text.paragraphs(df, "id").orderBy("para_no").collect():
        got.setdefault(r.id, []).append(r.text)
    want = {i: [x for x in t.split("\n") if x.strip()] for i, t in enumerate(texts) if t}
    assert got == {i: v for i, v in want.items() if v}


def test_fragments_keep_their_order_and_empties(spark):
    df = spark.createDataFrame([(1, [("b", 0.1), ("a", 0.9), ("", 0.5)]), (2, [])], "id int, f array<struct<text:string,confidence:double>>")
    assert [r.t for r in df.orderBy("id").select(text.fold_fragments(F.col("f")).alias("t")).collect()] == ["b\na\n", ""]
    shown = spark.createDataFrame([("",), (None,), ("x",)], "t string").select(text.shown_text(F.col("t")).alias("s")).collect()
    assert [r.s for r in shown] == [text.EMPTY_NOTICE, text.EMPTY_NOTICE, "x"]


def test_gates_report_the_first_failure(spark):
    rows = [("image/png", True, True), ("text/plain", False, False), (None, True, True), ("", True, True), ("Image/png", True, True), ("image/x", False, False), ("image/x", True, False), ("image/x", None, True)]
    df = spark.createDataFrame(rows, "c string, s boolean, v boolean")
    assert [r.x for r in df.select(gates.upload_code(F.col("c"), F.col("s"), F.col("v")).alias("x")).collect()] == [201, 400, 400, 400, 400, 500, 400, 500]
    scans = spark.createDataFrame([(1, "Completed", "/o/a.docx"), (2, "Pending", None), (3, "Completed", "/o/gone.docx")], "id long, status string, docx_path string")
    files = spark.createDataFrame([("file:///o/a.docx",)], "path string")
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    got = {r.id: (r.code, r.download_name) for r in gates.download_requests(asked, scans, files).collect()}
    assert got == {1: (200, "a.docx"), 2: (400, None), 3: (404, None), 4: (404, None)}
    ends = spark.createDataFrame([("Completed",), ("Failed: x",), ("Pending",), ("completed",)], "s string")
    assert [r.t for r in ends.select(gates.is_terminal(F.col("s")).alias("t")).collect()] == [True, True, False, False]


def test_kernels():
    flat = np.full((9, 7), 77, np.uint8)
    assert (kernels.blur(flat) == 77).all() and (kernels.denoise(flat) == 77).all() and (kernels.adaptive_threshold(flat) == 255).all()
    spot = np.zeros((9, 9), np.uint8)
    spot[4, 4] = 255
    taps = np.array(kernels.BLUR_TAPS)
    assert (kernels.blur(spot)[2:7, 2:7] == np.floor(np.outer(taps, taps) / 256 * 255 + 0.5)).all()
    step = np.repeat(np.array([[0] * 10 + [200] * 10], np.uint8), 12, axis=0)
    assert set(np.unique(kernels.adaptive_threshold(step))) == {0, 255}
    bgr = np.zeros((1, 3, 3), np.uint8)
    bgr[0, 0, 0], bgr[0, 1, 1], bgr[0, 2, 2] = 255, 255, 255
    assert kernels.to_gray(bgr).tolist() == [[29, 150, 76]]
    for shape in ((1, 1, 1), (1, 8, 3), (6, 1, 4), (3, 5, 1)):
        page = np.random.default_rng(0).integers(0, 256, shape).astype(np.uint8)
        one = kernels.clean(page)
        assert one.shape == shape[:2] and (kernels.clean(np.stack([page, page]))[1] == one).all()
