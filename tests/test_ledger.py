"""The ledger's snapshots against a plain dictionary; what lookups and updates read; crashes at every step of a compaction; dense ids."""

import os
import random
import shutil

import pytest

from leafpress.operators import ledger
from leafpress.operators.numbering import dense_ids
from leafpress.sources.storage import Storage

CHANGE = "scan_id long, status string, text_content string"


def state(book):
    return {r.id: (r.filename, r.status, r.text_content) for r in book.scans(None).collect()}


def play(spark, book, model, batch, rng, n=12):
    """One random batch of creations or changes, on the ledger and on the model."""
    if rng.random() < 0.4 or not model:
        names = sorted(f"f{batch:03d}_{k}" for k in range(rng.randrange(1, n)))
        book.create(spark.createDataFrame([(x,) for x in rng.sample(names, len(names))], "filename string"), batch)
        top = max(model, default=0)
        model |= {top + k + 1: (x, "Pending", None) for k, x in enumerate(names)}
    else:
        ids = rng.sample(range(1, max(model) + 4), min(n, max(model)))
        book.update(spark.createDataFrame([(i, f"s{batch}", f"t{batch}") for i in ids], CHANGE), batch)
        model |= {i: (model[i][0], f"s{batch}", f"t{batch}") for i in ids if i in model}


def test_equals_a_dictionary(spark, tmp_path):
    rng, model = random.Random(8), {}
    book = ledger.Ledger(spark, str(tmp_path / "l"), bucket_size=4, compact_after=None)
    for batch in range(12):
        play(spark, book, model, batch, rng)
        if batch % 4 == 3:
            book.compact()
        if batch % 6 == 5:
            assert state(book) == model
            book = ledger.Ledger(spark, str(tmp_path / "l"))  # opened anew, with the bucket size that it has
            assert book.bucket_size == 4
    assert state(book) == model
    for i in (1, max(model), max(model) + 1):
        assert [(r.filename, r.status, r.text_content) for r in book.get(i).collect()] == ([model[i]] if i in model else [])


def test_what_lookups_and_updates_read(spark, tmp_path, monkeypatch):
    book = ledger.Ledger(spark, str(tmp_path / "l"), bucket_size=10, compact_after=None)
    book.create(spark.createDataFrame([(f"f{k:03d}",) for k in range(100)], "filename string"), 0)
    book.compact()
    book.update(spark.createDataFrame([(i, "Completed", "t") for i in (5, 37, 99)], CHANGE), 1)
    for i in (5, 40):
        files = book.get(i).inputFiles()
        assert files and all(f"/bucket={i // 10}/" in f for f in files)
    assert len(book.get(40).inputFiles()) == 1 and len(book.get(5).inputFiles()) == 2
    before = book.version()["buckets"]
    book.compact()  # rewrites the three buckets of the changes alone
    after = book.version()["buckets"]
    assert {b for b in after if after[b] != before[b]} == {"0", "3", "9"}

    def forbidden(*args, **kwargs):
        raise AssertionError("an update reads no event and no state")

    with monkeypatch.context() as m:
        m.setattr(ledger.Ledger, "_read", forbidden)
        book.update(spark.createDataFrame([(5, "Failed: x", None)], CHANGE), 2)
    assert book.get(5).first().status == "Failed: x"


@pytest.mark.parametrize("step", ["write", "publish", "clear"])
def test_a_compaction_that_is_killed_loses_nothing(spark, tmp_path, monkeypatch, step):
    rng, model = random.Random(9), {}
    path = str(tmp_path / "l")
    book = ledger.Ledger(spark, path, bucket_size=4, compact_after=None)
    for batch in range(3):
        play(spark, book, model, batch, rng)
    book.compact()
    for batch in range(3, 5):
        play(spark, book, model, batch, rng)

    def killed(*args, **kwargs):
        raise KeyboardInterrupt

    target = {"write": (ledger.Ledger, "state"), "publish": (Storage, "publish"), "clear": (ledger.Ledger, "_clear")}[step]
    with monkeypatch.context() as m:
        m.setattr(*target, killed)
        with pytest.raises(KeyboardInterrupt):
            book.compact()
    book = ledger.Ledger(spark, path, compact_after=None)
    assert state(book) == model
    play(spark, book, model, 5, rng)
    book.compact()
    assert state(book) == model and book.version()["upto"] == 5
    book.compact()
    assert state(book) == model


def test_half_written_and_replayed_batches(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "l"), bucket_size=4, compact_after=2)
    ups = spark.createDataFrame([("a",), ("b",)], "filename string")
    book.create(ups, 0)
    os.remove(tmp_path / "l" / "delta" / "batch=0" / "_SUCCESS")  # the driver died before the commit
    assert state(book) == {}
    book.create(ups, 0)
    book.update(spark.createDataFrame([(1, "Completed", "t")], CHANGE), 1)
    assert book.version()["upto"] == 1
    want = {1: ("a", "Completed", "t"), 2: ("b", "Pending", None)}
    for _ in range(2):  # folded batches run again
        book.create(ups, 0)
        book.update(spark.createDataFrame([(1, "Completed", "t")], CHANGE), 1)
        assert state(book) == want
    book.create(spark.createDataFrame([("c",)], "filename string"), 2)
    assert max(state(book)) == 3


def test_a_change_before_the_creation_is_lost(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "l"), compact_after=None)
    book.update(spark.createDataFrame([(1, "Completed", "t")], CHANGE), 0)
    book.create(spark.createDataFrame([("a",)], "filename string"), 1)
    assert state(book) == {1: ("a", "Pending", None)}
    book.compact()
    assert state(book) == {1: ("a", "Pending", None)}


def test_dense_ids(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(40)]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = dense_ids(df, ("a", "b"), after=10)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    want = {r: k + 11 for k, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    for _ in range(2):
        assert {(r.a, r.b): r.id for r in dense_ids(df, ("a", "b"), after=10).collect()} == want
    assert dense_ids(df.where("false"), ("a", "b")).count() == 0


def test_storage(spark, tmp_path):
    shutil.rmtree(tmp_path / "x", ignore_errors=True)
    s = Storage(spark, str(tmp_path / "x"))
    assert s.root.startswith("file:") and s.names() == []
    s.publish("a/b", "ä")
    assert s.names("a") == ["b"] and s.read("a/b") == "ä" and s.exists("a/b")
    s.delete("a")
    assert not s.exists("a/b")


def test_folders_and_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "MOST_BUCKETS", 4)
    book = ledger.Ledger(spark, str(tmp_path / "l"), bucket_size=4, compact_after=None)
    many = spark.range(-500, 500, numPartitions=8).selectExpr("id AS scan_id", "concat('f', id) AS filename")
    book.create(many, 0)
    book.update(many.selectExpr("scan_id", "'Completed' AS status", "filename AS text_content"), 1)
    for batch in (0, 1):
        folder = tmp_path / "l" / "delta" / f"batch={batch}"
        buckets = [b for b in os.listdir(folder) if b.startswith("bucket=")]
        assert 1 < len(buckets) <= 5
        assert all(len([f for f in os.listdir(folder / b) if f.endswith(".parquet")]) == 1 for b in buckets)  # not one a task
    again = ledger.Ledger(spark, str(tmp_path / "l"), bucket_size=4)  # keeps the size that it has, also before a compaction
    assert again.bucket_size == book.bucket_size > 4
    assert [r.filename for r in again.get(-3).collect()] == ["f-3"] and again.scans(None).where("status = 'Completed' AND text_content = filename").count() == 1000
    again.compact()
    assert again.scans(None).count() == 1000 and [r.filename for r in again.get(499).collect()] == ["f499"]


def test_ids_go_on_without_reading_own_batches(spark, tmp_path, monkeypatch):
    ups = lambda *names: spark.createDataFrame([(n,) for n in names], "filename string")
    ids = lambda book: {r.filename: r.id for r in book.scans(None).collect()}
    path = str(tmp_path / "l")
    book, read = ledger.Ledger(spark, path, compact_after=None), []
    real = ledger.Ledger._read
    monkeypatch.setattr(ledger.Ledger, "_read", lambda self, schema, kind, folders: read.append(folders) or real(self, schema, kind, folders))
    for n in (0, 2, 4):
        book.create(ups(f"a{n}", f"b{n}"), n)
        book.update(spark.createDataFrame([(1, "Completed")], "scan_id long, status string"), n + 1)
    assert not read  # before, every batch so far, for each batch
    book.create(ups("a4", "b4", "c4"), 4)  # a replay, with one file more
    other = ledger.Ledger(spark, path, compact_after=None)
    other.create(ups("d"), 6)  # another ledger's batch
    book.create(ups("e"), 8)
    assert ids(book) == {"a0": 1, "b0": 2, "a2": 3, "b2": 4, "a4": 5, "b4": 6, "c4": 7, "d": 8, "e": 9}
    book.compact()
    book.create(ups("x", "y"), 8)  # a replay of what a snapshot holds
    book.create(ups("f"), 10)
    book.create(spark.createDataFrame([(50, "g")], "scan_id long, filename string"), 12)
    book.create(ups("h"), 14)
    book.update(spark.createDataFrame([(51, "Completed")], "scan_id long, status string"), 14)  # over a batch that held ids
    book.create(ups("i"), 16)
    assert {k: v for k, v in ids(book).items() if k > "d"} == {"e": 9, "f": 10, "g": 50, "i": 51}
