"""The scan ledger: events in batches, snapshots of the state in buckets of ids, and the view that merges them.

An update replaces the whole state, so text and path that it omits become null; an update of an id that wasn't created before it changes nothing.
Events are ordered by their batch, so writing one reads nothing. A batch written again replaces itself.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.operators.gates import COMPLETED
from leafpress.operators.numbering import numbered
from leafpress.sources.storage import Storage

EVENTS = "scan_id long, seq long, created boolean, status string, filename string, text_content string, docx_path string, event_ts timestamp"
STATE = "scan_id long, seq long, filename string, status string, created_at timestamp, updated_at timestamp, text_content string, docx_path string"
#: Buckets that the first events of a ledger may lie in; each is a folder and a file in every batch that touches it.
MOST_BUCKETS = 256
_VALUES = ("seq", "status", "text_content", "docx_path", "event_ts")


def create_events(uploads: DataFrame, clock: Column, seq: int) -> DataFrame:
    """Pending events of uploads (scan_id, filename)."""
    none = F.lit(None).cast("string")
    return uploads.select(
        F.col("scan_id").cast("long").alias("scan_id"), F.lit(seq).cast("long").alias("seq"), F.lit(True).alias("created"), F.lit("Pending").alias("status"), "filename",
        none.alias("text_content"), none.alias("docx_path"), clock.cast("timestamp").alias("event_ts"),
    )


def update_events(changes: DataFrame, clock: Column, seq: int) -> DataFrame:
    """Events of changes (scan_id, status[, text_content, docx_path]), one for each id."""
    optional = [F.col(c) if c in changes.columns else F.lit(None).cast("string").alias(c) for c in ("text_content", "docx_path")]
    return changes.select(
        F.col("scan_id").cast("long").alias("scan_id"), F.lit(seq).cast("long").alias("seq"), F.lit(False).alias("created"), "status", F.lit(None).cast("string").alias("filename"),
        *optional, clock.cast("timestamp").alias("event_ts"),
    )


def latest(df: DataFrame, key: str, order: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """The whole row with the greatest order for each key, by one partial aggregation."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_s")).select(key, "_s.*")


def _newest(events: DataFrame) -> DataFrame:
    """One row for each id: its last event as s, and created_at, filename and known, if the creation is among the events."""
    made = F.col("created")
    return events.groupBy("scan_id").agg(
        F.max_by(F.struct(*_VALUES), F.struct("seq", ~made)).alias("s"), F.min(F.when(made, F.col("event_ts"))).alias("created_at"),
        F.max(F.when(made, F.col("filename"))).alias("filename"), F.bool_or(made).alias("known"),
    )


def merged(events: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """The state (columns of STATE) after events on top of a snapshot.

    The snapshot's rows meet the newest events in a left join, where Spark broadcasts the events if they are few; ids created since follow apart.
    """
    newest = _newest(events)
    new = newest.where("known").select("scan_id", "s.seq", "filename", "s.status", "created_at", F.col("s.event_ts").alias("updated_at"), "s.text_content", "s.docx_path")
    if snapshot is None:
        return new
    changed = newest.where("NOT known").select(F.col("scan_id").alias("_id"), "s")
    hit = F.col("s").isNotNull()
    now = lambda c, old=None: F.when(hit, F.col(f"s.{c}")).otherwise(F.col(old or c)).alias(old or c)
    old = snapshot.join(changed, F.col("scan_id") == F.col("_id"), "left")
    return old.select("scan_id", now("seq"), "filename", now("status"), "created_at", now("event_ts", "updated_at"), now("text_content"), now("docx_path")).unionByName(new)


def shown(state: DataFrame) -> DataFrame:
    """One row per scan: id, filename, status, created_at, updated_at, text_content, docx_path."""
    return state.select(F.col("scan_id").alias("id"), "filename", "status", "created_at", "updated_at", "text_content", "docx_path")


def scans(events: DataFrame) -> DataFrame:
    return shown(merged(events))


def get_by_id(table: DataFrame, scan_id: int, key: str = "id") -> DataFrame:
    """Zero or one row; on Parquet the equality reaches the scan."""
    return table.where(F.col(key) == F.lit(scan_id))


def status_response(view: DataFrame) -> DataFrame:
    """(id, body): five keys as JSON, and text and path only once the scan is complete."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    done = lambda c: F.when(F.col("status") == COMPLETED, F.col(c)).alias(c)
    return view.select("id", F.to_json(F.struct("id", "filename", "status", stamp("created_at"), stamp("updated_at"), done("text_content"), done("docx_path"))).alias("body"))


class Ledger:
    """A ledger in a folder, with one writer at a time.

    ``delta/batch=<n>/bucket=<b>`` holds the events of a batch, which count once the batch's ``_SUCCESS`` stands there;
    ``state/v=<n>/bucket=<b>`` the scans of a bucket as of a version; ``versions/<n>`` what a version consists of: which buckets are where,
    and up to which batch they hold everything. The greatest version counts. A bucket is ``bucket_size`` ids in a row (more, if the first events
    lie far apart; the size is kept with the first version), so its size stays and buckets whose scans have ended aren't rewritten. A compaction writes the buckets that the batches touched and then publishes a version
    by renaming one small file: before that nothing has changed, after it all has. What a version no longer needs goes with the
    compaction after the next, so views taken before one stay readable.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_size: int = 1 << 16, compact_after: int | None = 64):
        self.spark, self.path, self.compact_after = spark, path, compact_after
        self.storage = Storage(spark, path)
        known = self.storage.names("versions")
        self.bucket_size = self._version(known[-1])["bucket_size"] if known else bucket_size
        # Batches whose ids are known to end at _top, so that the next ones are numbered without reading them again.
        self._seen: set[int] = set()
        self._top = 0

    # What is there.

    def _version(self, name: str) -> dict:
        return json.loads(self.storage.read(f"versions/{name}"))

    def version(self) -> dict:
        known = self.storage.names("versions")
        return self._version(known[-1]) if known else {"number": 0, "upto": -1, "max_id": 0, "bucket_size": self.bucket_size, "buckets": {}}

    def _folders(self, after: int) -> list[int]:
        """Numbers of the batches above ``after`` that have a folder, whether they count or not."""
        return sorted(n for n in (int(n.removeprefix("batch=")) for n in self.storage.names("delta") if n.startswith("batch=")) if n > after)

    def _counts(self, number: int) -> bool:
        return self.storage.exists(f"delta/batch={number}/_SUCCESS")

    def batches(self, after: int = -1) -> list[int]:
        """Numbers of the batches that count, above ``after``."""
        return [n for n in self._folders(after) if self._counts(n)]

    def _bucket(self) -> Column:
        return F.expr(f"(scan_id - pmod(scan_id, {self.bucket_size})) div {self.bucket_size}")

    def _read(self, schema: str, kind: str, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], f"{schema}, {'batch long, ' if kind == 'delta' else ''}bucket long")
        base = f"{self.storage.root}/{kind}"
        own = "batch" if kind == "delta" else "v"
        rows = self.spark.read.schema(f"{schema}, {own} long, bucket long").option("basePath", base).parquet(*(f"{base}/{f}" for f in folders))
        return rows if kind == "delta" else rows.drop("v")

    def events(self, after: int = -1, buckets: Sequence[int] | None = None) -> DataFrame:
        """Events of the batches above ``after`` that are still there, with batch and bucket; of some buckets, only their folders are read."""
        folders = [f"batch={n}" for n in self.batches(after)]
        if buckets is not None:
            own = {f"bucket={b}" for b in buckets}
            folders = [f"{f}/{b}" for f in folders for b in self.storage.names(f"delta/{f}") if b in own]
        return self._read(EVENTS, "delta", folders)

    def batch(self, number: int) -> DataFrame:
        return self._read(EVENTS, "delta", [f"batch={number}"] if self._counts(number) else [])

    def state(self, buckets: Sequence[int] | None = None, scan_id: int | None = None) -> DataFrame:
        """The merged state; of some buckets, or of one id, only those buckets are read, in the snapshot and in the batches after it."""
        version = self.version()
        held = {int(b): v for b, v in version["buckets"].items() if buckets is None or int(b) in set(buckets)}
        snapshot = self._read(STATE, "state", [f"v={v}/bucket={b}" for b, v in sorted(held.items())]).drop("bucket") if held else None
        events = self.events(version["upto"], buckets)
        if scan_id is not None:
            events, snapshot = get_by_id(events, scan_id, "scan_id"), None if snapshot is None else get_by_id(snapshot, scan_id, "scan_id")
        return merged(events, snapshot)

    def scans(self, view: str | None = "scans") -> DataFrame:
        out = shown(self.state())
        if view:
            out.createOrReplaceTempView(view)
        return out

    def get(self, scan_id: int) -> DataFrame:
        return shown(self.state([scan_id // self.bucket_size], scan_id))

    # What changes it.

    def _append(self, events: DataFrame, batch_id: int) -> bool:
        """Whether the events were written."""
        version = self.version()
        if batch_id <= version["upto"]:
            return False  # a replay of what a snapshot holds
        self._fit(events)
        # A bucket's events go to one task, at most one row an id, else each task would write a file of its own in every bucket.
        dealt = events.withColumn("bucket", self._bucket()).repartition("bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.storage.root}/delta/batch={batch_id}")
        if self.compact_after and len(self._folders(version["upto"])) >= self.compact_after and len(self.batches(version["upto"])) >= self.compact_after:
            self.compact()
        return True

    def _fit(self, events: DataFrame) -> None:
        """Before anything is written: doubles the bucket's size until the first events lie in at most MOST_BUCKETS buckets, and publishes it as version 0."""
        if self.storage.names("versions") or self.storage.names("delta"):
            return
        span = events.agg(F.min("scan_id").alias("low"), F.max("scan_id").alias("high")).first()
        while span.low is not None and span.high // self.bucket_size - span.low // self.bucket_size >= MOST_BUCKETS:
            self.bucket_size *= 2
        self.storage.publish("versions/000000000000", json.dumps(self.version()))

    def create(self, uploads: DataFrame, batch_id: int, clock: Column | None = None, order: tuple[str, ...] = ("filename",), last: int | None = None) -> None:
        """Appends Pending events with the next ids, in the given order; uploads with a column scan_id keep those ids, which end at ``last`` if they follow ``last_id``."""
        if "scan_id" not in uploads.columns:
            uploads, last = numbered(uploads, order, "scan_id", self.last_id(batch_id))
        wrote = self._append(create_events(uploads, F.current_timestamp() if clock is None else clock, batch_id), batch_id)
        self._seen.discard(batch_id)
        if wrote and last is not None:
            self._seen, self._top = self._seen | {batch_id}, last

    def last_id(self, batch_id: int) -> int:
        """The greatest id of all batches but this one. They are read if there are some that this ledger hasn't written or read itself."""
        version = self.version()
        others = {n for n in self.batches(version["upto"]) if n != batch_id}
        if batch_id in self._seen or not others <= self._seen:
            newer = self._read(EVENTS, "delta", [f"batch={n}" for n in sorted(others)]).where("created")
            self._seen, self._top = others, newer.agg(F.max("scan_id")).first()[0] or 0
        return max(version["max_id"], self._top)

    def update(self, changes: DataFrame, batch_id: int, clock: Column | None = None) -> None:
        """Appends changes; one that follows a creation has a greater batch number."""
        again = batch_id in self._seen
        self._append(update_events(changes, F.current_timestamp() if clock is None else clock, batch_id), batch_id)
        self._seen = self._seen - {batch_id} if again else self._seen | {batch_id}  # a batch written over may have held ids

    def compact(self) -> None:
        """Folds the batches since the last version into the buckets that they touch."""
        version = self.version()
        batches = self.batches(version["upto"])
        if not batches:
            return
        touched = reduce(set.union, ({int(n.removeprefix("bucket=")) for n in self.storage.names(f"delta/batch={b}") if n.startswith("bucket=")} for b in batches), set())
        number = version["number"] + 1
        folder = f"{self.storage.root}/state/v={number}"
        rows = self.state(sorted(touched)).withColumn("bucket", self._bucket())
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(folder)
        made = {n.removeprefix("bucket="): number for n in self.storage.names(f"state/v={number}") if n.startswith("bucket=")}
        top = self._read(STATE, "state", [f"v={number}/bucket={b}" for b in made]).agg(F.max("scan_id")).first()[0] or 0
        new = {"number": number, "upto": batches[-1], "max_id": max(version["max_id"], top), "bucket_size": self.bucket_size, "buckets": version["buckets"] | made}
        self.storage.publish(f"versions/{number:012d}", json.dumps(new))
        self._clear(version, new)

    def _clear(self, before: dict, now: dict) -> None:
        """Deletes what neither of the last two versions needs."""
        for n in self.storage.names("delta"):
            if n.startswith("batch=") and int(n.removeprefix("batch=")) <= before["upto"]:
                self.storage.delete(f"delta/{n}")
        needed = {*before["buckets"].values(), *now["buckets"].values()}
        for n in self.storage.names("state"):
            if n.startswith("v=") and int(n.removeprefix("v=")) not in needed:
                self.storage.delete(f"state/{n}")
        for n in self.storage.names("versions"):
            if int(n) < before["number"]:
                self.storage.delete(f"versions/{n}")
