"""The poll that ends, statements as SQL text, and the stream into the ledger."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leafpress.plans import statements
from leafpress.session import scratch
from leafpress.streaming import poll

HOUR = timedelta(hours=1)


def ended(rows, silence, top):
    """scan -> (outcome, polls, at) by definition."""
    out = {}
    for scan in {r[0] for r in rows}:
        mine = sorted((r[2], r[1]) for r in rows if r[0] == scan)
        for n, (ts, status) in enumerate(mine, 1):
            after = mine[n][0] if n < len(mine) else None
            if status != "Pending":
                out[scan] = (status, n, ts)
            elif (after and after > ts + silence) or (after is None and ts + silence < top):
                out[scan] = ("Stalled", n, ts + silence)
            if scan in out:
                break
    return out


@pytest.mark.parametrize("files", [1, 4])
def test_poll_outcomes(spark, tmp_path, files):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [(rng.randrange(40), rng.choice(["Pending", "Pending", "Pending", "Completed", "Failed: x"]), start + rng.randrange(60) * HOUR + timedelta(milliseconds=rng.randrange(1000))) for _ in range(150)]
    rows += [(99, "Pending", start + 70 * HOUR), (98, "Pending", start + 69 * HOUR)]  # still open, as nothing later comes
    df = spark.createDataFrame(rows, "scan_id long, status string, ts timestamp")
    poll.in_time_order(df, "ts", f"{tmp_path}/land", files)
    got = {r.scan_id: (r.outcome, r.polls, r.at) for r in poll.polled(spark, f"{tmp_path}/land", df.schema, lambda s: s, 6 * 3_600_000, str(tmp_path)).collect()}
    assert got == ended(rows, 6 * HOUR, start + 70 * HOUR)
    assert {o.split(":")[0] for o, _, _ in got.values()} == {"Completed", "Failed", "Stalled"} and not {98, 99} & set(got)


def test_scans_of_a_bucket_share_a_group(spark, tmp_path):
    rng = random.Random(6)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice([-5, -4, 0, 1, 2, 3, 4, 5, 6, 7, 1 << 40]), rng.choice(["Pending", "Pending", "Completed"]), start + rng.randrange(90) * HOUR) for _ in range(60)]
    rows += [(scan, "Pending", start + (2 * scan) * HOUR) for scan in range(10, 30)] + [(30, "Pending", start + 94 * HOUR), (31, "Pending", start + 100 * HOUR)]
    df = spark.createDataFrame(rows, "scan_id long, status string, ts timestamp")
    calls, got = [], {}
    for bucket in (4, 64):
        folder = tmp_path / str(bucket)
        poll.in_time_order(df, "ts", f"{folder}/land", 3)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/land")
        done = poll.outcomes(stream, 6 * 3_600_000, bucket=bucket).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
        query = done.outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        calls.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress))
        got[bucket] = {r.scan_id: (r.outcome, r.polls, r.at) for r in spark.read.schema(poll.OUTCOME).parquet(f"{folder}/out").collect()}
    assert got[4] == got[64] == ended(rows, 6 * HOUR, start + 100 * HOUR) and 30 not in got[4]
    assert calls[1] <= 3 < calls[0] < len({r[0] for r in rows})  # groups with a state, not one a scan


def test_statements(spark):
    t = statements.Statements(spark, "scans_t1", scratch(spark))
    hostile = "x', 'y'); DROP TABLE scans_t1; --"
    t.insert_one(1, hostile)
    t.insert_one(2, "b.png")
    t.update_one(2, "Completed", "text ' \" ;", "p.docx")
    t.update_one(7, "Completed")  # unknown: nothing happens
    assert {(r.id, r.filename, r.status, r.text_content, r.docx_path) for r in t.select().collect()} == {(1, hostile, "Pending", None, None), (2, "b.png", "Completed", "text ' \" ;", "p.docx")}
    t.update_one(2, "Failed: boom")
    one = t.select(2).first()
    assert (one.status, one.text_content, one.docx_path) == ("Failed: boom", None, None)
    assert t.select(7).count() == 0 and t.select(1).first().filename == hostile
    with pytest.raises(Exception):
        statements.Statements(spark, "a; DROP TABLE scans_t1", scratch(spark))
    again = statements.Statements(spark, "scans_t1", scratch(spark))  # IF NOT EXISTS
    assert again.select().count() == 2
    plan = t.select(1)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(scan_id,1)" in plan
    spark.createDataFrame([(3, "c", datetime(2024, 1, 1))], "scan_id long, filename string, at timestamp").createOrReplaceTempView("ups_t1")
    t.insert("ups_t1")
    assert t.select(3).select(F.col("created_at").cast("string")).first()[0] == "2024-01-01 00:00:00"
