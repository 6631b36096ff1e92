"""Streams with state: timers of open sessions, and a table kept by micro-batches."""

import datetime as dt
import os

from pyspark.sql import functions as F

from tidewater.operators import logs as L
from tidewater.streaming import streams as S

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def run(spark, folder, stream):
    rows = []

    def keep(batch, _):
        rows.extend(batch.collect())

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return rows, q.lastProgress["stateOperators"][0]["numRowsTotal"]


def streamed(spark, folder, batches, limit):
    schema = "account string, host string, ts timestamp, activity string"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/s")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/s")
    return run(spark, folder, S.stream_sessions(stream, "0 seconds", limit=limit))


END = [("~", "~", at(24 * 365), "Lock")]


def test_open_unlocks_leave_by_their_timer(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = [
        [("a", "p", at(1), "Unlock"), ("a", "p", at(2), "Unlock"), ("a", "p", at(3), "Lock"), ("b", "p", at(1), "Unlock")],
        [("a", "p", at(4), "Unlock"), ("a", "p", at(4), "Lock"), ("a", "p", at(5), "Logon"), ("c", "p", at(6), "Lock")],
        END,
    ]
    got, left = streamed(spark, str(tmp_path), rows, "2000 days")
    # the far row has not passed the limit of 2000 days: open unlocks wait
    assert {(r.account, r.unlock_time, r.lock_time) for r in got} == {("a", at(1), at(3))} and left == 3
    (tmp_path / "2").mkdir()
    got, left = streamed(spark, str(tmp_path / "2"), rows, "30 days")
    assert sorted((r.account, r.unlock_time, r.lock_time is None, r.duration_ts) for r in got) == [("a", at(1), False, 7200), ("a", at(4), True, None), ("a", at(5), True, None), ("b", at(1), True, None)]
    assert left == 1  # the far row itself
    batch = spark.createDataFrame([x for b in rows[:2] for x in b], "account string, host string, ts timestamp, activity string")
    both = {(r.account, r.unlock_time) for r in L.match_sessions(batch).collect()} | {(r.account, r.unlock_time) for r in L.unmatched_unlocks(batch).collect()}
    assert {(r.account, r.unlock_time) for r in got} == both


def test_a_lock_after_the_limit_closes_nothing(spark, tmp_path):
    rows = [[("a", "p", at(0), "Unlock"), ("a", "p", at(30), "Unlock"), ("a", "p", at(50), "Lock")], END]
    got, _ = streamed(spark, str(tmp_path), rows, "40 hours")
    assert sorted((r.unlock_time, r.lock_time) for r in got if r.lock_time is not None) == [(at(30), at(50))]
    assert [r.unlock_time for r in got if r.lock_time is None] == [at(0)]


def test_upsert_keeps_the_last_row_of_each_key(spark, tmp_path):
    schema = "id long, t long, v string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    path = str(tmp_path / "t")
    put = S.upsert_into(path, ["id"], ["t"], 8)
    read = lambda: {r.id: (r.t, r.v) for r in S.read_upserted(spark, path, schema).collect()}
    assert read() == {}
    put(frame([(i, 1, "a") for i in range(40)] + [(3, 5, "late"), (3, 2, "early"), (None, 1, "null")]), 0)
    want = {i: (1, "a") for i in range(40)} | {3: (5, "late"), None: (1, "null")}
    assert read() == want
    put(frame([(3, 4, "older"), (7, 1, "tie"), (90, 1, "new"), (90, 0, "x")]), 1)
    want |= {7: (1, "tie"), 90: (1, "new")}
    assert read() == want
    put(frame([(7, 9, "again")]), 1)  # a batch that has been put in already
    assert read() == want
    put(frame([]), 2)
    assert read() == want
    put(frame([(7, 9, "b")]), 3)
    put(frame([(7, 8, "c"), (7, 10, "d")]), 4)
    assert read() == want | {7: (10, "d")}
    versions = {v: set(os.listdir(f"{path}/data/{v}")) for v in os.listdir(f"{path}/data") if os.path.isdir(f"{path}/data/{v}")}
    buckets = {v: {x for x in names if x.startswith("_bucket")} for v, names in versions.items()}
    assert len(buckets["v4"]) == 1 and len(buckets["v1"]) <= 3  # touched ones only
    assert buckets["v4"] & buckets["v3"] and not buckets["v4"] & (buckets["v0"] | buckets["v1"])  # the last two remain
    assert sorted(os.listdir(f"{path}/manifest"))[-2:] == ["m3", "m4"] and "m0" not in os.listdir(f"{path}/manifest")


def test_upsert_by_two_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    put = S.upsert_into(path, ["a", "b"], ["t"], 2)
    put(spark.createDataFrame([(1, "x", 1), (1, "y", 1)], "a int, b string, t int"), 0)
    put(spark.createDataFrame([(1, "x", 2)], "a int, b string, t int"), 1)
    assert sorted(map(tuple, S.read_upserted(spark, path, "a int, b string, t int").collect())) == [(1, "x", 2), (1, "y", 1)]
    assert S.read_upserted(spark, path, "a int, b string, t int").where(F.col("t") > 1).count() == 1
