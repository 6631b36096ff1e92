"""Streaming queries: the events table read as a stream and run to its end;
on such closed data they equal the batch results that the SQL states."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import streams as S
from .fixtures import ACC, NEAR, SESS, Registry, access_events, load, text, with_

add = Registry()
_HOLD = "60 days"  # no row of the table is late


def _folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/streams-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-streams-")


def _source(spark: SparkSession, df: DataFrame, files: int = 4) -> DataFrame:
    """``df`` written as Parquet files and read as a stream of them."""
    path = f"{_folder(spark)}/source"
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


def _drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream puts out, as a table; ``complete`` keeps the last state."""
    folder = _folder(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{'all' if mode == 'complete' else f'b={batch_id}'}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{folder}/out/{'all' if mode == 'complete' else '*'}")
    return out.select(*stream.columns)


@add("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY 1, 2")
def x1_stream_dedup(spark, d):
    """Each event sent twice, and counted once."""
    e = load(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    once = S.stream_dedup(_source(spark, e.union(e)), "ts", ["event_id"], _HOLD)
    return _drained(spark, once).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@add("SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events GROUP BY 1, 2")
def x2_stream_counts(spark, d):
    e = load(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    o = _drained(spark, S.stream_counts(_source(spark, e), "ts", "user_id", "1 hour", None, _HOLD), "complete")
    return o.select("user_id", text("start").alias("start"), "n")


@add("SELECT user_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT user_id, time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS s FROM events, (SELECT unnest(range(4)) AS k)) GROUP BY 1, 2")
def x2_stream_sliding_counts(spark, d):
    e = load(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    panes = _drained(spark, S.stream_counts(_source(spark, e), "ts", "user_id", "15 minutes", None, _HOLD), "complete")
    o = S.sliding_counts(panes, "user_id", 3600, 900)
    return o.select("user_id", text("start").alias("start"), "n")


@add(with_(ACC, NEAR, SESS) + "SELECT account, host, strftime(unlock_time, '%Y-%m-%d %H:%M:%S') AS unlock_time, strftime(lock_time, '%Y-%m-%d %H:%M:%S') AS lock_time, CAST(epoch(lock_time) - epoch(unlock_time) AS BIGINT) AS duration_ts FROM sess")
def x3_stream_sessions(spark, d):
    return _sessions(spark, d).where("lock_time IS NOT NULL").select("account", "host", text("unlock_time").alias("unlock_time"), text("lock_time").alias("lock_time"), "duration_ts")


@add(with_(ACC, NEAR) + "SELECT account, host, strftime(ts, '%Y-%m-%d %H:%M:%S') AS unlock_time FROM near WHERE opens AND next_lock IS NULL")
def x3_stream_open_unlocks(spark, d):
    """Unlocks that no lock has followed, put out by their timers."""
    return _sessions(spark, d).where("lock_time IS NULL").select("account", "host", text("unlock_time").alias("unlock_time"))


def _sessions(spark, d):
    """A last row in the far future moves the watermark past all others."""
    e = access_events(spark, d).select("account", "host", F.col("ts").cast("timestamp").alias("ts"), "activity")
    end = spark.createDataFrame([("~", "~", "Lock")], "account string, host string, activity string").select("account", "host", F.lit("2100-01-01 00:00:00").cast("timestamp").alias("ts"), "activity")
    path = f"{_folder(spark)}/source"
    e.repartition(3).write.parquet(path)
    end.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(e.schema).parquet(path)
    return _drained(spark, S.stream_sessions(stream, "0 seconds", limit="3650 days"))


@add("SELECT user_id, CASE WHEN event_type = 'error' THEN 'HIGH' ELSE 'CRITICAL' END AS severity, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS follow_up_at FROM events WHERE event_type IN ('error', 'purchase')")
def x4_stream_interventions(spark, d):
    t = F.col("event_type")
    e = load(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.when(t == "error", "HIGH").when(t == "purchase", "CRITICAL").otherwise("LOW").alias("severity"))
    return _drained(spark, S.stream_interventions(_source(spark, e))).select("user_id", "severity", text("follow_up_at").alias("follow_up_at"))


@add("SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def x5_stream_gap_sessions(spark, d):
    e = load(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    o = _drained(spark, S.stream_gap_sessions(_source(spark, e), "ts", "user_id", "6 hours", _HOLD), "complete")
    return o.select("user_id", text("start").alias("start"), "n")


@add("SELECT user_id, event_id AS last_event, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def x6_stream_upsert(spark, d):
    """Each user's last event, by micro-batches in which users come again and again."""
    e = load(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    folder = _folder(spark)
    S.stream_upsert(_source(spark, e), f"{folder}/table", ["user_id"], f"{folder}/checkpoint", ["ts", "event_id"], 16).awaitTermination()
    return S.read_upserted(spark, f"{folder}/table", e.schema).select("user_id", F.col("event_id").alias("last_event"), "event_type", text("ts").alias("ts"))
