"""Structured Streaming jobs: deduplication, windows, sessions, upserts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.logs import LOCKS, UNLOCKS


def stream_dedup(events: DataFrame, ts: str, keys: Sequence[str], delay: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_counts(events: DataFrame, ts: str, key: str, size: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    counts = events.withWatermark(ts, delay).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sliding_counts(panes: DataFrame, key: str, size_s: int, slide_s: int) -> DataFrame:
    """Counts of sliding windows from those of their panes, windows of
    ``slide_s`` seconds without overlap: key, start, end, n. A stream that
    counts panes keeps a row a pane, not one for each window that covers it."""
    if size_s % slide_s:
        raise ValueError("a window has to be a whole number of panes")
    ago = F.explode(F.sequence(F.lit(0), F.lit(size_s // slide_s - 1)))
    starts = panes.select(key, "start", "n", ago.alias("_ago")).withColumn("start", F.timestamp_micros(F.unix_micros("start") - F.col("_ago").cast("long") * slide_s * 1_000_000))
    counts = starts.groupBy(key, "start").agg(F.sum("n").alias("n"))
    return counts.select(key, "start", F.timestamp_micros(F.unix_micros("start") + size_s * 1_000_000).alias("end"), "n")


def stream_gap_sessions(events: DataFrame, ts: str, key: str, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    counts = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


_SESSIONS = "account string, host string, unlock_time timestamp, lock_time timestamp, duration_ts long"


def _pair(limit: int):
    """State: the open unlocks since the last lock and rows newer than the watermark, as microseconds."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opens, waiting = (list(x) for x in state.get) if state.exists else ([], [])
        waiting = [tuple(x) for x in waiting]
        for f in frames:
            waiting += list(zip(f.us.astype("int64").tolist(), f.opens.astype(int).tolist()))
        mark = state.getCurrentWatermarkMs() * 1000
        ready = sorted(x for x in waiting if x[0] <= mark)
        waiting = [x for x in waiting if x[0] > mark]
        out: list[tuple[int, int | None]] = []

        def expire(now: int) -> None:
            """Unlocks that no lock has followed within the limit."""
            while opens and opens[0] + limit < now:
                out.append((opens.pop(0), None))

        for us, is_unlock in ready:
            expire(us)
            # of rows at one time a lock comes first: it does not close an unlock of that time
            if is_unlock:
                opens.append(us)
            elif opens and us > opens[0]:
                later = [x for x in opens if x >= us]
                out.append((opens[0], us))
                opens[:] = later
        expire(mark)
        if not opens and not waiting:
            state.remove()
        else:
            state.update((opens, [list(x) for x in waiting]))
            # once the watermark is past the newest waiting row all are ready; an open unlock has its own end
            timers = [max(x[0] for x in waiting)] if waiting else []
            timers += [opens[0] + limit] if opens else []
            state.setTimeoutTimestamp(max(min(timers), mark) // 1000 + 1)
        if out:
            start, end = (np.array([np.datetime64(x[i], "us") if x[i] is not None else np.datetime64("NaT") for x in out], "datetime64[us]") for i in (0, 1))
            seconds = pd.array([x[1] // 1_000_000 - x[0] // 1_000_000 if x[1] is not None else None for x in out], "Int64")
            yield pd.DataFrame({"account": key[0], "host": key[1], "unlock_time": start, "lock_time": end, "duration_ts": seconds})

    return run


def stream_sessions(events: DataFrame, delay: str = "1 hour", unlocks: Sequence[str] = UNLOCKS, locks: Sequence[str] = LOCKS, limit: str = "30 days") -> DataFrame:
    """Sessions as rows pass the watermark, each emitted when its lock does;
    an unlock without a lock within ``limit`` is emitted with none (null) when
    the watermark is past its limit, and leaves the state.

    State of an account and host: unlocks since the last lock, for ``limit`` at
    most, and rows that may still be preceded by late ones. On closed data the
    same as the batch sessions and the unmatched unlocks.
    """
    rows = events.withWatermark("ts", delay).where(F.col("activity").isin(*unlocks, *locks))
    rows = rows.select("account", "host", "ts", F.unix_micros("ts").alias("us"), F.col("activity").isin(*unlocks).cast("int").alias("opens"))
    pair = _pair(int(pd.Timedelta(limit).total_seconds() * 1_000_000))
    return rows.groupBy("account", "host").applyInPandasWithState(pair, _SESSIONS, "opens array<long>, waiting array<array<long>>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_interventions(alerts: DataFrame, levels: Sequence[str] = ("HIGH", "CRITICAL", "EMERGENCY")) -> DataFrame:
    """Stateless: a follow-up an hour after each severe alert."""
    return alerts.where(F.col("severity").isin(*levels)).select("user_id", "severity", F.col("ts").alias("alert_at"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("follow_up_at"), F.lit(True).alias("follow_up_required"))


def upsert_into(path: str, keys: Sequence[str], order: Sequence[str], buckets: int = 64):
    """A foreachBatch function: the table at ``path`` with the batch's rows put in.

    The table lies in hash buckets of its keys. A batch rewrites the buckets
    that its keys touch, under its own number, then writes a manifest that
    names the newest version of every bucket; readers follow the last whole
    manifest (:func:`read_upserted`). Of a key's rows, within a batch and over
    batches, the one that is last in ``order`` stays; on a tie the newer batch's.
    A retried batch changes nothing once its manifest is there. Versions that
    the last two manifests do not name are removed.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = _manifests(spark, path)
        if batch_id in known or batch.isEmpty():
            return
        named = _named(spark, path, max(known)) if known else {}
        number = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = _last(batch.withColumn("_batch", F.lit(batch_id)), keys, [*order, "_batch"]).withColumn("_bucket", number)
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # numbers of buckets
        old = [_version(path, named[b], b) for b in touched if b in named]
        if old:
            before = spark.read.schema(batch.schema).parquet(*old).withColumn("_batch", F.lit(-1)).withColumn("_bucket", number)
            new = _last(new.unionByName(before), [*keys, "_bucket"], [*order, "_batch"])
        new.drop("_batch").repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/v{batch_id}")
        now = named | {b: batch_id for b in touched}
        spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/m{batch_id}")
        if known:
            held = set(now.items()) | set(named.items())
            for n in sorted(known)[:-1]:
                for b, v in _named(spark, path, n).items():
                    if (b, v) not in held:
                        _delete(spark, _version(path, v, b))
                _delete(spark, f"{path}/manifest/m{n}")

    return run


def read_upserted(spark, path: str, schema) -> DataFrame:
    """The table as the last whole manifest names it."""
    known = _manifests(spark, path)
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(_version(path, v, b) for b, v in sorted(_named(spark, path, max(known)).items())))


def _last(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, by partial aggregation."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return best.select(*keys, *(F.col("_row")[c].alias(c) for c in others)).select(*rows.columns)


def _version(path: str, version: int, bucket: int) -> str:
    return f"{path}/data/v{version}/_bucket={bucket}"


def _named(spark, path: str, batch_id: int) -> dict[int, int]:
    return {r.bucket: r.version for r in spark.read.parquet(f"{path}/manifest/m{batch_id}").collect()}  # a row a bucket


def _files(spark, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifests(spark, path: str) -> list[int]:
    p, fs = _files(spark, f"{path}/manifest")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return [int(n[1:]) for n in names if fs.exists(_files(spark, f"{path}/manifest/{n}/_SUCCESS")[0])]


def _delete(spark, path: str) -> None:
    p, fs = _files(spark, path)
    fs.delete(p, True)


def stream_upsert(updates: DataFrame, path: str, keys: Sequence[str], checkpoint: str, order: Sequence[str], buckets: int = 64):
    """The started query; ``availableNow`` processes what is there and ends."""
    return updates.writeStream.foreachBatch(upsert_into(path, keys, order, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
