"""What the operators of this folder share: tables, scratch tables in the
cluster's shared folder, and connected components."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes that Spark hands to a Python worker at a time.
BATCH_BYTES = 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_live: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH", "")]))
    # long texts: a Python worker holds some MB of them at a time
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session may go without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if getattr(shared_folder, "own", None) is None:
        shared_folder.own = tempfile.mkdtemp(prefix="spark-tidewater-")
    return shared_folder.own


class Scratch:
    """Written tables that cut lineage: a lost executor rereads them.

    They live until :func:`release` or the end of the driver, since a lazy
    result may still read them.
    """

    def __init__(self, spark: SparkSession, tidy: bool = False):
        """``tidy``: shuffle files of a table go once it is written, not when the
        driver collects garbage. For jobs of many tables."""
        self.spark, self.tidy = prepare(spark), tidy
        self.folder = f"{shared_folder(spark)}/tidewater-{uuid.uuid4().hex}"
        _live.append((spark, self.folder))

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` once and return it as read from there."""
        path, before = self.path(name), self.spark.conf.get(_CLEANUP, "false")
        if self.tidy:
            self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if self.tidy:
                self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        _delete(self.spark, df.scratch_path)


def _delete(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def made_since(n: int) -> list[tuple[SparkSession, str]]:
    """Scratch folders made after the first ``n``."""
    return _live[n:]


def made() -> int:
    return len(_live)


def release(some: list[tuple[SparkSession, str]] | None = None) -> None:
    """Delete scratch tables, all or some, whose results have been written
    elsewhere by now."""
    for spark, folder in list(_live) if some is None else some:
        try:
            _delete(spark, folder)
        except Exception:  # the session has ended, or the folder with it
            pass


atexit.register(release)


def renamed(df: DataFrame) -> DataFrame:
    """Columns by number, but for doc_id and text: names with dots do not pass
    into Python by name."""
    return df.toDF(*(c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(df.columns)))


def drawn(df: DataFrame, by: str, key: list[str], n: int, most: int = 1000, seed: int = 3) -> DataFrame:
    """``n`` rows of each value of ``by`` (of the ``most`` commonest values):
    those of least hash of ``key``, numbered in column n.

    Counts come first and give a threshold that eight times as many rows pass,
    so what meets in a task does not grow with the table.
    """
    h = F.xxhash64(*key, F.lit(seed))
    counts = df.groupBy(by).count().orderBy(F.desc("count"), by).limit(most).collect()
    rate = F.lit(None).cast("double")
    if counts:
        rate = F.create_map(*(x for r in counts for x in (F.lit(r[by]), F.lit(min(1.0, 8.0 * n / r["count"])))))[F.col(by)]
    some = df.where((h / F.lit(2.0**64)) + 0.5 <= rate)
    place = F.row_number().over(Window.partitionBy(by).orderBy(h, *key))
    return some.withColumn("n", place).where(F.col("n") <= n)


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): node, root (the least node).

    Alternates the two star steps of Kiveris et al. (SoCC 2014): each node
    hands its larger, then its smaller neighbours to the least of them, so a
    component of any shape becomes one star in O(log^2 n) rounds. Minima are
    aggregated before they move, and written before the join, so that Spark
    can split the edges of a hub.
    """
    edges = scratch.keep(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    last = None
    for _ in range(most_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.hash("b", "a").cast("long"))).first()
        if state == last:
            break
        last = state
        both = edges.union(edges.select("b", "a"))
        least = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = scratch.keep(
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "large"
        )
        least2 = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        new = scratch.keep(small.union(least2.select("a", "m")).distinct(), "edges")
        for old in (edges, least, large, least2):
            scratch.drop(old)
        edges = new
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
