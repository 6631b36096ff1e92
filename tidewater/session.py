"""SparkSession settings that the jobs rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def settled(spark: SparkSession) -> SparkSession:
    """UTC and adaptive execution; both can be set on a running session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def settle(df: DataFrame) -> DataFrame:
    """``df`` as read from the shared folder of ``spark.checkpoint.dir``, which
    cuts its lineage; only a local session may go without that setting."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-tidewater-"))
    return df.checkpoint()
