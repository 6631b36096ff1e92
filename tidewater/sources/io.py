"""Readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import expressions as X
from ..operators.records import upsert
from ..session import settle


def read_csv(spark: SparkSession, path: str, schema: str | StructType, sep: str = ",", header: bool = True, ts_format: str | None = None) -> DataFrame:
    options = {"sep": sep, "header": header} | ({"timestampFormat": ts_format} if ts_format else {})
    return spark.read.schema(schema).options(**options).csv(path)


def read_combined(spark: SparkSession, paths: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Parquet files of all paths by column name, without the named files;
    files that cannot be read are passed over."""
    read = spark.read.option("ignoreCorruptFiles", True).option("mergeSchema", True)
    out = read.parquet(*paths)
    if exclude:
        out = out.where(~F.col("_metadata.file_name").isin(*exclude))
    return out


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json_logs(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Files that each hold one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_conversations(spark: SparkSession, path: str, splits: Sequence[str] = ("train", "dev", "test")) -> DataFrame:
    """split, convo_id, turn, role, text from (gzipped) JSON of splits."""
    schema = ", ".join(f"{s} array<struct<convo_id: int, original: array<array<string>>>>" for s in splits)
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    out = None
    for s in splits:
        part = raw.select(F.lit(s).alias("split"), F.explode(s).alias("c")).select("split", "c.convo_id", F.posexplode("c.original").alias("turn", "said"))
        part = part.select("split", "convo_id", "turn", F.col("said")[0].alias("role"), F.col("said")[1].alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files under ``folder``, listed by a few tasks a core and not one a folder."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(4 * spark.sparkContext.defaultParallelism))
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    finally:
        spark.conf.set(_LISTING, before)


def read_labelled_files(spark: SparkSession, csv: str, folder: str, schema: str, name: str = "imageFile") -> DataFrame:
    """A label table and the bytes of the files it names."""
    files = read_files(spark, folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias(name), "length", "content")
    return read_csv(spark, csv, schema).join(files, name)


def read_profile(spark: SparkSession, table: str, url: str | None = None, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A profile table from a database, or from Parquet if there is no url.

    With a numeric ``column`` the table is read over ``parts`` connections, each
    a range of it between ``bounds`` (asked for over one connection if none);
    rows beyond them and rows without a value come with the first or last range."""
    if not url:
        return spark.read.parquet(table)
    read = spark.read.options(**options)
    if column is None:
        return read.jdbc(url, table)
    low, high = bounds or spark.read.options(**options).jdbc(url, table).agg(F.min(column), F.max(column)).first()
    if low is None or low == high:
        return read.jdbc(url, table)
    return read.options(partitionColumn=column, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=parts).jdbc(url, table)


def write_profile(df: DataFrame, table: str, url: str, mode: str = "overwrite", parts: int = 8, **options: str) -> None:
    """``df`` as a table of a database, over at most ``parts`` connections; an
    overwritten table keeps its columns where the database can empty it."""
    df.write.options(truncate=True, numPartitions=parts, **options).mode(mode).jdbc(url, table)


def upsert_profile(updates: DataFrame, table: str, url: str, keys: Sequence[str], column: str | None = None, parts: int = 8, **options: str) -> None:
    """Rows of ``updates`` replace those with their keys in the database. The new
    table stands in the shared folder before the old one is emptied, so a task
    that is lost while writing reads it from there."""
    old = read_profile(updates.sparkSession, table, url, column, parts=parts, **options)
    write_profile(settle(upsert(old, updates, keys)), table, url, parts=parts, **options)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON text a row, times as ISO."""
    return df.select(F.to_json(F.struct(*df.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    json_lines(df).write.mode(mode).text(path)


def write_by_hour(df: DataFrame, path: str, ts: str, tz: str = "America/New_York", mode: str = "append") -> None:
    df.withColumn("hour_stamp", X.hour_partition(F.col(ts), tz)).write.mode(mode).partitionBy("hour_stamp").parquet(path)


def write_lines(df: DataFrame, path: str, column: str = "line", mode: str = "overwrite") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def flatten_list_columns(df: DataFrame) -> DataFrame:
    """Each list column becomes its second element, else its first, else ""."""
    return df.select(*(X.second_or_first(F.col(f.name)).alias(f.name) if isinstance(f.dataType, ArrayType) else f.name for f in df.schema))


def stringify_ids(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("array<string>" if isinstance(df.schema[n].dataType, ArrayType) else "string") for n in names})
