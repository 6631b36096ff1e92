"""Token ids in ORC files.

Documents are range-partitioned and sorted by doc_id, encoded, and written as
one ORC file a range: ids as integer run-length columns, a row index every
``ROW_INDEX`` rows, Bloom filters on doc_id. Readers take stripes in parallel
and prune files, stripes and row groups by doc_id from metadata alone. Each row
keeps the ids that its file holds before it, so a place in the whole needs the
totals of the files only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, prepare
from .tokens import encoder

ROW_INDEX = 1000
STRIPE_BYTES = 16 << 20


def _encoded(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ahead = encoder(path), 0
        for batch in batches:
            ids = [x + end for x in enc.encode_all(batch.column("text").to_pylist())]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ahead + ends[:-1]), pa.array(np.diff(ends)), lists], ["doc_id", "ahead", "n_tokens", "ids"])
            ahead += int(ends[-1])

    return run


_ROW = "doc_id long, ahead long, n_tokens long, ids array<int>"


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int, files: int | None = None, stripe_bytes: int = STRIPE_BYTES) -> None:
    """Write doc_id, ahead, n_tokens, ids in ascending doc_id order (null first;
    rows with one doc_id by a hash of the text, then by the text). ``ahead``
    counts the ids before the row in its file. Null and empty texts hold the
    end id alone. ``files`` is the session's number of shuffle partitions
    unless given; a crowd of rows with one id spreads over several."""
    prepare(spark)
    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("h"))
    ordered = cols.repartitionByRange(*([files] if files else []), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    rows = ordered.mapInArrow(_encoded(tokenizer, end_id), _ROW)
    rows.write.options(
        **{
            "compression": "zstd",
            "orc.bloom.filter.columns": "doc_id",
            "orc.bloom.filter.fpp": "0.01",
            "orc.row.index.stride": str(ROW_INDEX),
            "orc.stripe.size": str(stripe_bytes),
        }
    ).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ROW).orc(path)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat = np.asarray(ids.flatten()).astype("<u4")
        ends = np.r_[0, np.cumsum(np.asarray(ids.value_lengths()))]
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("file"), batch.column("ahead"), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())],
            ["doc_id", "file", "ahead", "n_tokens", "ids_crc32"],
        )


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file, ahead, n_tokens, ids_crc32 of every stored document, from its stored ids."""
    rows = read_tokens(spark, path).select("doc_id", "ahead", "ids", F.col("_metadata.file_name").alias("file"))
    return rows.mapInArrow(_checksums, "doc_id long, file string, ahead long, n_tokens long, ids_crc32 long")


def token_digest(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as ORC, read the files back, and return doc_id, start,
    n_tokens and ids_crc32 from them."""
    scratch = Scratch(spark)
    path = scratch.path("ids")
    write_tokens(spark, docs, path, tokenizer, end_id)
    rows = scratch.keep(token_index(spark, path), "index")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # one row a file: names begin with the range's number, in five digits or more
    before = F.sum("n").over(Window.orderBy(F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("file", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(files, "file").select("doc_id", (F.col("base") + F.col("ahead")).cast("long").alias("start"), "n_tokens", "ids_crc32")
