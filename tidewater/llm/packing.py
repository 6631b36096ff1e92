"""Cost-balanced packing of documents into sequences of bounded length.

A document of n tokens costs ``linear * n + quadratic * n * n``. Whole
multiples of the sequence length become sequences of their own while the text
is tokenised; the rests are dealt into buckets of about ``BUCKET_ROWS`` rows
(by a hash, so a bucket needs one task's memory whatever the corpus), and in a
bucket go in descending order to the cheapest sequence that has room. A bucket
opens just as many sequences as its tokens fill; what fits in none is cut
between the emptiest, so a bucket pads less than one sequence in all.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare
from .tokens import encoder

BUCKET_ROWS = 1024
_PIECE = "doc_id long, bucket long, start long, length long, doc_tokens long, ids_crc32 long, ids binary"


def _tokenised(path: str, end_id: int, length: int, buckets: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows = []
            keys = batch.column("doc_id").to_pylist()
            bucket = batch.column("bucket").to_pylist()
            for key, at, ids in zip(keys, bucket, enc.encode_all(batch.column("text").to_pylist())):
                ids += end
                n = len(ids) // 4
                full = n - n % length
                for start in range(0, full, length):
                    rows.append((key, at, start, length, n, zlib.crc32(ids[4 * start : 4 * (start + length)]), None))
                if full < n:  # ids under 2**16 travel in half the bytes
                    rest = np.frombuffer(ids, "<u4", offset=4 * full)
                    rows.append((key, at, full, n - full, n, None, rest.astype("<u2").tobytes() if rest.max() < 65536 else b"4" + rest.tobytes()))
            yield pa.RecordBatch.from_pydict(
                dict(zip(("doc_id", "bucket", "start", "length", "doc_tokens", "ids_crc32", "ids"), zip(*rows) if rows else [[]] * 7)),
                schema=pa.schema([("doc_id", pa.int64()), ("bucket", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]),
            )

    return run


def assign(sizes: list[int], length: int, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, size, sequence, offset) for ``sizes``, given in
    descending order: the cheapest sequence with room takes the whole item; if
    none has room it is cut, and the emptiest sequences take the parts."""
    total = sum(sizes)
    n = -(-total // length)
    room, cost = [length] * n, [0.0] * n
    heap = [(0.0, s) for s in range(n)]
    out, late = [], []
    for item, size in enumerate(sizes):
        aside = []
        while heap and room[heap[0][1]] < size:
            aside.append(heapq.heappop(heap))
        if heap:
            _, s = heapq.heappop(heap)
            out.append((item, 0, size, s, length - room[s]))
            room[s] -= size
            cost[s] += linear * size + quadratic * size * size
            if room[s]:
                heapq.heappush(heap, (cost[s], s))
        else:
            late.append(item)
        for x in aside:  # still open to smaller items
            heapq.heappush(heap, x)
    open_ = sorted((s for s in range(n) if room[s]), key=lambda s: (-room[s], cost[s], s))
    at = 0
    for item in late:
        start = 0
        while start < sizes[item]:
            s = open_[at]
            size = min(room[s], sizes[item] - start)
            out.append((item, start, size, s, length - room[s]))
            room[s] -= size
            start += size
            at += not room[s]
    return out


def _packed(length: int, linear: float, quadratic: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cost = linear * rows.length + quadratic * rows.length.astype(float) ** 2
        rows = rows.assign(cost=cost).sort_values(["cost", "doc_id", "start", "ids_crc32", "ids"], ascending=[False, True, True, True, True], kind="stable", na_position="first")
        full, rest = rows[rows.ids.isna()], rows[rows.ids.notna()]
        base = int(rows.bucket.iloc[0]) << 32
        whole = pd.DataFrame({"doc_id": full.doc_id, "start": full.start, "length": full.length, "ids_crc32": full.ids_crc32, "doc_tokens": full.doc_tokens, "sequence_id": base + np.arange(len(full)), "offset": 0})
        base += len(full)
        pieces = assign(rest.length.astype(int).tolist(), length, linear, quadratic)
        doc, start, ids, tokens = rest.doc_id.tolist(), rest.start.tolist(), rest.ids.tolist(), rest.doc_tokens.tolist()
        ids = [np.frombuffer(x[1:], "<u4") if len(x) % 2 else np.frombuffer(x, "<u2").astype("<u4") for x in ids]
        made = [(doc[i], start[i] + a, n, zlib.crc32(ids[i][a : a + n].tobytes()), tokens[i], base + s, at) for i, a, n, s, at in pieces]
        return pd.concat([whole, pd.DataFrame(made, columns=whole.columns)]).astype({"doc_id": "Int64", **{c: "int64" for c in whole.columns[1:]}})

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A null or empty text is the end id alone. Rows with one doc_id, or repeated
    rows, are packed each for itself. An empty table has no sequences.
    """
    prepare(spark)
    buckets = max(1, -(-docs.count() // BUCKET_ROWS))
    dealt = docs.select(
        F.col("doc_id").cast("long"),
        F.col("text").cast("string"),
        # the row's partition salts documents that share an id and a text
        F.pmod(F.xxhash64("doc_id", F.crc32("text"), F.spark_partition_id()), F.lit(buckets)).cast("long").alias("bucket"),
    )
    pieces = dealt.mapInArrow(_tokenised(tokenizer, end_id, length, buckets), _PIECE)
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return pieces.groupBy("bucket").applyInPandas(_packed(length, linear, quadratic), out)
