"""Nearest neighbours by cross-polytope hashing.

A table's hash rotates a unit vector by three rounds of random signs and a fast
Hadamard transform, and takes the nearest signed axis (Andoni et al., NeurIPS
2015): 2 * dim buckets. A vector lies in its nearest axis' bucket; a query also
looks into the next nearest axes (multiprobe). Each bucket compares its queries
with its vectors exactly and hands on only its best, so what is shuffled is a
bounded list for each query, table and block.

Inner products of vectors of any length become angles by one more coordinate
(Bachrach et al., RecSys 2014). Vectors are hashed in bands of like norm (from
2^(b - 1/2) to 2^(b + 1/2), so those of length 1 lie in the middle of one), each
by its own largest, so a few long vectors do not flatten the others; a query
looks into every band. Equal vectors are searched once and keep
the ids that can reach a result. Queries that meet fewer vectors than they ask
for are compared with all of them, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, prepare

TABLES, PROBES, SEED = 16, 16, 11
#: Vectors of a bucket that one task compares with, and queries of it that one task asks, at a time.
BLOCK, ASKS = 4096, 16_384


def _padded(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def rotations(dim: int, tables: int, seed: int) -> np.ndarray:
    """Signs, tables x 3 x padded dimension."""
    return np.random.Generator(np.random.PCG64(seed)).choice(np.array([-1.0, 1.0]), (tables, 3, _padded(dim)))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of signs and fast Hadamard transforms of the rows of x."""
    n, dim = len(x), signs.shape[-1]
    y = np.zeros((n, dim))
    y[:, : x.shape[1]] = x
    for s in signs:
        y = y * s
        half = 1
        while half < dim:
            z = y.reshape(n, -1, 2, half)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(n, dim)
            half *= 2
        y /= np.sqrt(dim)
    return y


def axes(y: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` nearest signed axes, nearest first: axis, or axis + dim for its negative."""
    dim = y.shape[1]
    both = np.concatenate([y, -y], axis=1)
    if most >= 2 * dim:
        return np.argsort(-both, axis=1, kind="stable")
    part = np.argpartition(-both, most, axis=1)[:, :most]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(both, part, 1), axis=1, kind="stable"), 1)


_HASHED = pa.schema([("bucket", pa.int64()), ("asks", pa.bool_()), ("place", pa.int64()), ("vector", pa.list_(pa.float64()))])


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()).reshape(-1, dim)


def _rows(bucket: np.ndarray, asks: bool, place: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    vectors = pa.ListArray.from_arrays(ends, pa.array(x.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(x), asks)), pa.array(place), vectors], schema=_HASHED)


def _hashed(dim: int, bands: list[tuple[int, float]], tables: int, probes: int, seed: int):
    """``bands``: number, and logarithm (base 2) of the largest norm."""
    signs = rotations(dim + 1, tables, seed)
    band_of, longest = np.array([b for b, _ in bands]), np.array([x for _, x in bands])
    step = tables * 2 * signs.shape[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, place = matrix(batch.column("vector"), dim), np.asarray(batch.column("place"))
            asks = np.asarray(batch.column("asks").to_numpy(zero_copy_only=False), bool)
            band = np.asarray(batch.column("band"))
            top = np.abs(x).max(axis=1, keepdims=True)  # before squares, which may leave the range of numbers
            norm = top[:, 0] * np.linalg.norm(x / top, axis=1)
            unit = x / top / np.linalg.norm(x / top, axis=1, keepdims=True)
            at = np.searchsorted(band_of, band)
            part = np.exp2(np.minimum(np.log2(norm) - longest[at], 0))  # of the band's largest norm
            data = np.c_[unit * part[:, None], np.sqrt(np.clip(1 - part**2, 0, None))]
            query = np.c_[unit[asks], np.zeros(asks.sum())]
            for t in range(tables):
                base = t * 2 * signs.shape[-1]
                yield _rows(at * step + base + axes(rotate(data, signs[t]), 1)[:, 0], False, place, x)
                if len(query):
                    look = axes(rotate(query, signs[t]), probes)
                    for b in range(len(bands)):
                        yield _rows(b * step + base + look.ravel(), True, np.repeat(place[asks], look.shape[1]), np.repeat(x[asks], look.shape[1], axis=0))

    return run


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in one order whatever the block."""
    return (a.astype(np.float64) * b).sum(axis=1)


_BEST = pa.schema([("place", pa.int64()), ("other", pa.int64()), ("score", pa.float64())])


def _best(k: int, dim: int):
    def run(rows: pa.Table) -> pa.Table:
        asks = rows.column("asks").combine_chunks().to_numpy(zero_copy_only=False)
        v, place = matrix(rows.column("vector"), dim), rows.column("place").to_numpy()
        x, y, qs, ds = v[asks], v[~asks], place[asks], place[~asks]
        if not len(x) or not len(y):
            return _BEST.empty_table()
        found = []
        for at in range(0, len(x), 512):
            s = x[at : at + 512] @ y.T
            n = min(k, s.shape[1])
            # rows a rounding error below the last place stay in, for exact ties
            least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n] - 1e-9
            i, j = np.nonzero(s >= least[:, None])
            found.append((qs[at + i], ds[j], scores(x[at + i], y[j])))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], schema=_BEST)

    return run


def neighbours(spark: SparkSession, vectors: DataFrame, is_query: F.Column, k: int = 20, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest inner product
    found for each query row, other than itself; ties to the smaller id.

    Null, zero or non-finite vectors, and rows without an id, take no part.
    Vectors of another length than the first are compared with zeros appended.
    """
    scratch = Scratch(prepare(spark))
    v = F.col("embedding").cast("array<double>")
    good = vectors.select(F.col("vec_id").cast("long"), v.alias("vector"), is_query.alias("asks")).where(
        F.col("vec_id").isNotNull()
        & F.col("vector").isNotNull()
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
        & F.exists("vector", lambda x: x != 0)
    )
    good = good.withColumns({"vh": F.xxhash64("vector"), "top": F.array_max(F.transform("vector", lambda x: F.abs(x)))})
    good = scratch.keep(good, "vectors")
    dim = good.agg(F.max(F.size("vector"))).first()[0]
    result = "query_id long, rank int, vec_id long, score double"
    if dim is None:
        return spark.createDataFrame([], result)
    pad = F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("vector"))
    # one place for equal vectors; the k + 1 least ids of each can reach a result
    order = Window.partitionBy("vh", "vector").orderBy("vec_id")
    ids = scratch.keep(good.select("vh", "vector", "vec_id", F.row_number().over(order).alias("n")).where(F.col("n") <= k + 1), "ids")
    unique = good.groupBy("vh", "vector").agg(F.max("asks").alias("asks"), F.min("vec_id").alias("place"), F.first("top").alias("top"))
    unique = scratch.keep(unique, "unique")
    ids = scratch.keep(ids.join(unique, ["vh", "vector"]).select("place", "vec_id"), "ids")
    asked = good.where("asks").select(F.col("vec_id").alias("query_id"), "vh", "vector").join(unique, ["vh", "vector"]).select("query_id", "place")
    rows = unique.select("place", F.coalesce("asks", F.lit(False)).alias("asks"), F.concat("vector", pad).alias("vector"), "top")
    # the largest component first: squares of very large or small ones leave the range of numbers
    length = F.log2("top") + F.log2(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / F.col("top")) * (x / F.col("top")))) / 2
    rows = rows.withColumn("length", length).withColumn("band", F.floor(F.col("length") + 0.5).cast("long")).drop("top")
    bands = sorted((r["band"], r["longest"]) for r in rows.groupBy("band").agg(F.max("length").alias("longest")).collect())  # powers of two: some two thousand at most
    rows = rows.drop("length")
    hashed = rows.mapInArrow(_hashed(dim, bands, tables, probes, seed), "bucket long, asks boolean, place long, vector array<double>")
    hashed = scratch.keep(hashed, "hashed")
    # a large bucket is split into blocks of vectors and parts of queries; each part meets each block
    size = hashed.groupBy("bucket").agg(F.count_if(~F.col("asks")).alias("held"), F.count_if("asks").alias("asked")).where("held > 0 AND asked > 0")
    cuts = size.select("bucket", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asked") / ASKS).cast("int").alias("parts"))
    dealt = hashed.join(F.broadcast(cuts), "bucket")  # at most tables * 2 * padded dimension rows a band
    one = lambda n: F.array(F.pmod(F.xxhash64("place"), n).cast("int"))
    each = lambda n: F.sequence(F.lit(0), n - 1)
    dealt = dealt.withColumn("block", F.explode(F.when(F.col("asks"), each(F.col("blocks"))).otherwise(one(F.col("blocks")))))
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("asks"), one(F.col("parts"))).otherwise(each(F.col("parts"))))).drop("blocks", "parts")
    best = dealt.groupBy("bucket", "block", "part").applyInArrow(_best(k + 1, dim), "place long, other long, score double").distinct()
    best = scratch.keep(best, "best")
    # queries that have met too few: as many as asked for, or all there are, and themselves
    n = unique.count()
    short = rows.where("asks").join(best.groupBy("place").agg(F.count("*").alias("met")), "place", "left").where(F.coalesce("met", F.lit(0)) < min(k + 1, n)).drop("met", "band")
    short = scratch.keep(short, "short")
    asking = short.count()
    if asking:
        parts, groups = -(-n // BLOCK), -(-asking // BLOCK)
        part = lambda m: F.pmod(F.xxhash64("place"), F.lit(m)).cast("long")
        every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
        q = short.select(every(parts).alias("bucket"), part(groups).alias("block"), "place", "vector", F.lit(True).alias("asks"))
        d = rows.select(part(parts).alias("bucket"), every(groups).alias("block"), "place", "vector", F.lit(False).alias("asks"))
        whole = q.unionByName(d).groupBy("bucket", "block").applyInArrow(_best(k + 1, dim), "place long, other long, score double")
        best = best.join(short.select("place"), "place", "left_anti").union(whole)
    top = Window.partitionBy("place").orderBy(F.desc("score"), "other")
    near = best.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1).select("place", "other", "score")
    near = near.join(ids.select(F.col("place").alias("other"), "vec_id"), "other")
    wide = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("n", F.row_number().over(wide)).where(F.col("n") <= k + 1).groupBy("place").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    own = asked.join(near, "place").select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")
