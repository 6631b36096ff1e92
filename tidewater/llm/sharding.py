"""Shards of near-equal bytes by sampled splitters.

Records are ordered by (hash of the text, doc_id): equal texts stand together.
A size-weighted sample of these keys gives quantile boundaries of many small
ranges; ranges that turn out overfull (a very large group, or bad luck in the
sample) are subdivided by a hash of the record. Byte totals of the ranges, a
small table, place each range on the line of all bytes, and a running sum
inside a range places each record. Equal parts of the line of the larger
records are shards; the line of the smaller ones (below the mean size) is then
cut where it levels what the larger leave uneven, so shards differ by about a
small record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, prepare

#: Expected keys in the sample, and ranges cut from it.
SAMPLE_KEYS = 16_384
RANGES = 512


def _search(splitters: list, key: F.Column) -> F.Column:
    """How many of the ascending splitters are not above ``key``: binary
    search, unrolled over a literal array."""
    if not splitters:
        return F.lit(0)
    steps = len(splitters).bit_length()
    size = (1 << steps) - 1
    texts = F.array(*(F.struct(F.lit(h).cast("long").alias("h"), F.lit(d).cast("long").alias("d")) for h, d in splitters))
    at = F.lit(0)
    return F.aggregate(
        F.sequence(F.lit(steps - 1), F.lit(0), F.lit(-1)),
        at,
        lambda lo, i: F.when(
            (lo + F.pow(F.lit(2), i).cast("int") <= len(splitters)) & (F.try_element_at(texts, lo + F.pow(F.lit(2), i).cast("int")) <= key),
            lo + F.pow(F.lit(2), i).cast("int"),
        ).otherwise(lo),
    ) if size else at


def shard(spark: SparkSession, docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row.

    A null text has size 1 and the checksum of no bytes; a null doc_id comes
    first among equal texts; repeated rows get slots of their own. An empty
    table gives none.
    """
    scratch = Scratch(prepare(spark))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.col("text").isNull().alias("none"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    ).select("doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", "h", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"))
    rows = scratch.keep(rows, "rows")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    # a record is drawn with probability proportional to its size; a hash draws, so a rerun draws the same
    luck = (F.xxhash64("h", "d", F.lit("splitters")) / F.lit(2.0**64)) + 0.5
    weighed = rows.where(luck * F.lit(float(total)) < F.col("size") * F.lit(float(SAMPLE_KEYS)))
    # records larger than a sampling step count once for each step they cover
    repeats = F.greatest(F.lit(1), F.floor(F.col("size") * F.lit(float(SAMPLE_KEYS)) / F.lit(float(max(total, 1))))).cast("int")
    drawn = sorted((r.h, r.d) for r in weighed.select("h", "d", repeats.alias("n")).collect() for _ in range(r.n))  # about SAMPLE_KEYS keys
    step = max(1, len(drawn) // RANGES)
    splitters = sorted(set(drawn[step::step]))
    key = F.struct("h", "d")
    ranged = scratch.keep(rows.withColumn("range", _search(splitters, key).cast("int")), "ranged")
    full = ranged.groupBy("range").agg(F.count("*").alias("n"))
    limit = max(1, 2 * count // RANGES)
    parts = full.select("range", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(limit))).alias("parts"))
    by = ranged.join(F.broadcast(parts), "range")  # at most RANGES + 1 rows, each of two numbers
    by = by.withColumn("sub", F.pmod(F.xxhash64("d", "h", "text_crc32"), F.col("parts")))
    by = scratch.keep(by.select("doc_id", "size", "text_crc32", "h", "d", "range", "sub", (F.col("size") < F.lit(total / max(count, 1))).alias("small")), "parts")
    sums = by.groupBy("small", "range", "sub").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    line = Window.partitionBy("small").orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = sums.select("small", "range", "sub", F.coalesce(F.sum("b").over(line), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(line), F.lit(0)).alias("n0"))
    within = Window.partitionBy("small", "range", "sub").orderBy("h", "d", "size", "text_crc32")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        by.withColumn("b", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("n", F.row_number().over(within) - 1)
        .join(F.broadcast(sums), ["small", "range", "sub"])  # at most 4 * RANGES rows by the limit above
        .select("doc_id", "size", "text_crc32", "small", (F.col("b0") + F.col("b") + F.col("size") / 2).alias("middle"), (F.col("n0") + F.col("n")).alias("rank"))
    )
    placed = scratch.keep(placed, "placed")
    large = placed.where("not small").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    first = F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / F.lit(max(large, 1)))).cast("int")
    have = {r.shard: (r.b, r.n) for r in placed.where("not small").groupBy(first.alias("shard")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}  # ``shards`` rows
    bounds = _fill([have.get(s, (0, 0))[0] for s in range(shards)], total - large)
    second = sum((F.when(F.col("middle") >= F.lit(float(x)), 1).otherwise(0) for x in bounds[:-1]), F.lit(0))
    counts = F.array(*(F.lit(have.get(s, (0, 0))[1]).cast("long") for s in range(shards)))
    placed = placed.withColumn("shard", F.when(F.col("small"), second).otherwise(first).cast("int"))
    starts = placed.groupBy("small", "shard").agg(F.min("rank").alias("first"))
    slot = F.col("rank") - F.col("first") + F.when(F.col("small"), F.element_at(counts, F.col("shard") + 1)).otherwise(0)
    return placed.join(F.broadcast(starts), ["small", "shard"]).select(  # 2 * ``shards`` rows
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _fill(have: list[int], more: int) -> list[float]:
    """Upper ends, on a line of ``more`` bytes, of the parts that raise all
    shards towards one level."""
    level, left = 0.0, sorted(have)
    for k in range(1, len(left) + 1):
        level = (more + sum(left[:k])) / k
        if k == len(left) or level <= left[k]:
            break
    ends, at = [], 0.0
    for x in have:
        at += max(0.0, level - x)
        ends.append(at)
    return ends
