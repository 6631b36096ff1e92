"""Exact repeated byte strings by column-wise suffix construction.

A string of ``length`` bytes holds ``length - K + 1`` K-grams; the least of
their hashes (the leftmost on ties) is its anchor. Strings that are equal have
equal anchors at equal places, so runs of neighbouring strings with one anchor
("stretches") can be dealt out by the anchor's hash and compared there. Anchors
are counted first: a stretch whose anchor stands nowhere else repeats nothing
and never moves.

Only stretches that share an anchor and differ travel as bytes. A task lines
them up at the anchor, writes them column by column to a sequential file, and
goes through it from the last column to the first: each round inserts one
symbol a stretch before the suffixes sorted so far. The symbols in the order of
those suffixes are the Burrows-Wheeler transform of the round; a stable sort of
them is the next order, and range minima of the common prefixes between
neighbours, plus one, are the next common prefixes. Since equal strings stand
in equal columns, suffixes of different columns need no order between them,
and one column of order and prefixes is all that is held. Equal stretches are
counted before any of this.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, prepare, renamed
from .words import forget

K = 32
#: Stretches that one round sorts at a time, and beyond which an anchor's
#: stretches are compared window by window instead (an exact, spread-out way).
BATCH_STRETCHES = 8192
ANCHOR_MOST = 20_000
_STEP = 1 << 16
_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def _kgrams(raw: np.ndarray) -> np.ndarray:
    """Hashes of all K-grams, by doubling."""
    h, n = _BYTE[raw], 1
    for odd in _ODD:
        if n == K:
            break
        h = h[:-n] * odd + h[n:]
        n *= 2
    h ^= h >> np.uint64(29)
    h *= _ODD[6]
    h ^= h >> np.uint64(32)
    return h


def stretches(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of starts, anchor position and anchor hash of each
    run of ``length``-byte strings that share an anchor."""
    n = len(raw) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    width = length - K + 1
    low = np.uint64((1 << 20) - 1)
    first, anchor, key = [], [], []
    for at in range(0, n, _STEP):
        m = min(_STEP, n - at)
        h = _kgrams(raw[at : at + m + length - 1])
        v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            v = np.minimum(v[:-span], v[span:])
            span *= 2
        if width > span:
            v = np.minimum(v[: len(v) - (width - span)], v[width - span :])
        pos = (v[:m] & low).astype(np.int64)
        new = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
        first.append(new + at)
        anchor.append(pos[new] + at)
        key.append(h[pos[new]])
    first, anchor, key = map(np.concatenate, (first, anchor, key))
    new = np.r_[True, anchor[1:] != anchor[:-1]]  # a run goes on over the step's edge
    first, anchor, key = first[new], anchor[new], key[new]
    return first, np.diff(np.r_[first, n]), anchor, key


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            keys = [stretches(np.frombuffer(x.as_py() or b"", np.uint8), length)[3] for x in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64))], ["anchor"])

    return run


_STRETCH = "doc_id long, text_hash long, anchor long, c1 long, c2 long, start int, starts int, lead int"


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            rows = []
            for i, text in enumerate(batch.column("text").cast(pa.large_binary())):
                raw = text.as_py() or b""
                first, count, anchor, key = stretches(np.frombuffer(raw, np.uint8), length)
                if not len(first):
                    continue
                digest = xxhash.xxh3_128_digest
                hashes = b"".join([digest(raw[s : s + c + length - 1]) for s, c in zip(first.tolist(), count.tolist())])
                rows.append(np.full(len(first), i))
                pair = np.frombuffer(hashes, "<i8").reshape(-1, 2)
                for c, x in zip(cols, (key.view(np.int64), pair[:, 0], pair[:, 1], first.astype(np.int32), count.astype(np.int32), (anchor - first).astype(np.int32))):
                    c.append(x)
            if not rows:
                continue
            take = pa.array(np.concatenate(rows))
            arrays = [batch.column("doc_id").take(take), batch.column("text_hash").take(take), *(pa.array(np.concatenate(c)) for c in cols)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "anchor", "c1", "c2", "start", "starts", "lead"])

    return run


_SLICE = "anchor long, c1 long, c2 long, starts int, lead int, alone boolean, bytes binary"


def _slices(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.large_binary())
            wanted = batch.column("wanted")
            out = []
            for i in range(batch.num_rows):
                raw = text[i].as_py()
                out += [(w["anchor"], w["c1"], w["c2"], w["starts"], w["lead"], w["alone"], raw[w["start"] : w["start"] + w["starts"] + length - 1]) for w in wanted[i].as_py()]
            names = [x.split()[0] for x in _SLICE.split(", ")]
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out) if out else [[]] * len(names))), schema=pa.schema(list(zip(names, [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.bool_(), pa.binary()]))))

    return run


def repeated(group: np.ndarray, lead: np.ndarray, parts: list[bytes], length: int) -> np.ndarray:
    """For each stretch and start (counted from the anchor backwards: column
    ``left - lead + start``), whether its string also starts in another
    stretch of the group. ``group`` ascends."""
    n = len(parts)
    left = int(lead.max())
    size = np.fromiter(map(len, parts), np.int64, n)
    width = left + int((size - lead).max())
    # +1: 0 is no symbol
    table = np.zeros((n, width), np.uint16)
    for i, (x, p) in enumerate(zip(parts, (left - lead).tolist())):
        table[i, p : p + len(x)] = np.frombuffer(x, np.uint8).astype(np.uint16) + 1
    flags = np.zeros((n, left + 1), bool)
    with tempfile.TemporaryFile() as columns:  # column by column, last one first
        columns.write(np.ascontiguousarray(table.T[::-1]).tobytes())
        del table
        columns.seek(0)
        order, common = np.arange(n), np.zeros(n + 1, np.int32)
        groups = group.astype(np.int64) << 10
        for c in range(width - 1, -1, -1):
            symbol = np.frombuffer(columns.read(2 * n), np.uint16)
            bwt = groups[order] + symbol[order]
            place = np.argsort(bwt, kind="stable")
            key = bwt[place]
            least = np.minimum.reduceat(common, place + 1)
            same = (key[1:] == key[:-1]) & ((key[1:] & 1023) > 0)
            fresh = np.zeros(n + 1, np.int32)
            fresh[1:n][same] = 1 + least[:-1][same]
            order, common = order[place], fresh
            if c <= left:
                long = np.maximum(common[:-1], common[1:]) >= length
                flags[order[long], c] = True
    return flags


def _runs(flags: np.ndarray) -> list[int]:
    """first, last, first, last ... of the true runs."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1).ravel().tolist()


_FOUND = "anchor long, c1 long, c2 long, runs array<int>"


def _columnwise(length: int):
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        key, c1, c2, starts, lead, alone, parts = zip(*rows)
        group = np.cumsum(np.r_[0, np.diff(np.array(key, np.int64)) != 0])
        lead = np.array(lead, np.int64)
        flags = repeated(group, lead, list(parts), length)
        out = [], [], [], []
        for i in np.flatnonzero(flags.any(axis=1) & np.array(alone)).tolist():
            at = int(lead.max() - lead[i])
            for o, x in zip(out, (key[i], c1[i], c2[i], _runs(flags[i, at : at + starts[i]]))):
                o.append(x)
        return pa.RecordBatch.from_pydict(dict(zip(("anchor", "c1", "c2", "runs"), out)), schema=pa.schema([("anchor", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("runs", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if rows and row[:3] == rows[-1][:3]:
                    continue
                if len(rows) >= BATCH_STRETCHES and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield solve(rows)

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for anchor, c1, c2, starts, _, alone, raw in zip(*(batch.column(i).to_pylist() for i in range(7))):
                for o in range(starts):
                    h = xxhash.xxh3_128_digest(raw[o : o + length])
                    out.append((anchor, c1, c2, o, alone, *np.frombuffer(h, "<i8").tolist()))
            names = ["anchor", "c1", "c2", "at", "alone", "w1", "w2"]
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out) if out else [[]] * 7)), schema=pa.schema(list(zip(names, [pa.int64()] * 3 + [pa.int32(), pa.bool_()] + [pa.int64()] * 2))))

    return run


_KEY = ["anchor", "c1", "c2"]


def repeats(spark: SparkSession, docs: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """doc_id, text_hash, runs: array of (start, runs): starts of ``length``-byte
    strings that occur more than once. One row a distinct (doc_id, text)."""
    shared = docs.select("text").mapInArrow(_anchors(length), "anchor long").groupBy("anchor").count().where("count > 1").select("anchor")
    shared = scratch.keep(shared, "shared")
    all_ = scratch.keep(docs.mapInArrow(_cut(length), _STRETCH).join(shared, "anchor"), "stretches")
    each = all_.groupBy(*_KEY).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "start", "starts", "lead")).alias("one"))
    each = scratch.keep(each, "distinct")
    mixed = scratch.keep(each.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed")
    whole = each.where("n > 1").select(*_KEY, F.array(F.lit(0), F.col("one.starts") - 1).alias("runs"))
    wanted = (
        each.join(mixed, "anchor")
        .select("one.doc_id", "one.text_hash", F.struct(*_KEY, "one.start", "one.starts", "one.lead", (F.col("n") == 1).alias("alone")).alias("w"))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list("w").alias("wanted"))
    )
    texts = docs.alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash")))
    slices = texts.select("d.text", "w.wanted").mapInArrow(_slices(length), _SLICE)  # repeated rows give a slice again
    slices = scratch.keep(slices, "slices")
    many = mixed.where(F.col("kinds") > ANCHOR_MOST)
    found = whole
    if many.limit(1).count():
        lots = slices.join(many.select("anchor"), "anchor", "left_semi").dropDuplicates(_KEY).mapInArrow(_windows(length), "anchor long, c1 long, c2 long, at int, alone boolean, w1 long, w2 long")
        lots = scratch.keep(lots, "windows")
        twice = scratch.keep(lots.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2"), "twice")
        found = found.union(lots.where("alone").join(twice, ["w1", "w2"]).groupBy(*_KEY).agg(F.flatten(F.sort_array(F.collect_list(F.array("at", "at")))).alias("runs")))
        slices = slices.join(many.select("anchor"), "anchor", "left_anti")
    by_anchor = slices.repartition("anchor").sortWithinPartitions(*_KEY)
    found = scratch.keep(found.union(by_anchor.mapInArrow(_columnwise(length), _FOUND)), "found")
    return (
        all_.join(found, _KEY)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list(F.struct("start", "runs")).alias("repeats"))
    )


def spans(repeats: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal covered intervals [from, to)."""
    if not repeats:
        return []
    found = sorted((r["start"] + r["runs"][i], r["start"] + r["runs"][i + 1] + length) for r in repeats for i in range(0, len(r["runs"]), 2))
    out = [list(found[0])]
    for a, b in found[1:]:
        if a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def kept_bytes(raw: bytes, cut: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in cut:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _digest(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, number, sha, kept = [], [], [], [], []
            for text, marks in zip(batch.column("text").cast(pa.large_binary()), batch.column("repeats")):
                raw = text.as_py() or b""
                cut = spans(marks.as_py(), length)
                n.append(len(raw))
                gone.append(sum(b - a for a, b in cut))
                number.append(len(cut))
                rest = kept_bytes(raw, cut)
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode(errors="replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(number, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"],
            )

    return run


def clean_edges(raw: bytes, cut: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans drawn in to whole UTF-8 characters."""
    out = []
    for a, b in cut:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _marked(spark: SparkSession, docs: DataFrame, length: int) -> DataFrame:
    """All columns of ``docs`` under d, and the repeats of each row."""
    if length < 2 * K:
        raise ValueError(f"strings have {2 * K} bytes at least")
    scratch = Scratch(prepare(spark))
    narrow = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    marks = repeats(spark, narrow, length, scratch)
    on = F.col("d.doc_id").cast("long").eqNullSafe(F.col("m.doc_id")) & (F.xxhash64("d.text") == F.col("m.text_hash"))
    return docs.alias("d").join(marks.alias("m"), on, "left")


def repeat_digest(spark: SparkSession, docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept text of each
    row (a character cut in two shows as a replacement sign there; the checksum
    is of the bytes).

    Repeated rows are documents of their own: each repeats the other. Null
    texts are empty; texts under ``length`` bytes stay whole.
    """
    rows = _marked(spark, docs, length).select(F.col("d.doc_id").cast("long").alias("doc_id"), F.col("d.text").cast("string").alias("text"), F.col("m.repeats").alias("repeats"))
    return rows.mapInArrow(_digest(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def _without(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, last = [], batch.num_columns - 1  # the repeats come last, whatever the other columns are called
            at = batch.schema.get_field_index("text")
            for text, marks in zip(batch.column(at).cast(pa.large_binary()), batch.column(last)):
                raw = text.as_py()
                cut = raw and spans(marks.as_py(), length)
                out.append(kept_bytes(raw, clean_edges(raw, cut)).decode() if cut else None if raw is None else raw.decode())
            table = batch.set_column(at, "text", pa.array(out, pa.string()))
            yield pa.RecordBatch.from_arrays(table.columns[:last], table.schema.names[:last])

    return run


def without_repeats(spark: SparkSession, docs: DataFrame, length: int) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text`` (spans are drawn in to
    whole characters). Every row and column stays, whatever it is called; null
    and short texts are unchanged, and an empty table stays empty. Repeated
    rows repeat each other and lose their texts."""
    plain = renamed(docs.withColumn("text", F.col("text").cast("string")))
    rows = _marked(spark, plain, length).select(*(F.col(f"d.{c}") for c in plain.columns), F.col("m.repeats").alias("_repeats"))
    return rows.mapInArrow(_without(length), plain.schema).toDF(*docs.columns)
