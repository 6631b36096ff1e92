"""SimHash near-dedup by meet-in-the-middle ball hashing.

A pair of fingerprints within ``radius`` bits agrees, in at least one of
``(radius + 1) / 2`` equal blocks, up to one bit (else every block would hold
two differing bits). Inside a block the two sides meet half way: a block of odd
weight emits itself and all its one-bit variants, one of even weight only
itself; at distance one the weights differ in parity, so the odd side reaches
the even one. With 3 bits of 64 that is 17 rows a block on average, where the
ball of radius two around a whole fingerprint has 2,081. Rows are shuffled on
(block, variant) and every colliding pair is verified on all bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, components, prepare
from .words import forget

#: XXH64 seed of a shingle.
SEED = 42
#: Fingerprints that share a variant: up to so many are compared in one task.
BUCKET_MOST = 4096
#: Odd multipliers from which further 64-bit words are mixed.
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, words: int = 3, width: int = 1) -> np.ndarray:
    """``width`` 64-bit words. A bit is set if it is set in over half of the
    shingle hashes, repeats included. No word at all: zero."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(width, np.uint64)
    joined = b" ".join(found)
    lens = np.fromiter(map(len, found), np.int64, len(found)) + 1
    starts = np.cumsum(lens) - lens
    k = min(words, len(found))
    ends = (starts + lens - 1)[k - 1 :].tolist()
    starts = starts[: len(ends)].tolist()
    digest = xxhash.xxh64_intdigest
    n, ones = len(ends), np.zeros((width, 64), np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])], np.uint64)
        for j in range(width):
            if j:
                h = h * _MIX + np.uint64(j)
                h ^= h >> np.uint64(31)
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[j] += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits((2 * ones > n).astype(np.uint8), axis=1, bitorder="little").view("<u8").reshape(width)


def _fingerprints(words: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            text = batch.column("text").cast(pa.large_binary())
            out = np.array([fingerprint(x.as_py(), words, width) for x in text], np.uint64).reshape(-1, width).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), *(pa.array(out[:, j]) for j in range(width))],
                ["doc_id", "text_hash", *(f"f{j}" for j in range(width))],
            )

    return run


def fingerprints(docs: DataFrame, words: int = 3, width: int = 1) -> DataFrame:
    """doc_id, text_hash, f0.. (64-bit words) of each row of ``docs``."""
    cols = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    return cols.mapInArrow(_fingerprints(words, width), "doc_id long, text_hash long, " + ", ".join(f"f{j} long" for j in range(width)))


def _ball(word: str, shift: int, bits: int, tag: int) -> F.Column:
    """Keys that one block emits: (tag, variant) as a long."""
    mask = (1 << bits) - 1
    part = F.shiftrightunsigned(F.col(word), shift).bitwiseAND(F.lit(mask))
    own = part.bitwiseOR(F.lit(tag << 40))
    flips = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: own.bitwiseXOR(F.expr("1L").cast("long") * F.pow(F.lit(2.0), i).cast("long")))
    return F.when(F.bit_count(part) % 2 == 1, F.concat(F.array(own), flips)).otherwise(F.array(own))


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1)


def _links_of(rows: np.ndarray, radius: int, all_pairs_up_to: int) -> list[tuple[int, int]]:
    """Links inside one bucket (rows: fingerprints): all pairs of a small one,
    of a larger one a forest that connects what the pairs would connect."""
    n = len(rows)
    if n <= all_pairs_up_to:
        i, j = np.triu_indices(n, 1)
        ok = _near(rows[i], rows[j]) <= radius
        return list(zip(i[ok].tolist(), j[ok].tolist()))
    left, links = np.arange(n), []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            ok = _near(rows[left], rows[at]) <= radius
            links += [(at, int(x)) for x in left[ok]]
            front += left[ok].tolist()
            left = left[~ok]
    return links


def _verified(radius: int, width: int, all_pairs_up_to: int):
    names = [f"f{j}" for j in range(width)]

    def solve(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[edge, len(key)])
        two = edge[size == 2]
        two = two[_near(fps[two], fps[two + 1]) <= radius]
        a, b = [two], [two + 1]
        for s, n in zip(edge[size > 2].tolist(), size[size > 2].tolist()):
            if got := _links_of(fps[s : s + n], radius, all_pairs_up_to):
                x = np.array(got, np.int64) + s
                a.append(x[:, 0])
                b.append(x[:, 1])
        a, b = np.concatenate(a), np.concatenate(b)
        x, y = fps[a].view(np.int64), fps[b].view(np.int64)
        cols = [x[:, j] for j in range(width)] + [y[:, j] for j in range(width)]
        out = pd.DataFrame(dict(enumerate(cols))).drop_duplicates()
        return pa.RecordBatch.from_arrays([pa.array(out[i].to_numpy()) for i in out], [*(f"a{j}" for j in range(width)), *(f"b{j}" for j in range(width))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            key = batch.column("key").to_numpy()
            fps = np.stack([batch.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
            if kept is not None:
                key, fps = np.concatenate([kept[0], key]), np.concatenate([kept[1], fps])
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            kept = key[cut:].copy(), fps[cut:].copy()
            if cut:
                yield solve(key[:cut], fps[:cut])
        if kept is not None and len(kept[0]):
            yield solve(*kept)

    return run


def _whole_ball(members: DataFrame) -> DataFrame:
    """Links among the members of very large buckets, without comparing them:
    even fingerprints emit their ball of radius one, odd ones that of radius
    two. Whoever stands within one bit of a variant is within three bits of all
    that emit it, so each variant yields a star around one of these."""
    zero = F.lit(0).cast("long")
    one = lambda i: F.shiftleft(F.lit(1).cast("long"), i)
    singles = F.array(*(one(i) for i in range(64)))
    doubles = F.flatten(
        F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.transform(F.slice(singles, i + 2, F.lit(63) - i), lambda x: x.bitwiseXOR(F.element_at(singles, i + 1))))
    )
    odd = F.bit_count("f0") % 2 == 1
    near = members.select("f0", F.explode(F.concat(F.array(zero), singles)).alias("x")).select((F.col("f0").bitwiseXOR(F.col("x"))).alias("key"), "f0", F.lit(True).alias("centre"))
    far = members.where(odd).select("f0", F.explode(doubles).alias("x")).select((F.col("f0").bitwiseXOR(F.col("x"))).alias("key"), "f0", F.lit(False).alias("centre"))
    stars = near.groupBy("key").agg(F.min("f0").alias("a0"))
    return near.union(far).join(stars, "key").where("f0 != a0").select("a0", F.col("f0").alias("b0")).distinct()


def links(spark: SparkSession, distinct_fps: DataFrame, scratch: Scratch, radius: int, width: int, block_bits: int, all_pairs_up_to: int = 2) -> DataFrame:
    """Verified links between distinct fingerprints: a0.., b0.."""
    names = [f"f{j}" for j in range(width)]
    per_word = 64 // block_bits
    blocks = [(w, b) for w in range(width) for b in range(per_word)]
    balls = F.concat(*(_ball(f"f{w}", b * block_bits, block_bits, w * per_word + b) for w, b in blocks))
    emitted = distinct_fps.select(*names, F.explode(balls).alias("key"))
    met = scratch.keep(emitted.groupBy("key").count().where("count > 1"), "met")
    rows = emitted.join(met, "key")
    fewer = rows.where(F.col("count") <= BUCKET_MOST) if width == 1 and radius == 3 else rows
    out = (
        fewer.select("key", *names)
        .repartition("key")
        .sortWithinPartitions("key", *names)
        .mapInArrow(_verified(radius, width, all_pairs_up_to), ", ".join([f"a{j} long" for j in range(width)] + [f"b{j} long" for j in range(width)]))
    )
    if width == 1 and radius == 3 and met.where(F.col("count") > BUCKET_MOST).limit(1).count():
        members = rows.where(F.col("count") > BUCKET_MOST).select("f0").distinct()
        out = out.union(_whole_ball(members))
    return out.distinct()


def simhash_groups(spark: SparkSession, docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row.

    Null or wordless texts have fingerprint zero and are linked like any
    other; repeated rows share a component; a null doc_id takes part and never
    names a component unless nothing else does (then it is null). An empty
    table gives an empty result.
    """
    if radius != 3:
        raise ValueError("the two-block balls cover a radius of three bits")
    scratch = Scratch(prepare(spark))
    each = scratch.keep(fingerprints(docs, words, 1).select("doc_id", "f0"), "fingerprints")
    names = scratch.keep(each.groupBy("f0").agg(F.min("doc_id").alias("first")), "names")
    found = scratch.keep(links(spark, names.select("f0"), scratch, radius, 1, 32), "links")
    parts = components(spark, found.select(F.col("a0").alias("a"), F.col("b0").alias("b")), scratch)
    parts = scratch.keep(parts, "parts")
    named = names.join(parts.withColumnRenamed("node", "f0"), "f0")
    least = scratch.keep(named.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    roots = scratch.keep(named.join(least, "root").select("f0", "component_id"), "roots")
    named = names.join(roots, "f0", "left").select("f0", F.coalesce("component_id", "first").alias("component_id"))
    named = scratch.keep(named, "named")
    return each.join(named, "f0").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


#: Of the corpus stage: members of a bucket whose pairs are all compared at
#: once; centres of a larger bucket in each round of stars, and rounds; texts
#: that tell which shingles are common, and how many of these are told to the
#: tasks; earlier keys that a row of a large bucket names; pairs that a task
#: compares (all of these steer the work, not the result).
BUCKET_FEW, CENTRES, ROUNDS, SAMPLE_TEXTS, COMMON_MOST, EARLIER, PAIRS_A_TASK = 32, 8, 6, 10_000, 100_000, 8, 1_000_000
_ROUND = 1e-9


def _hashes(text: bytes | None, words: int) -> np.ndarray:
    """The distinct shingles of a text, hashed and sorted."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    lens = np.fromiter(map(len, found), np.int64, len(found)) + 1
    starts = np.cumsum(lens) - lens
    ends = (starts + lens - 1)[min(words, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e]) for s, e in zip(starts.tolist(), ends)), np.uint64, len(ends)))


def shingles(text: bytes | None, words: int) -> set[int]:
    return set(_hashes(text, words).tolist())


def sketch(h: np.ndarray) -> np.int64:
    """SimHash of a set: bits set in over half of its members."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _CHUNK):
        ones += np.unpackbits(h[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view("<i8")[0]


def parity(h: np.ndarray) -> np.ndarray:
    """Map of a set: of each bit, whether an odd number of members falls on it.
    Two maps differ in no more bits than the sets differ in members. It has two
    to four bits a member, so that unlike sets of any size show: a power of two,
    and the exclusive or of its halves is the map of half the size."""
    bits = max(64, 1 << max(2 * len(h) - 1, 0).bit_length())
    odd = np.bincount(((h * _MIX) >> np.uint64(32)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefix(h: np.ndarray, common: np.ndarray, seen: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set in an order that all sets share, rare ones
    first: so many that a set as similar as ``least`` has one of them among its
    own first ones. Sets without members share the key 0."""
    if not len(h):
        return np.zeros(1, np.int64)
    n = len(h) - int(np.ceil(least * len(h) - _ROUND)) + 1
    count = np.zeros(len(h), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        count = np.where(common[at] == h, seen[at], 0)
    return h[np.lexsort((h, count))[:n]].view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = pa.array(np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def _sets(words: int, least: float, common: np.ndarray, seen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            size, f0, maps, first = [], [], [], []
            for x in batch.column("text").cast(pa.large_binary()):
                h = _hashes(x.as_py(), words)
                size.append(len(h))
                f0.append(sketch(h))
                maps.append(parity(h))
                first.append(prefix(h, common, seen, least))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("node"), pa.array(size, pa.int32()), pa.array(f0, pa.int64()), _lists(first), _lists(maps)],
                ["doc_id", "node", "size", "f0", "keys", "map"],
            )

    return run


def _all_shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [_hashes(x.as_py(), words) for x in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *h]).view(np.int64))], ["key"])

    return run


def _buckets(names: list[str], solve):
    """Runs ``solve`` on whole keys of sorted batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in names]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if kept and (cut or cols[0][0] != kept[0][0][0]):
                # the key that began before ends here
                yield from solve(*(np.concatenate(x) for x in zip(*kept, [c[:cut] for c in cols])))
                kept = []
            elif cut:
                yield from solve(*(c[:cut] for c in cols))
            kept.append([c[cut:].copy() for c in cols])
        if kept:
            yield from solve(*(np.concatenate(x) for x in zip(*kept)))

    return run


def _meeting(least: float):
    """Of each key's nodes (by size), all pairs of like size."""

    def solve(key: np.ndarray, size: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, BUCKET_FEW):
            met = np.flatnonzero(key[:-d] == key[d:])
            if not len(met):
                break
            met = met[size[met] >= least * size[met + d] - _ROUND]
            a.append(node[met])
            b.append(node[met + d])
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return _buckets(["key", "size", "node"], solve)


def _similar(words: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, set())
        for batch in batches:
            ok = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x").cast(pa.large_binary()), batch.column("y").cast(pa.large_binary())):
                if a != last[0]:
                    last = a, shingles(x.as_py(), words)
                s, t = last[1], shingles(y.as_py(), words)
                both = len(s & t)
                ok.append(both >= least * (len(s) + len(t) - both))
            yield batch.filter(pa.array(ok)).select(["a", "b"])

    return run


def _common(spark: SparkSession, texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that some texts of a sample share, sorted, and how many have them."""
    n = texts.count()
    h = (F.xxhash64("node", F.lit(5)) / F.lit(2.0**64)) + 0.5
    some = texts.where(h <= SAMPLE_TEXTS / max(n, 1)).dropDuplicates(["node"]).select("text")
    counts = some.mapInArrow(_all_shingles(words), "key long").groupBy("key").count().where("count > 1")
    rows = counts.orderBy(F.desc("count"), "key").limit(COMMON_MOST).toArrow()
    key, seen = rows.column("key").to_numpy().view(np.uint64), rows.column("count").to_numpy()
    order = np.argsort(key)
    return key[order], seen[order]


def _identity(text: F.Column) -> F.Column:
    return F.xxhash64(text)


def _told_apart(text: F.Column, clashes: list[int]) -> F.Column:
    """64 bits that differ between different texts: ``clashes`` are the
    identities that several of them share."""
    wide = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return F.when(_identity(text).isin(clashes), wide).otherwise(_identity(text)) if clashes else _identity(text)


def keep_one(spark: SparkSession, docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document (the least doc_id) of each group of near
    copies: texts that are equal, or linked by a Jaccard similarity of
    ``words``-word shingles of ``similarity`` or more.

    SimHash balls come first: texts whose fingerprints (of their sets of
    shingles) the half-radius balls of :func:`links` bring together are verified
    on their whole texts, and what is near is one component from then on. An
    exact pass follows, so no pair is left to chance: two sets so similar share
    one of their first shingles (prefix filter), and pairs that share one, and
    that the balls have not joined, are sorted out by bounds that hold for all
    (sizes, parity maps), then verified on their whole texts. Where many texts
    share a shingle, rounds of stars around a few of them come first; what these
    have joined is not compared again, and at last every text outside the
    largest component of its shingle meets all others there.
    Equal texts are one node with a 64-bit identity; where 128 bits tell texts
    of one identity apart (a few in 10^10), these take another. Wordless and
    null texts are all alike. Rows stay unchanged, with all their
    columns, whatever they are called; of whole rows that repeat one stays; an
    empty table stays empty.
    """
    scratch = Scratch(spark, tidy=True)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ids = docs.select(_identity(text).alias("node"), F.unhex(F.md5(text)).alias("wide"))
    ids = ids.groupBy("node").agg(F.min("wide").alias("a"), F.max("wide").alias("b"))
    # expected: texts squared / 2^65 of them
    clashes = [r.node for r in ids.where("a <> b").select("node").collect()]
    read = docs.select(F.col("doc_id").cast("long"), _told_apart(text, clashes).alias("node"), text.alias("text"))
    common, seen = _common(spark, read.select("node", "text"), words)
    each = read.mapInArrow(_sets(words, similarity, common, seen), "doc_id long, node long, size int, f0 long, keys array<long>, map array<long>")
    each = scratch.keep(each, "sets")
    nodes = scratch.keep(each.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("size", "f0", "keys", "map"))), "nodes")
    same = scratch.keep(each.groupBy("node", "doc_id").count().where("count > 1"), "same")
    scratch.drop(each)
    slim = nodes.select("node", "size", "map")
    keys = nodes.select(F.explode("keys").alias("key"), "size", "node")
    met = scratch.keep(keys.groupBy("key").count().where("count > 1"), "met")
    # read twice: all first shingles move once for it, those that meet nobody stay behind
    rows = scratch.keep(keys.join(met, "key"), "rows")
    few = rows.where(F.col("count") <= BUCKET_FEW).select("key", "size", "node").repartition("key").sortWithinPartitions("key", "size", "node")
    few = few.mapInArrow(_meeting(similarity), "a long, b long").distinct()
    a, b = (slim.select(*(F.col(c).alias(f"{end}{c}" if c != "node" else end) for c in slim.columns)) for end in "ab")

    def near(x: str, y: str) -> F.Column:
        """Whether the sizes and maps of two nodes allow the similarity."""
        n, m = F.col(f"{x}size"), F.col(f"{y}size")
        u, v = F.col(f"{x}map"), F.col(f"{y}map")
        both = F.least(F.size(u), F.size(v))
        half = lambda w: F.when(F.size(w) == 2 * both, F.zip_with(F.slice(w, F.lit(1), both), F.slice(w, both + 1, both), lambda i, j: i.bitwiseXOR(j))).otherwise(w)
        differ = F.aggregate(F.zip_with(half(u), half(v), lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda i, j: i + j)
        most = n + m - 2 * F.ceil(F.lit(similarity / (1 + similarity)) * (n + m) - F.lit(_ROUND))
        # maps of very unlike sizes meet below a similarity of one half only: they tell nothing
        unlike = F.greatest(F.size(u), F.size(v)) > 2 * both
        return (F.least(n, m) >= similarity * F.greatest(n, m) - F.lit(_ROUND)) & (unlike | (differ <= most))

    def possible(pairs: DataFrame, name: str) -> DataFrame:
        return scratch.keep(pairs.join(a, "a").join(b, "b").where(near("a", "b")).select("a", "b"), name)

    names = scratch.keep(nodes.groupBy("f0").agg(F.min("node").alias("first"), F.count("*").alias("n")), "names")
    found = scratch.keep(links(spark, names.select("f0"), scratch, 3, 1, 32, BUCKET_FEW), "balls")
    end = lambda i: names.select(F.col("f0").alias(f"{i}0"), F.col("first").alias(i))
    equal = nodes.select("f0", "node").join(names.where("n > 1"), "f0").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    balls = possible(found.join(end("a"), "a0").join(end("b"), "b0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(equal), "balls")
    few = possible(few, "few")
    large = scratch.keep(rows.where(F.col("count") > BUCKET_FEW).select("key", "node"), "large")
    for old in (met, rows):
        scratch.drop(old)
    pairs = few.union(balls)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("node")).distinct()
    ends = scratch.keep(ends.join(nodes.select("node", "doc_id"), "node").select("node", F.col("doc_id").alias("id")), "ends")
    # columns of docs may have any name: they are read as d's
    own_text = F.coalesce(F.col("d.text").cast("string"), F.lit(""))
    own, own_id = _told_apart(own_text, clashes), F.col("d.doc_id").cast("long")
    texts = docs.alias("d").join(ends.alias("e"), (own == F.col("e.node")) & own_id.eqNullSafe(F.col("e.id"))).select(F.col("e.node").alias("node"), own_text.alias("text")).dropDuplicates(["node"])
    texts = scratch.keep(texts, "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        # later rounds have few pairs: only their texts move
        asked = texts.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi")
        with_x = pairs.join(asked.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
        with_y = with_x.join(asked.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        return scratch.keep(with_y.mapInArrow(_similar(words, similarity), "a long, b long"), "links")

    def grown(links: DataFrame, parts: DataFrame) -> DataFrame:
        return scratch.keep(components(spark, links.union(parts.select(F.col("node").alias("a"), F.col("root").alias("b"))), scratch), "parts")

    def crossing(crowd: DataFrame, work: int) -> DataFrame:
        """Pairs of unlike roots that share a key under which one of them asks.

        Texts that are alike share many keys: a pair is made under the first of
        these, and not again where both have lately met. What they name as
        earlier are keys under which they are compared, so no pair is lost."""
        before = Window.partitionBy("node").orderBy("key").rowsBetween(-EARLIER, -1)
        crowd = crowd.withColumn("met", F.collect_list("key").over(before)).withColumn("asked", F.collect_list(F.when(F.col("asks"), F.col("key"))).over(before))
        # few rows may make many pairs: they are dealt by these
        crowd = scratch.keep(crowd.join(slim, "node").repartition(min(10_000, 1 + work // PAIRS_A_TASK), "node"), "crowd")
        mine = crowd.where("asks").select("key", *(F.col(c).alias(f"a{c}") for c in ("node", "root", "size", "map", "asked")))
        other = crowd.select("key", *(F.col(c).alias(f"b{c}") for c in ("node", "root", "size", "map", "met", "asks")))
        once = (~F.col("basks") | (F.col("anode") < F.col("bnode"))) & near("a", "b") & ~F.arrays_overlap("aasked", "bmet")
        pairs = mine.join(other, "key").where((F.col("aroot") != F.col("broot")) & once)
        return scratch.keep(pairs.select(F.least("anode", "bnode").alias("a"), F.greatest("anode", "bnode").alias("b")).distinct(), "pairs")

    def apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
        """Pairs that no component holds: the others need no look."""
        root = lambda end: parts.select(F.col("node").alias(end), F.col("root").alias(f"{end}r"))
        rest = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
        return scratch.keep(rest.where(F.coalesce("ar", "a") != F.coalesce("br", "b")).select("a", "b"), "few")

    # what the balls have brought together, then each other node's least partner, then what is still apart
    parts = grown(verified(balls), spark.createDataFrame([], "node long, root long"))
    few = apart(few, parts)
    some = few.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    parts = grown(verified(some), parts)
    few = apart(few.join(some, ["a", "b"], "left_anti"), parts)
    parts = grown(verified(few), parts)
    useful = True
    for turn in range(ROUNDS + 1):
        joined = large.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
        counts = scratch.keep(joined.groupBy("key", "root").count(), "roots")
        mixed = counts.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("big"), F.count("*").alias("kinds"), F.sum("count").alias("n"), F.max("count").alias("most")).where("kinds > 1")
        mixed = scratch.keep(mixed, "mixed")
        # texts outside the largest components, times the texts they would meet, against the work of a round
        rest, todo, members = mixed.agg(F.sum(F.col("n") - F.col("most")), F.sum((F.col("n") - F.col("most")) * F.col("n")), F.sum("n")).first()
        if not rest:
            break
        crowd = joined.join(mixed.select("key", "big"), "key")
        last = turn == ROUNDS or not useful or todo <= CENTRES * members
        if last:
            linked = verified(crossing(crowd.select("key", "node", "root", (F.col("root") != F.col("big")).alias("asks")), todo))
        else:
            first = Window.partitionBy("key").orderBy(F.xxhash64("node", F.lit(turn)), "node")
            linked = verified(crossing(crowd.select("key", "node", "root", (F.row_number().over(first) <= CENTRES).alias("asks")), CENTRES * members))
            useful = 64 * linked.count() >= members
        parts = grown(linked, parts)
        if last:
            break
    grouped = nodes.select("node", "doc_id", "n").join(parts, "node", "left").select("node", "doc_id", "n", F.coalesce("root", "node").alias("root"))
    # null ids come last: a document with an id stays before one without
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("one")
    stay = scratch.keep(grouped.groupBy("root").agg(first, F.sum("n").alias("n")).select(F.col("one.node").alias("node"), F.col("one.doc_id").alias("id")), "stay")
    for old in (nodes, texts, large):  # all texts move in the last join: the disk is theirs then
        scratch.drop(old)
    out = docs.alias("d").join(stay.alias("s"), (own == F.col("s.node")) & own_id.eqNullSafe(F.col("s.id")))
    again = same.alias("e").join(stay.alias("s"), (F.col("e.node") == F.col("s.node")) & F.col("e.doc_id").eqNullSafe(F.col("s.id")))
    if again.limit(1).count():  # whole rows repeat: one of each goes on
        columns = [F.col(f"d.`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
        out = out.select(*columns, own.alias("node"), own_id.alias("id")).dropDuplicates(["node", "id"])
        return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
    return out.select(*(F.col(f"d.`{c}`").alias(c) for c in docs.columns))
