r"""Alignment of two tokenizers' ids.

A byte-level BPE (A) and a sentencepiece model (B) cut the same bytes; places
where tokens of both end cut them into groups, and each A token is linked with
each B token of its group. An id pair's count is the number of documents of the
corpus that hold it linked.

1. A first pass aligns the documents; each task hands on its distinct pairs and
   in how many of its documents each is linked.
2. The distinct pairs of the corpus are dealt by hash into shards of some
   ``SHARD`` keys; each gets a minimal perfect hash (bits that only one key
   claims, level after level: Limasset et al., SEA 2017) and its keys in that
   order, so that a foreign pair is told.
3. Tasks' counts are added into dense vectors indexed by that hash: first those
   of ``FAN`` tasks a shard, then ``FAN`` vectors a sum, until one is left.
4. A second pass aligns the documents again and looks their pairs up. It takes
   the shards of at most ``KEYS`` keys at a time, so what a task holds does not
   grow with the corpus; each group of shards adds to the documents' sums.

Neither tokenizer merges across a single space between two other characters
(asserted for the vocabulary of B; the pattern of A), so both are applied to
chunks that begin with such a space. Each task remembers its chunks.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, prepare
from .words import forget

#: Keys of a shard, about; vectors added at a time; keys that a task holds in the second pass.
SHARD, FAN, KEYS = 1 << 14, 32, 4_000_000
#: Chunks that a task remembers; further ones are kept for the texts at hand only.
REMEMBERED = 250_000
#: Bytes aligned in one call of the tokenizers, characters of text at a time, pairs counted before they are merged.
_CALL, _AT_ONCE, _MERGE = 1 << 15, 1 << 20, 1 << 21
#: Links of a group from which on its equal ids are put together first.
_WIDE = 4096
_SPACE = re.compile(r"(?<=\S) (?=\S)")
_FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


# -- the two tokenizers --------------------------------------------------------


class Tokenizers:
    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        letter = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in set(plain))}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(letter[c] for c in x) if all(c in letter for c in x) else x.encode() for x in names]
        n = self.b.get_piece_size()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(n)))]
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.n_b = n
        #: whether a piece may stand across the space before a word
        self.parted = not any(b" " in x[1:] and x.strip(b" ") for x in self.bytes_b)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of space + text; none if their bytes are not that."""
        raw = (" " + text).encode()
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text, num_threads=1)
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


def chunks_of(text: str) -> list[str]:
    """Without the space that each begins with."""
    return _SPACE.split(text)


class Aligned:
    """Tokens, groups and links of some chunks, as arrays by chunk."""

    def __init__(self, tok: Tokenizers, chunks: list[str]):
        """All are encoded together, as they would be in a text, unless white
        space begins or ends one or some cannot be written in both."""
        self.ok = np.ones(len(chunks), bool)
        both = tok.encode(" ".join(chunks)) if all(c and not (c[0].isspace() or c[-1].isspace()) for c in chunks) else None
        if both is None:
            single = [tok.encode(c) for c in chunks]
            self.ok = np.array([x is not None for x in single], bool)
            empty = np.empty(0, np.int64)
            both = tuple(np.concatenate([empty, *(x[i] for x in single if x is not None)]) for i in (0, 1))
        sizes = np.array([len(c.encode()) + 1 for c, ok in zip(chunks, self.ok.tolist()) if ok], np.int64)
        self.a, self.b = both
        end_a, end_b = np.cumsum(tok.size_a[self.a]), np.cumsum(tok.size_b[self.b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        # chunks end where both have a token's end
        ends = np.zeros(len(chunks), np.int64)
        ends[self.ok] = np.searchsorted(cuts, np.cumsum(sizes)) + 1
        self.ends = np.maximum.accumulate(ends) if len(ends) else ends
        self.in_a, self.in_b = in_a, in_b
        self._link(tok.n_b, group_a, in_a, in_b)

    def _link(self, n_b: int, group_a: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> None:
        """Pairs, how often each is linked, and where those of a group begin."""
        first_a, first_b = np.r_[0, np.cumsum(in_a)], np.r_[0, np.cumsum(in_b)]
        wide = np.flatnonzero(in_a * in_b > _WIDE)
        each = in_b[group_a]
        if len(wide):
            each = np.where(np.isin(group_a, wide), 0, each)
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        group = np.repeat(group_a, each)
        pair = np.repeat(self.a, each) * n_b + self.b[first_b[group] + at]
        times = np.ones(len(pair), np.int64)
        for g in wide.tolist():
            ids_a, n_a = np.unique(self.a[first_a[g] : first_a[g + 1]], return_counts=True)
            ids_b, n_of_b = np.unique(self.b[first_b[g] : first_b[g + 1]], return_counts=True)
            pair = np.r_[pair, (ids_a[:, None] * n_b + ids_b).ravel()]
            times = np.r_[times, (n_a[:, None] * n_of_b).ravel()]
            group = np.r_[group, np.full(len(ids_a) * len(ids_b), g)]
        if len(wide):
            order = np.argsort(group, kind="stable")
            pair, times, group = pair[order], times[order], group[order]
        self.pair, self.times = pair, times
        self.link_ends = np.searchsorted(group, np.arange(len(in_a)), side="right")

    def by_chunk(self, per_group: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(per_group)]
        return np.diff(total[np.r_[0, self.ends]])

    def links(self) -> np.ndarray:
        """Where each chunk's links end."""
        return np.r_[0, self.link_ends][self.ends]

    def digests(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each chunk."""
        a, b = (list(map(b"%d".__mod__, x.tolist())) for x in (self.a, self.b))
        groups, i, j = [], 0, 0
        for n, m in zip(self.in_a.tolist(), self.in_b.tolist()):
            groups.append((a[i] if n == 1 else b",".join(a[i : i + n])) + b"|" + (b[j] if m == 1 else b",".join(b[j : j + m])))
            i, j = i + n, j + m
        ends = self.ends.tolist()
        return [b";".join(groups[s:e]) for s, e in zip([0, *ends[:-1]], ends)]


class Memory:
    """What a task knows of chunks: rows of figures, and their distinct pairs or their written groups."""

    def __init__(self, tok: Tokenizers, counts: Counts | None):
        self.tok, self.counts = tok, counts
        self.place: dict[str, int] = {}
        self.figures = np.zeros((1024, len(_FIGURES)), np.int64)
        self.ok = np.zeros(1024, bool)
        self.written: list[bytes] = []
        self.pairs: list[np.ndarray] = []

    def learn(self, chunks: list[str]) -> None:
        at, n = 0, len(self.place)
        while len(self.figures) < n + len(chunks):
            self.figures, self.ok = (np.concatenate([x, np.zeros_like(x)]) for x in (self.figures, self.ok))
        while at < len(chunks):
            size, end = 0, at
            while end < len(chunks) and (size < _CALL or end == at):
                size, end = size + len(chunks[end]) + 1, end + 1
            x = Aligned(self.tok, chunks[at:end])
            rows, links = slice(n + at, n + end), np.r_[0, x.links()]
            self.ok[rows] = x.ok
            if self.counts is None:
                pairs, ends = x.pair, links.tolist()
                self.pairs += [pairs[s:e] for s, e in zip(ends[:-1], ends[1:])]
            else:
                total = lambda v: np.diff(np.r_[0, np.cumsum(v)][links])
                count, best = self.counts.of(x.pair, self.tok.n_b)
                self.figures[rows] = np.stack([x.by_chunk(x.in_a), x.by_chunk(x.in_b), np.diff(np.r_[0, x.ends]), total(x.times), total(x.times * best), total(x.times * count)], axis=1)
                self.written += x.digests()
            at = end
        self.place.update(zip(chunks, range(n, n + len(chunks))))

    def texts(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Places of each text's chunks; none if the text has no tokens."""
        split = chunks_of if self.tok.parted else lambda t: [t]
        at = 0
        while at < len(texts):
            group, size, before = [], 0, len(self.place)
            while at < len(texts) and (size < _AT_ONCE or not group):
                group.append(split(texts[at]) if texts[at] else [])
                size, at = size + len(texts[at] or ""), at + 1
            new = list(dict.fromkeys(c for chunks in group for c in chunks if c not in self.place))
            new.sort(key=lambda c: not c or c[0].isspace() or c[-1].isspace())  # those that are encoded one by one come last
            self.learn(new)
            get = self.place.__getitem__
            for chunks in group:
                places = np.fromiter(map(get, chunks), np.int64, len(chunks))
                yield places if self.ok[places].all() else places[:0]
            keep = max(before, REMEMBERED)
            if len(self.place) > keep:  # the last come go first
                for c in list(islice(reversed(self.place), len(self.place) - keep)):
                    del self.place[c]
                del self.written[keep:], self.pairs[keep:]


_tokenizers: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """One a worker process, kept between tasks."""
    if (path_a, path_b) not in _tokenizers:
        forget()
        _tokenizers[path_a, path_b] = Tokenizers(path_a, path_b)
    return _tokenizers[path_a, path_b]


# -- minimal perfect hashing -----------------------------------------------------

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def xxh64(keys: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each key's eight bytes, as Spark's ``xxhash64`` of a long (seed 42)."""
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        k = turn(keys.astype(np.uint64) * _P2, 31) * _P1
        h = turn((np.uint64(seed) + _P5 + np.uint64(8)) ^ k, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return xxh64(keys, 42).astype(np.int64) % shards  # of the divisor's sign, like Spark's pmod


class PerfectHash:
    """Of some shards: a key's place among the keys of its shard. Foreign keys get -1."""

    def __init__(self, shards: int, rows: list[tuple[int, bytes, bytes, bytes]]):
        """``rows``: shard, sizes of its levels in bits, bits, keys by place."""
        self.shards = shards
        self.depth = max((len(s) // 8 for _, s, _, _ in rows), default=0)
        self.size = np.zeros((self.depth, shards), np.int64)
        self.start = np.zeros((self.depth, shards), np.int64)
        self.first = np.zeros(shards, np.int64)  # of its keys
        bits, keys, n_bits, n_keys = [], [], 0, 0
        for shard, sizes, packed, own in rows:
            size = np.frombuffer(sizes, "<i8")
            self.size[: len(size), shard] = size
            self.start[: len(size), shard] = n_bits + np.cumsum(size) - size
            self.first[shard] = n_keys
            bits.append(np.unpackbits(np.frombuffer(packed, np.uint8), count=int(size.sum())))
            keys.append(np.frombuffer(own, "<i8"))
            n_bits, n_keys = n_bits + int(size.sum()), n_keys + len(keys[-1])
        self.bits = np.concatenate([*bits, np.zeros(1, np.uint8)]).astype(bool)
        self.keys = np.concatenate([np.empty(0, np.int64), *keys])
        self.rank = np.r_[0, np.cumsum(self.bits)]  # bits set before each

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place among all keys held here."""
        out = np.full(len(keys), -1)
        shard, open_ = shard_of(keys, self.shards), np.arange(len(keys))
        for level in range(self.depth):
            size = self.size[level, shard[open_]]
            open_, size = open_[size > 0], size[size > 0]
            at = self.start[level, shard[open_]] + (xxh64(keys[open_], 100 + level) % size.astype(np.uint64)).astype(np.int64)
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
        if len(self.keys):  # shards follow one another in bits and in keys alike
            out[(out >= 0) & (self.keys[out] != keys)] = -1
        return out


def built(keys: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sizes of levels, bits, and keys by place of different keys."""
    sizes, bits, order, left = [], [], [], keys
    while len(left):
        size = 2 * len(left) + 1
        at = (xxh64(left, 100 + len(sizes)) % np.uint64(size)).astype(np.int64)
        own = np.bincount(at, minlength=size)[at] == 1
        mine = left[own][np.argsort(at[own])]
        level = np.zeros(size, bool)
        level[at[own]] = True
        sizes.append(size)
        bits.append(level)
        order.append(mine)
        left = left[~own]
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    return np.array(sizes, "<i8").tobytes(), np.packbits(flat).tobytes(), np.concatenate([np.empty(0, np.int64), *order]).astype("<i8").tobytes()


class Counts:
    """Counts of the pairs of some shards, and of each A id its highest."""

    def __init__(self, hashed: PerfectHash, counts: np.ndarray, highest: np.ndarray):
        self.hashed, self.counts, self.highest = hashed, counts, highest

    def of(self, pairs: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray]:
        """Each pair's count (0 in another group of shards) and whether it is its A id's highest."""
        if not len(pairs) or not len(self.counts):
            return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        some, back = np.unique(pairs, return_inverse=True)
        place = self.hashed.places(some)
        count = np.where(place >= 0, self.counts[place], 0)
        best = (place >= 0) & (count == self.highest[some // n_b])
        return count[back], best[back]


# -- Spark ----------------------------------------------------------------------


def _merged(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate(pairs), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _linked(path_a: str, path_b: str):
    """Of a task, its distinct pairs and how many of its documents link each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, part = Memory(tokenizers(path_a, path_b), None), TaskContext.get().partitionId()
        pairs: list[np.ndarray] = []
        kept: tuple[list, list] = ([], [])
        waiting = 0

        def merge() -> None:
            nonlocal waiting
            if pairs:
                keys, n = np.unique(np.concatenate(pairs), return_counts=True)
                keys, n = _merged([*kept[0], keys], [*kept[1], n])
                kept[0][:], kept[1][:] = [keys], [n]
                pairs.clear()
                waiting = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for keys, n in zip(*kept):
                for at in range(0, len(keys), 1 << 16):
                    k = keys[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), part, np.int32)), pa.array(k), pa.array(n[at : at + (1 << 16)].astype(np.int64))], ["part", "pair", "n"])
            kept[0].clear()
            kept[1].clear()

        for batch in batches:
            for places in memory.texts(batch.column("text").to_pylist()):
                if len(places):
                    some = np.unique(np.concatenate([memory.pairs[i] for i in set(places.tolist())]))
                    pairs.append(some)
                    waiting += len(some)
                    if waiting >= _MERGE:
                        merge()
                        if len(kept[0][0]) >= _MERGE:
                            yield from rows()
        merge()
        yield from rows()

    return run


def _sharded(rows: pa.Table) -> pa.Table:
    keys = np.sort(rows.column("pair").to_numpy())
    return pa.table({"shard": rows.column("shard").slice(0, 1), **{n: pa.array([x], pa.binary()) for n, x in zip(("sizes", "bits", "keys"), built(keys))}})


_VECTOR = "shard int, part int, counts binary"


def _dense(shards: int):
    """The counts of some tasks, in a vector indexed by the hash."""

    def run(key, hashed: pa.Table, rows: pa.Table) -> pa.Table:
        shard, part = (x.as_py() for x in key)
        first = [(shard, *(hashed.column(c)[0].as_py() for c in ("sizes", "bits", "keys")))]
        mph = PerfectHash(shards, first)
        place = mph.places(rows.column("pair").to_numpy())
        assert (place >= 0).all()
        counts = np.zeros(len(mph.keys), "<i8")
        np.add.at(counts, place, rows.column("n").to_numpy())
        return pa.table({"shard": pa.array([shard], pa.int32()), "part": pa.array([part // FAN], pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary())})

    return run


def _added(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), "<i8") for x in rows.column("counts"))
    up = pa.array([rows.column("part")[0].as_py() // FAN], pa.int32())
    return pa.table({"shard": rows.column("shard").slice(0, 1), "part": up, "counts": pa.array([total.tobytes()], pa.binary())})


def _highest(n_b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts")):
                a, n = np.frombuffer(keys.as_py(), "<i8") // n_b, np.frombuffer(counts.as_py(), "<i8")
                ids, back = np.unique(a, return_inverse=True)
                top = np.zeros(len(ids), np.int64)
                np.maximum.at(top, back, n)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(top)], ["a", "n"])

    return run


def pair_counts(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """shard, sizes, bits, keys, counts (dense, by the hash) of all linked
    pairs; the number of shards, and that of the pairs."""
    linked = scratch.keep(docs.select("text").mapInArrow(_linked(path_a, path_b), "part int, pair long, n long"), "linked")
    distinct = scratch.keep(linked.select("pair").distinct(), "pairs")
    n = distinct.count()
    shards = max(1, -(-n // SHARD))
    shard = F.pmod(F.xxhash64("pair"), F.lit(shards)).cast("int")
    hashed = distinct.withColumn("shard", shard).groupBy("shard").applyInArrow(_sharded, "shard int, sizes binary, bits binary, keys binary")
    hashed = scratch.keep(hashed, "hashed")
    # each shard's hash meets the counts of FAN tasks at a time
    parts = linked.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] // FAN + 1
    some = hashed.withColumn("up", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = linked.select(shard.alias("shard"), F.floor(F.col("part") / FAN).cast("int").alias("up"), "pair", "n")
    # a shard that none of these tasks has met gives a vector of zeros
    vectors = some.groupBy("shard", "up").cogroup(rows.groupBy("shard", "up")).applyInArrow(_dense(shards), _VECTOR)
    vectors = scratch.keep(vectors, "vectors")
    while parts > 1:
        parts = -(-parts // FAN)
        vectors = scratch.keep(vectors.groupBy("shard", "part").applyInArrow(_added, _VECTOR), "vectors")
    return scratch.keep(hashed.join(vectors.select("shard", "counts"), "shard"), "counted"), shards, n


def _looked_up(path_a: str, path_b: str, counts, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, rows, numbers, highest = counts.value
        memory = Memory(tokenizers(path_a, path_b), Counts(PerfectHash(shards, rows), np.frombuffer(numbers, "<i8"), highest))
        for batch in batches:
            figures, digests = [], []
            for places in memory.texts(batch.column("text").to_pylist()):
                figures.append(memory.figures[places].sum(axis=0))
                digests.append(hashlib.sha256(b";".join(map(memory.written.__getitem__, places.tolist()))).hexdigest() if len(places) else "")
            table = np.array(figures, np.int64).reshape(-1, len(_FIGURES))
            columns = {name: pa.array(table[:, i]) for i, name in enumerate(_FIGURES)}
            for name in ("n_best", "count_sum"):
                columns[name] = pa.array(columns[name].to_numpy() + batch.column(name).to_numpy())
            columns["groups_sha256"] = pa.array(digests, pa.string())
            if not last:
                columns = {"text": batch.column("text"), **{k: columns[k] for k in ("n_best", "count_sum")}}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **columns})

    return run


def align(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    Null and empty texts, and those that one tokenizer cannot write as they
    are, have no tokens: zeros and an empty digest. Repeated rows count as
    documents of their own; ties for an A id's highest count are all best.
    Extra columns are left out; an empty table gives an empty result.
    """
    scratch = Scratch(prepare(spark))
    tok = Tokenizers(path_a, path_b)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted, shards, n = pair_counts(spark, docs, path_a, path_b, scratch)
    highest = np.zeros(len(tok.bytes_a), np.int64)
    for r in counted.select("keys", "counts").mapInArrow(_highest(tok.n_b), "a long, n long").groupBy("a").agg(F.max("n")).collect():  # a row an id of A
        highest[r[0]] = r[1]
    groups = max(1, -(-n // KEYS))
    rows = docs.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for g in range(groups):
        own = counted.where(F.col("shard") % groups == g).select("shard", "sizes", "bits", "keys", "counts").collect()  # KEYS keys, about
        value = (shards, [tuple(map(_plain, r[:4])) for r in own], b"".join(bytes(r.counts) for r in own), highest)
        last = g == groups - 1
        schema = "doc_id long, " + ("text string, n_best long, count_sum long" if not last else ", ".join(f"{x} long" for x in _FIGURES) + ", groups_sha256 string")
        rows = rows.mapInArrow(_looked_up(path_a, path_b, spark.sparkContext.broadcast(value), last), schema)
        if not last:
            rows = scratch.keep(rows, "looked")
    return rows


def _plain(x):
    return bytes(x) if isinstance(x, bytearray) else x
