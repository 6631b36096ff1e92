"""Benchmark decontamination by latent semantic retrieval.

Documents are read as passages. These become TF-IDF vectors over the (hashed)
words of the benchmark; a randomised SVD of all of them, one distributed power
step from random directions and a QR of the small result, gives a latent basis.
Items and overlapping passages are compared by cosine in that basis; candidates
whose window holds enough of the item's telling words at all are checked word
by word: the longest common subsequence with these words, and, for
paraphrases, with the item's answer (its last third). Besides, an item is found wherever all its words stand in a row, by one of
its word n-grams, whatever its words tell.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, prepare

#: Hashed features, latent axes, words of a passage and its step.
FEATURES, RANK, PASSAGE, STEP, SEED = 8192, 64, 32, 16, 9
#: Words found in more than this part of the passages tell nothing, unless an
#: item would lose half of its words so.
COMMON = 0.2
#: ... or in more than this part of the items (five items at least).
COMMON_ITEMS = 0.03
COSINE, SAME, PARAPHRASE, ANSWER = 0.3, 0.75, 0.55, 0.5
#: Words of an n-gram of the verbatim search, and of the shortest item in it.
GRAM, SHORTEST = 8, 4
_BASE = 0x9E3779B97F4A7C15
#: Items of one search; more are searched in turns of so many, with the same
#: vocabulary, weights and basis.
ITEMS_MOST = 20_000
#: Look-ups of words in items at a time.
_AT_ONCE = 1 << 21
_WORD = re.compile(r"\w+")
_ASCII = {i: " " for i in range(128) if not _WORD.match(chr(i))}


def words_of(text: str | None) -> list[str]:
    low = (text or "").lower()
    return low.translate(_ASCII).split() if low.isascii() else _WORD.findall(low)


def _hash(word: str) -> int:
    return zlib.crc32(word.encode())


class Vocabulary:
    """Numbers and features of the benchmark's words; other words have none
    (-1), and those that many different items share have no feature. ``seen``
    tells in how many of the ``texts`` different items a word stands."""

    def __init__(self, seen: dict[str, int], texts: int):
        most = max(COMMON_ITEMS * texts, 5)
        self.number = {w: i for i, w in enumerate(sorted(seen))}
        self.feature = np.array([_hash(w) % FEATURES if seen[w] <= most else -1 for w in self.number] + [-1], np.int32)

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words))

    def features(self, words: list[str]) -> np.ndarray:
        return self.feature[self.numbers(words)]


def grams(numbers: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` words in a row."""
    last = len(numbers) - n + 1
    x, h = (numbers.astype(np.int64) + 2).view(np.uint64), np.zeros(max(last, 0), np.uint64)
    for j in range(n if last > 0 else 0):
        h = h * np.uint64(_BASE) + x[j : j + last]
    return h


class Verbatim:
    """Items by one n-gram each, the one that the fewest items hold."""

    def __init__(self, items: list[list[str]], vocabulary: Vocabulary):
        self.items = [vocabulary.numbers(w) for w in items]
        self.at: dict[int, dict[int, list[tuple[int, int]]]] = {}
        size = [min(len(w), GRAM) if len(w) >= SHORTEST else 0 for w in items]
        for n in sorted(set(size) - {0}):
            held = {k: grams(self.items[k], n).tolist() for k, m in enumerate(size) if m == n}
            count = Counter(h for own in held.values() for h in set(own))
            for k, own in held.items():
                off = min(range(len(own)), key=lambda i: count[own[i]])
                self.at.setdefault(n, {}).setdefault(own[off], []).append((k, off))
        self.keys = {n: np.sort(np.array(list(x), np.uint64)) for n, x in self.at.items()}

    def find(self, docs: list[np.ndarray]) -> dict[int, set[int]]:
        """Items that stand whole in each of ``docs`` (numbers of words)."""
        ends = np.cumsum([len(x) + 1 for x in docs])
        flat = np.concatenate([np.r_[x, np.int32(-1)] for x in docs])
        out: dict[int, set[int]] = {}
        for n, keys in self.keys.items():
            h = grams(flat, n)
            for at in np.flatnonzero(keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h).tolist():
                i = int(np.searchsorted(ends, at, side="right"))
                for k, off in self.at[n][int(h[at])]:
                    first, own = at - off, self.items[k]
                    if k not in out.get(i, ()) and first >= ends[i] - len(docs[i]) - 1 and np.array_equal(flat[first : first + len(own)], own):
                        out.setdefault(i, set()).add(k)
        return out


def passages(n: int) -> np.ndarray:
    """Starts of the passages of a text of n words."""
    return np.arange(0, max(1, n - PASSAGE + STEP), STEP)


def _blocks(docs: list[np.ndarray], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block and feature of each word that has one, blocks counting ``words``
    words of a text each, and the number of blocks of each text (one at least)."""
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    n = np.maximum(1, -(-size // words))
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    block = np.repeat(np.cumsum(n) - n, size) + place // words
    f = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    return block[f >= 0], f[f >= 0], n


def _groups(texts: list[str | None], vocabulary: Vocabulary) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """Features and numbers of some texts' words at a time, from the position of the first."""
    some, size, first = [], 0, 0
    for i, text in enumerate(texts):
        some.append(vocabulary.numbers(words_of(text)))
        size += len(some[-1])
        if size > 200_000:
            yield first, [vocabulary.feature[x] for x in some], some
            some, size, first = [], 0, i + 1
    if some:
        yield first, [vocabulary.feature[x] for x in some], some


def _axes(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).normal(size=(FEATURES, RANK)).astype(np.float32)


def _sums(p: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` by ascending ``p``, of ``n`` in all."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(p):
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        out[p[first]] = np.add.reduceat(rows, first, axis=0)
    return out


def _sketched(vocabulary: Vocabulary):
    """Each task's passages (side by side), passages of each feature (blocks -1
    and -2), and its part of A'A Omega in blocks of features; A holds plain
    counts, and the weights of its columns are put in afterwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega, total = _axes(SEED), np.zeros((FEATURES, RANK))
        seen, n = np.zeros(FEATURES), 0
        for batch in batches:
            for _, docs, _ in _groups(batch.column("text").to_pylist(), vocabulary):
                p, f, size = _blocks(docs, PASSAGE)
                n += int(size.sum())
                key = np.unique(p * FEATURES + f)
                seen += np.bincount(key % FEATURES, minlength=FEATURES)
                y = _sums(p, omega[f], int(size.sum()))
                order = np.argsort(f.astype(np.uint16), kind="stable")
                total += _sums(f[order], y[p[order]], FEATURES)
        parts = total.reshape(-1, 64 * RANK)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, -2, used]), pa.array([np.array([n], float).tobytes(), seen.tobytes(), *(parts[i].tobytes() for i in used)], pa.binary())], ["block", "part"]
        )

    return run


def latent_basis(sketch: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Right singular vectors of A from A'A Omega (the Nystroem form of the
    randomised SVD), each divided by the root of its singular value: directions that all
    texts share count no more than others."""
    q, r = np.linalg.qr(sketch * idf[:, None])  # the test matrix is Omega / idf
    core = _axes(SEED).astype(np.float64)[idf > 0].T @ sketch[idf > 0]
    values, turn = np.linalg.eigh(r @ np.linalg.pinv((core + core.T) / 2, rcond=1e-8, hermitian=True) @ r.T)
    good = values > values.max(initial=0) * 1e-6
    scale = np.where(good, np.where(good, values, 1) ** -0.25, 0)
    return (q @ turn * scale * max(values.max(initial=0), 1e-12) ** 0.25).astype(np.float32)


def _added(key, rows):
    total = sum(np.frombuffer(x.as_py()) for x in rows.column("part"))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([total.tobytes()], pa.binary())})


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    place: dict = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = place.get(x, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Items:
    """Benchmark items: words, telling words, answers and latent vectors."""

    def __init__(self, rows: list[tuple[int, list[str]]], vocabulary: Vocabulary, idf: np.ndarray, common: np.ndarray, basis: np.ndarray):
        self.ids = [i for i, _ in rows]
        self.size = [len(w) for _, w in rows]
        self.telling, self.answer, self.marks = [], [], []
        #: of each item a bit a telling feature, and how many such words a window has to have
        self.bits, self.need = np.zeros((len(rows), FEATURES // 8 + 1), np.uint8), np.zeros(len(rows))
        docs = [vocabulary.features(w) for _, w in rows]
        self.used = [(f >= 0) & ~common[f] for f in docs]
        self.used = [u if 2 * u.sum() >= (f >= 0).sum() else f >= 0 for u, f in zip(self.used, docs)]
        latent, of = [], []
        for k, ((_, words), f, used) in enumerate(zip(rows, docs, self.used)):
            enough = used.sum() >= 4
            own = [w for w, u in zip(words, used) if u or not enough]
            self.telling.append(own)
            self.marks.append(f[used].tolist() if enough else None)
            self.answer.append(own[-max(1, -(-len(own) // 3)) :])
            if enough:
                self.need[k] = PARAPHRASE * used.sum()
                np.bitwise_or.at(self.bits[k], f[used] >> 3, (1 << (f[used] & 7)).astype(np.uint8))
            for s in passages(len(f)).tolist():  # a long item has a vector for each of its passages
                part, count = np.unique(f[s : s + PASSAGE][f[s : s + PASSAGE] >= 0], return_counts=True)
                latent.append((basis[part] * (count * idf[part])[:, None]).sum(axis=0) if len(part) else np.zeros(RANK))
                of.append(k)
        self.of = np.array(of, np.int64)
        self.verbatim = Verbatim([w for _, w in rows], vocabulary)
        z = np.array(latent, np.float32).reshape(-1, RANK)
        self.latent = z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-9)
        self.set = [set(x) for x in self.telling]

    def window(self, k: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last word (exclusive) in which item k may stand, around a passage of a text of ``size`` words."""
        extra = np.maximum(STEP, np.array(self.size)[k] - PASSAGE)
        return np.maximum(0, start - extra), np.minimum(size, start + PASSAGE + extra)

    def held(self, k: np.ndarray, first: np.ndarray, last: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Whether so many of the words first..last (features f) are telling
        ones of item k that they can hold a paraphrase of it."""
        before = np.r_[0, np.cumsum(f >= 0)]  # only words with a feature can be telling
        first, last, f = before[first], before[last], f[f >= 0]
        byte, bit, width = (f >> 3).astype(np.int64), (1 << (f & 7)).astype(np.uint8), self.bits.shape[1]
        ok = self.need[k] <= 0
        some = np.flatnonzero(~ok & (last - first >= self.need[k]))
        ends, at = np.cumsum((last - first)[some]), 0
        while at < len(some):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _AT_ONCE, side="right")))
            c = some[at:to]
            n = last[c] - first[c]
            begin = np.cumsum(n) - n
            x = np.repeat(first[c] - begin, n) + np.arange(n.sum())
            hit = self.bits.ravel()[np.repeat(k[c] * width, n) + byte[x]] & bit[x] != 0
            ok[c] = np.add.reduceat(hit, begin, dtype=np.int32) >= self.need[k[c]]
            at = to
        return ok

    def likely(self, k: int, ids: np.ndarray) -> bool:
        """Whether a window's features, words apart, hold enough of the item in order."""
        own = self.marks[k]
        if own is None:
            return True
        mine = set(own)
        return common_subsequence(own, [x for x in ids[ids >= 0].tolist() if x in mine]) >= PARAPHRASE * len(own)

    def check(self, k: int, window: list[str]) -> tuple[float, float]:
        """Common parts of the telling words and of the answer."""
        own = self.telling[k]
        near = [w for w in window if w in self.set[k]]
        if not own or not near:
            return 0.0, 0.0
        return common_subsequence(own, near) / len(own), common_subsequence(self.answer[k], near) / len(self.answer[k])


def _passages(docs: list[np.ndarray], weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latent vectors of all passages, their texts and first words. A passage
    is two blocks of STEP words, and its vector the sum of theirs."""
    p, f, n = _blocks(docs, STEP)
    z = _sums(p, weighted[f], int(n.sum()))
    owner = np.repeat(np.arange(len(docs)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    first = np.flatnonzero((place < n[owner] - 1) | (n[owner] == 1))
    more = n[owner[first]] > 1
    out = z[first]
    out[more] += z[first[more] + 1]
    return out, owner[first], place[first] * STEP


def _searched(vocabulary: Vocabulary, idf: np.ndarray, basis: np.ndarray, items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted = (basis * idf[:, None]).astype(np.float32)
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("row").to_pylist()
            out: list[tuple] = []
            for first, docs, numbers in _groups(texts, vocabulary):
                z, owner, start = _passages(docs, weighted)
                z /= np.linalg.norm(z, axis=1, keepdims=True) + 1e-9
                size = np.fromiter(map(len, docs), np.int64, len(docs))
                flat, base = np.concatenate(docs), np.cumsum(size) - size
                whole = items.verbatim.find(numbers)
                for i, hits in whole.items():
                    near = z[np.searchsorted(owner, i) : np.searchsorted(owner, i, side="right")] @ items.latent.T
                    for k in hits:
                        out.append((ids[first + i], items.ids[k], float(near[:, items.of == k].max()), 1.0, 1.0))
                found: dict[int, dict[int, dict[tuple[int, int], float]]] = {}
                for at in range(0, len(z), 4096):
                    cosine = z[at : at + 4096] @ items.latent.T
                    i, c = np.nonzero(cosine >= COSINE)
                    if not len(i):
                        continue
                    k, doc = items.of[c], owner[at + i]
                    lo, hi = items.window(k, start[at + i], size[doc])
                    ok = np.flatnonzero(items.held(k, base[doc] + lo, base[doc] + hi, flat))
                    for d, x, a, b, value in zip(doc[ok].tolist(), k[ok].tolist(), lo[ok].tolist(), hi[ok].tolist(), cosine[i[ok], c[ok]].tolist()):
                        if x not in whole.get(d, ()):
                            places = found.setdefault(d, {}).setdefault(x, {})
                            places[a, b] = max(places.get((a, b), 0.0), value)
                for i, hits in found.items():
                    words = None
                    for k, places in hits.items():
                        best = (0.0, 0.0, 0.0)
                        for (a, b), value in places.items():
                            if not items.likely(k, docs[i][a:b]):
                                continue
                            words = words or words_of(texts[first + i])
                            same, answer = items.check(k, words[a:b])
                            if same >= SAME or (same >= PARAPHRASE and answer >= ANSWER):
                                best = max(best, (same, answer, value))
                        if best[0]:
                            out.append((ids[first + i], items.ids[k], best[2], best[0], best[1]))
            names = ["row", "item_id", "cosine", "same", "answer"]
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out) if out else [[]] * 5)), schema=pa.schema(list(zip(names, [pa.string(), pa.int64()] + [pa.float64()] * 3))))

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([words_of(x) for x in batch.column("text").to_pylist()], pa.list_(pa.string()))], ["item_id", "words"])


def _matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row, item_id, cosine, same, answer for ``docs`` (row, text)."""
    scratch = Scratch(prepare(spark))
    result = "row string, item_id long, cosine double, same double, answer double"
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    items = scratch.keep(items.mapInArrow(_split, "item_id long, words array<string>").where(F.size("words") > 0), "items")
    # the benchmark's vocabulary is the only thing of its size that every task holds
    texts = items.select("words").distinct()
    seen = {r.word: r["count"] for r in texts.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count().collect()}
    if not seen:
        return spark.createDataFrame([], result)
    vocabulary = Vocabulary(seen, texts.count())
    sketch = docs.select("text").mapInArrow(_sketched(vocabulary), "block long, part binary").groupBy("block").applyInArrow(_added, "block long, part binary").collect()
    parts = {r.block: np.frombuffer(r.part) for r in sketch}  # FEATURES / 64 + 2 rows at most
    n, often = (parts[-1][0], parts[-2]) if parts else (0, np.zeros(FEATURES))
    total = np.zeros((FEATURES // 64, 64 * RANK))
    for k, part in parts.items():
        if k >= 0:
            total[k] = part
    idf = np.log((n + 1) / np.maximum(often, 1)) + 0.1
    basis = latent_basis(total.reshape(FEATURES, RANK), idf)
    common = often > max(COMMON * n, 20)
    turns, found = max(1, -(-items.count() // ITEMS_MOST)), None
    for turn in range(turns):  # each item in one turn
        part = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(turns)) == turn)
        rows = sorted((r.item_id, r.words) for r in part.collect())
        if rows:
            more = docs.select("row", "text").mapInArrow(_searched(vocabulary, idf, basis, Items(rows, vocabulary, idf, common, basis)), result)
            found = more if found is None else found.union(more)
    return scratch.keep(found, "matches")


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, same, answer: documents that hold an item.

    Null and empty texts and items hold nothing; rows with one doc_id give one
    row an item, with their best figures.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("row"), F.col("text").cast("string")).where("text is not null")
    found = _matches(spark, rows, benchmark).where("row is not null")
    return found.groupBy(F.col("row").cast("long").alias("doc_id"), "item_id").agg(F.max("cosine").alias("cosine"), F.max("same").alias("same"), F.max("answer").alias("answer"))


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, unchanged; rows are told apart by
    doc_id and text, and repeated rows go or stay together. Null and empty
    texts hold nothing and stay."""
    own = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(F.col("text").cast("string")).cast("string")]
    rows = docs.select(F.concat_ws(":", *own).alias("row"), F.col("text").cast("string").alias("text")).where("text is not null")
    bad = _matches(spark, rows, benchmark).select("row").distinct()
    mark = F.concat_ws(":", F.coalesce(F.col("d.doc_id").cast("string"), F.lit("")), F.xxhash64(F.col("d.text").cast("string")).cast("string"))
    return docs.alias("d").join(bad.alias("b"), mark == F.col("b.row"), "left_anti")
