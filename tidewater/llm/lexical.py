"""Ranked lexical search by NRA (Fagin, Lotem and Naor, JCSS 2003).

One pass over the texts writes an index: of each document its number of terms
and the query terms that it holds, with their counts. The corpus figures (rows,
terms, rows by term) are sums over that index. Tasks then sort their part of it
into one list a term, largest impact first, and answer each item by sequential
reads of its terms' lists: what has been read of a document is a lower bound of
its score; for each list in which it has not been met, the impact next to be
read there bounds what may be missing. Documents whose upper bound is below the
k-th lower bound go; reading ends when every document left has bounds that
meet, so membership, ties and scores are exact. Each task hands on the best k of
its part; these are merged in two steps.

An item's vocabulary is shipped to the tasks, so items are searched some
``ITEMS`` at a time; nothing else depends on that number.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, prepare

#: Items searched at a time, documents and postings sorted at a time.
ITEMS, DOCS, POSTINGS = 2000, 1 << 15, 1 << 21
#: Postings of a list in the first read; each further read is four times as long.
READ = 256
#: Bytes of text split at a time, and groups in which tasks' results first meet.
_PIECE, _MEET = 1 << 20, 256
_LAST_ID = (1 << 63) - 1

#: Letters A to Z in lower case; other signs below 128 that are no digit or letter part terms.
_TERMS = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time."""
    raw = (text or "").encode().translate(_TERMS)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + _PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


_INDEX = "doc_id long, n long, terms array<int>, counts array<int>"


def _indexed(known: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, counts = [], [], []
            ends = [0]
            for text in batch.column("text").to_pylist():
                n, held = 0, Counter()
                for words in terms_of(text):
                    n += len(words)
                    held.update(map(known.get, words))
                held.pop(None, None)
                sizes.append(n)
                terms.extend(held.keys())
                counts.extend(held.values())
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return run


class Lists:
    """Impact-sorted lists of some documents: positions of documents and impacts."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_terms: int):
        order = np.lexsort((docs, -impacts, terms))
        self.docs, self.impacts = docs[order], impacts[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, n: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions and exact scores of all documents that may be among the
        ``k`` best, ties included, with scores of ``least`` or more; and how
        many postings were read."""
        at, end = self.starts[terms].copy(), self.starts[terms + 1]
        low, seen = np.zeros(n, np.int64), np.zeros((len(terms), n), bool)
        left, place = np.arange(n), np.arange(n)  # documents that are left, and where each stands among them (-1: gone)
        step, read = READ, 0
        while True:
            part = np.minimum(end - at, step)
            whose = np.repeat(np.arange(len(terms)), part)
            where = np.arange(part.sum()) + np.repeat(at - np.cumsum(part) + part, part)
            read += len(where)
            doc = place[self.docs[where]]
            if len(left) < n:
                some = doc >= 0
                doc, whose, where = doc[some], whose[some], where[some]
            np.add.at(low, doc, weights[whose] * self.impacts[where])
            seen[whose, doc] = True
            at += part
            step *= 4
            # what the next read of each list can give at most
            ahead = np.where(at < end, weights * self.impacts[np.minimum(at, len(self.impacts) - 1)], 0)
            high = low + ahead.sum() - ahead @ seen
            bar = max(least, int(np.partition(low, len(low) - k)[len(low) - k])) if len(low) > k else least
            stay = high >= bar
            if not stay.all():
                left, low, high, seen = left[stay], low[stay], high[stay], seen[:, stay]
                place = np.full(n, -1)
                place[left] = np.arange(len(left))
            if (low == high).all():
                return left, low, read


def _found(items: list[tuple[np.ndarray, np.ndarray]], names: pa.Array, n_terms: int, k: int):
    """Best documents of a task's part of the index, an item at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(items)

        def search(group: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(group).combine_chunks()
            ids = t.column("doc_id").fill_null(_LAST_ID).to_numpy()
            lists = [c.chunk(0) if c.num_chunks else pa.array([], pa.list_(pa.int32())) for c in (t.column("terms"), t.column("counts"))]
            tf = np.asarray(lists[1].flatten()).astype(np.int64)
            doc = np.repeat(np.arange(len(ids)), np.asarray(lists[0].value_lengths()))
            if not len(doc):
                return
            m = t.column("m").to_numpy()
            found = Lists(np.asarray(lists[0].flatten()), doc, 1_000_000_000 * tf // (1000 * tf + 12 * m[doc]), n_terms)
            for i, (terms, weights) in enumerate(items):
                if not len(terms):
                    continue
                old_ids, old = best[i]
                docs, scores, _ = found.search(terms, weights, len(ids), k, max(1, int(old[-1])) if len(old) == k else 1)
                both, score = np.r_[old_ids, ids[docs]], np.r_[old, scores]
                order = np.lexsort((both, -score))[:k]
                best[i] = both[order], score[order]

        group, rows, size = [], 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS):
                part = batch.slice(start, DOCS)
                group.append(part)
                rows, size = rows + part.num_rows, size + len(part.column("terms").flatten())
                if rows >= DOCS or size >= POSTINGS:
                    search(group)
                    group, rows, size = [], 0, 0
        if group:
            search(group)
        count = np.array([len(x) for x, _ in best], np.int64)
        if count.sum():
            item = np.repeat(np.arange(len(items), dtype=np.int32), count)
            ids = np.concatenate([x for x, _ in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(item), names.take(pa.array(item)), pa.array(ids, mask=ids == _LAST_ID), pa.array(np.concatenate([x for _, x in best])), pa.array(np.full(len(item), TaskContext.get().partitionId() % _MEET, np.int32))],
                ["item", "item_id", "doc_id", "score", "meet"],
            )

    return run


def _some(spark: SparkSession, docs: DataFrame, items: list, names: pa.Array, kind: str, k: int) -> DataFrame:
    queries = [Counter(w for words in terms_of(text) for w in words) for text in items]
    known = {t: i for i, t in enumerate(sorted(set().union(*queries)))}
    scratch = Scratch(spark)
    index = scratch.keep(docs.mapInArrow(_indexed(known), _INDEX), "index")
    n, length = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(known), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a query term
        holding[r[0]] = r[1]
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) if x else 0 for x in holding], np.int64)
    asked = []
    for q in queries:
        terms = np.array([known[t] for t in q], np.int64)
        w = weight[terms] * np.array(list(q.values()), np.int64) if len(terms) else np.empty(0, np.int64)
        asked.append((terms[w > 0], w[w > 0]))  # the others add nothing
    m = F.expr(f"75L + (25L * n * {n}L) div {max(length, 1)}L")
    found = index.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "counts")
    found = found.mapInArrow(_found(asked, names, len(known), k), f"item int, item_id {kind}, doc_id long, score long, meet int")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for by in (["item", "meet"], ["item"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of largest score above
    0 for each item, ties to the smaller doc_id.

    Null texts have no term and are in no result. Repeated documents count and
    rank each for itself; rows without an id come last among equal scores. Items
    that repeat whole are searched once, an id with several texts once for each.
    Items without a term, or of which no document holds one, have no row; with
    an empty table on either side there is none at all.
    """
    prepare(spark)
    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    asked = items.select("item_id", F.col("text").cast("string")).distinct()
    kind = asked.schema["item_id"].dataType.simpleString()
    groups = -(-asked.count() // ITEMS)
    out = None
    for g in range(groups):
        some = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).toArrow()  # about ITEMS rows
        if some.num_rows:
            part = _some(spark, cols, some.column("text").to_pylist(), some.column("item_id").combine_chunks(), kind, k)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
