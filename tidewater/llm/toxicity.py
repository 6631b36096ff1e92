"""Toxicity by class-conditional Kneser-Ney models.

Each class has a model of the characters of words, from the counts of its own
training texts; both back off to one interpolated Kneser-Ney model built from
the continuation counts of the two classes together, so an expression seen a
few times only leans on what all texts say. A text is scored by its
length-normalised log-likelihoods under the toxic and the ordinary model, over
the whole text and over its most toxic words; a logistic curve, fitted on
training texts that the counts leave out, turns them into a probability.

The models are compiled into one table: for each context of up to ``ORDER - 1``
characters, the log-likelihood ratio of every next character and the context
that follows, so scoring a word takes two look-ups a character.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drawn, prepare
from .langid import held_out
from .words import WordTable, kept

#: The bounded sample that is learnt from: documents of each class.
TRAIN_DOCS = 3000
ORDER, DISCOUNT, LEAST, SYMBOLS = 6, 0.75, 3, 62
#: Letters of words scored at a time.
CELLS = 1 << 18
#: Part of the sample that fits the curve, not the counts.
CURVE_PART = 3
THRESHOLD = 0.7
TOP, OVER, FEATURES = 6, 2.5, 7
_WORD = re.compile(r"[^\W\d_]+")


def split(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Model:
    """Symbols: 0 other, 1 word start, 2 word end, 3.. the commonest characters."""

    def __init__(self, toxic: Counter, ordinary: Counter):
        chars: Counter = Counter()
        for words in (toxic, ordinary):
            for w, n in words.items():
                for c in w:
                    chars[c] += n
        self.symbol = {c: i + 3 for i, (c, _) in enumerate(sorted(chars.items(), key=lambda x: (-x[1], x[0]))[:SYMBOLS])}
        counts = [self._counts(toxic), self._counts(ordinary)]
        self._compile(counts)

    def encode(self, word: str) -> tuple[int, ...]:
        get = self.symbol.get
        return (1, *(get(c, 0) for c in word), 2)

    def _counts(self, words: Counter) -> dict[tuple[int, ...], dict[int, int]]:
        """Next-symbol counts after each context of up to ORDER - 1 symbols,
        taking the longest context a position has."""
        out: dict = defaultdict(lambda: defaultdict(int))
        for w, n in words.items():
            s = self.encode(w)
            for i in range(1, len(s)):
                out[s[max(0, i - ORDER + 1) : i]][s[i]] += n
        return out

    def _compile(self, counts: list[dict]) -> None:
        size = SYMBOLS + 3
        # continuation counts, shared: in how many one-longer contexts (of either class) a symbol follows
        levels: list[dict] = [dict() for _ in range(ORDER)]
        totals = Counter()
        for table in counts:
            for h, nexts in table.items():
                totals[h] += sum(nexts.values())
        seen: dict = defaultdict(set)
        for table in counts:
            for h, nexts in table.items():
                seen[h].update(nexts)
        for h, nexts in seen.items():
            levels[len(h)].setdefault(h, np.zeros(size))
            for w in nexts:
                levels[len(h)][h][w] += 1
        for n in range(ORDER - 1, 0, -1):
            for h, row in levels[n].items():
                shorter = levels[n - 1].setdefault(h[1:], np.zeros(size))
                shorter += row > 0
        shared: dict[tuple, np.ndarray] = {}

        def backoff(h: tuple) -> np.ndarray:
            """Shared probabilities after context h."""
            if h in shared:
                return shared[h]
            below = np.full(size, 1 / size) if not h else backoff(h[1:])
            row = levels[len(h)].get(h)
            if row is None or not row.sum():
                return below
            n = row.sum()
            p = np.maximum(row - DISCOUNT, 0) / n + DISCOUNT * (row > 0).sum() / n * below
            if not h or levels[len(h)].get(h) is not None and len(h) < ORDER - 1:
                shared[h] = p
            return p

        # a word tells nothing more after a context seen less often: words of neither class would
        # else be judged by chance likenesses (held-out recall 0.76 at sf0.1, where it is 0.8 or more)
        contexts = sorted({h for h, n in totals.items() if n >= LEAST} | {(1,), ()}, key=lambda h: (len(h), h))
        place = {h: i for i, h in enumerate(contexts)}
        self.ratio = np.zeros((len(contexts), size), np.float32)
        self.follow = np.zeros((len(contexts), size), np.int32)
        longer: dict[tuple, list[tuple]] = defaultdict(list)
        for h in contexts[1:]:
            longer[h[:-1]].append(h)
        for i, h in enumerate(contexts):
            for x in longer.get(h[-(ORDER - 2) :], ()):
                self.follow[i, x[-1]] = place[x]
            own = [table.get(h) for table in counts]
            if any(own):
                self.ratio[i] = np.subtract(*(np.log(self._after(x, backoff(h[1:]))) for x in own))
        self.start = place[(1,)]

    @staticmethod
    def _after(own: dict[int, int] | None, below: np.ndarray) -> np.ndarray:
        """Probabilities of the next symbol by a class's counts of a context."""
        if not own:
            return below
        n, p = sum(own.values()), np.zeros(len(below))
        p[list(own)] = np.maximum(np.array(list(own.values()), float) - DISCOUNT, 0) / n
        return p + DISCOUNT * len(own) / n * below

    def ratios(self, words: list[str]) -> np.ndarray:
        """For each word: log-likelihood ratio, and its number of symbols."""
        out = np.zeros((len(words), 2), np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        get = self.symbol.get
        at = 0
        while at < len(order):
            end = at + 1  # a long word stands in a table of its own
            while end < min(len(order), at + 4096) and (end + 1 - at) * (len(words[order[end]]) + 1) <= CELLS:
                end += 1
            some, at = order[at:end], end
            width = len(words[some[-1]]) + 1
            ids = np.full((len(some), width), -1, np.int16)
            for k, i in enumerate(some):
                ids[k, : len(words[i])] = [get(c, 0) for c in words[i]]
                ids[k, len(words[i])] = 2
            state, total = np.full(len(some), self.start), np.zeros(len(some), np.float32)
            for c in range(width):
                x = ids[:, c]
                live = x >= 0
                total += np.where(live, self.ratio[state, x], 0)
                state = self.follow[state, np.maximum(x, 0)]
            out[some, 0] = total
            out[some, 1] = (ids >= 0).sum(axis=1)
        return out


def features(rows: np.ndarray) -> list[float]:
    """Length-normalised ratios of the whole text and of its most toxic words."""
    if not len(rows):
        return [0.0] * FEATURES
    r = rows[:, 0]
    top = np.sort(r[np.argpartition(-r, min(TOP, len(r)) - 1)[:TOP]])[::-1]
    over = np.maximum(r - OVER, 0).sum()
    return [float(r.sum() / rows[:, 1].sum()) * 10, float(top[0]), float(top[:3].sum() / 3), float(top.sum() / TOP), float(100 * over / (len(r) + 20)), float(np.log1p(over)), float(np.log1p(len(r)))]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Newton steps; x gets a constant column."""
    x = np.c_[x, np.ones(len(x))]
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + penalty * np.eye(len(b))
        b = b + np.linalg.solve(h, x.T @ (y - p) - penalty * b)
    return b


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            totals[toxic].update(split(text))
    for toxic, words in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(words), pa.int32()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["toxic", "word", "n"])


def fit(spark: SparkSession, labelled: DataFrame) -> tuple[Model, np.ndarray] | None:
    """From rows (text, toxic, n), n counting each class; None if a class is missing."""
    some = labelled
    counted = some.where(F.col("n") % CURVE_PART != 0).select("text", "toxic").mapInArrow(_counted, "toxic int, word string, n long")
    rows = counted.groupBy("toxic", "word").agg(F.sum("n").alias("n")).toArrow()  # of TRAIN_DOCS texts a class
    words: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for part in rows.to_batches(max_chunksize=20_000):
        for toxic, word, n in zip(*(c.to_pylist() for c in part.columns)):
            words[toxic][word] = n
    if not words[0] or not words[1]:
        return None
    model = Model(words[1], words[0])
    curve = some.where(F.col("n") % CURVE_PART == 0).select("text", "toxic").mapInArrow(_features(model, uuid.uuid4().hex), "toxic int, x array<double>").collect()
    if not curve:  # too few rows for a curve: the ratios of the text and of its worst words alone
        return model, np.array([0.5, 0.5, *[0.0] * (FEATURES - 2), -1.0])
    x, y = np.array([r.x for r in curve]), np.array([r.toxic for r in curve], float)
    return model, logistic(x, y)


def _features(model: Model, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept(key, lambda: WordTable(model.ratios))
        for batch in batches:
            x = [features(r) for r in table.of(batch.column("text").to_pylist(), split)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def _score(fitted: tuple[Model, np.ndarray] | None, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept(key, lambda: WordTable(fitted[0].ratios)) if fitted else None
        for batch in batches:
            if fitted:
                x = np.array([features(r) for r in table.of(batch.column("text").to_pylist(), split)]).reshape(-1, FEATURES)
                score = 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ fitted[1], -30, 30)))
            else:
                score = np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row.

    Learns from labelled rows that are not held out (null text or label: none;
    of rows that share an id, one text). Null, empty and wordless texts get the score of no evidence; without
    both classes every score is 0.
    """
    prepare(spark)
    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    marks = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # the sample is drawn from ids, so that only its texts move: at most TRAIN_DOCS ids a class are broadcast
    ids = drawn(marks.where(~held_out(F.col("doc_id"), 3, 1)), "toxic", ["doc_id"], TRAIN_DOCS)
    texts = cols.where("text is not null").join(F.broadcast(ids.select("doc_id", "toxic", "n")), "doc_id")
    # rows may share an id: one text of each is learnt from
    known = texts.groupBy("doc_id", "toxic", "n").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "toxic", "n")
    fitted = fit(spark, known)
    return cols.select("doc_id", "text", "held_out").mapInArrow(_score(fitted, uuid.uuid4().hex), "doc_id long, held_out boolean, score double, predicted int")
