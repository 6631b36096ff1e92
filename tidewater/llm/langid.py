"""Language of whole texts by a bidirectional gated recurrent network on bytes.

The network reads each word's bytes between two spaces, in both directions,
from a fresh state, and labels every byte position. A text's label pools the
log-probabilities of all positions of its words with a letter. It is trained in
numpy by backpropagation through time; the words of its steps are drawn from all
words of all texts to learn from, as often as they occur there.

White space resets the state so that a word is read once for all texts that
hold it: one state over whole texts reads some 1.2 MB a second and core in
numpy, about 1,500 CPU seconds for what Parquet stores in a GB.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, prepare, renamed
from .words import WordTable, kept

HIDDEN, STEPS, BATCH, RATE, SEED = 16, 500, 384, 0.01, 5
#: Bytes read from one state; longer words are read in pieces of so many.
SPAN = 30
#: Words whose counts a task holds before it hands them on.
COUNTED = 200_000
#: Positions after which more text no longer raises the certainty.
EVIDENCE = 48
#: A text is rejected if, of so many positions or more, less than this part
#: lies in words that the network reads as the text's language; a network that
#: reads some held-out labelled text worse asks for no more than SLACK of that.
LEAST_POSITIONS, LEAST_READ, SLACK = 150, 1 / 3, 0.75
_LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def _lettered(text: str) -> bool:
    """Whether a text has a letter; signs for numbers are none."""
    first = _LETTER.search(text)
    return first is not None and (first[0].isalpha() or any(map(str.isalpha, text)))



def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Weights: input tables (256 x 3H) and recurrent matrices of both
    directions, and the position labeller (2H x languages)."""

    def __init__(self, languages: int, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        h = hidden
        self.hidden = h
        self.w = {
            **{f"x{d}": rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32) for d in "fb"},
            **{f"h{d}": rng.normal(0, 0.8 / np.sqrt(h), (h, 3 * h)).astype(np.float32) for d in "fb"},
            "o": rng.normal(0, 0.3, (2 * h, languages)).astype(np.float32),
            "c": np.zeros(languages, np.float32),
        }

    def states(self, ids: np.ndarray, mask: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
        """Hidden state at each position (time x batch x hidden). Gates: update
        z, reset r, candidate n; h = z h + (1 - z) n."""
        t, b = ids.shape
        h, x, u = self.hidden, self.w[f"x{d}"], self.w[f"h{d}"]
        out = np.zeros((t, b, h), np.float32)
        state = np.zeros((b, h), np.float32)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            xi, m = x[ids[i]], mask[i][:, None]
            g = state @ u
            zr = _sigmoid(xi[:, : 2 * h] + g[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(xi[:, 2 * h :] + r * g[:, 2 * h :])
            new = np.where(m, z * state + (1 - z) * n, state)
            if tape is not None:
                tape.append((i, state, g, z, r, n, m))
            state = new
            out[i] = new
        return out

    def log_probabilities(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        s = np.concatenate([self.states(ids, mask, "f"), self.states(ids, mask, "b")], axis=2)
        y = s @ self.w["o"] + self.w["c"]
        y -= y.max(axis=2, keepdims=True)
        return y - np.log(np.exp(y).sum(axis=2, keepdims=True))

    def gradients(self, ids: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy of all positions and its gradient, backwards through time."""
        h = self.hidden
        tapes: dict[str, list] = {"f": [], "b": []}
        s = np.concatenate([self.states(ids, mask, d, tapes[d]) for d in "fb"], axis=2)
        y = s @ self.w["o"] + self.w["c"]
        p = np.exp(y - y.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        count = max(1.0, float(mask.sum()))
        own = np.take_along_axis(p, np.broadcast_to(label[None, :, None], (*ids.shape, 1)), 2)[..., 0]
        loss = float(-(np.log(own + 1e-9) * mask).sum() / count)
        dy = p.copy()
        t, b = ids.shape
        dy[np.arange(t)[:, None], np.arange(b)[None], label[None]] -= 1
        dy *= (mask / count)[..., None]
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["o"] = np.einsum("tbh,tbl->hl", s, dy)
        grads["c"] = dy.sum(axis=(0, 1))
        ds = dy @ self.w["o"].T
        for d, part in (("f", ds[..., :h]), ("b", ds[..., h:])):
            u, carry = self.w[f"h{d}"], np.zeros((b, h), np.float32)
            for i, state, g, z, r, n, m in reversed(tapes[d]):
                dh = part[i] + carry
                dn = np.where(m, dh * (1 - z), 0) * (1 - n * n)
                dz = np.where(m, dh * (state - n), 0) * z * (1 - z)
                dr = dn * g[:, 2 * h :] * r * (1 - r)
                dx = np.concatenate([dz, dr, dn], axis=1)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(grads[f"x{d}"], ids[i], dx)
                grads[f"h{d}"] += state.T @ dg
                carry = np.where(m, dh * z, dh) + dg @ u.T
        return loss, grads

    def train(self, words: list[bytes], label: np.ndarray, count: np.ndarray, steps: int = STEPS, seed: int = SEED) -> list[float]:
        """Adam on batches with as many words of each language; a language's
        words, each ``count`` times, come in a mixed order, and again when all
        have come. Bytes never seen stay mute."""
        rng = np.random.Generator(np.random.PCG64(seed + 1))
        of = [np.flatnonzero(label == k) for k in range(len(self.w["c"]))]
        mixed = [rng.permutation(np.repeat(x, count[x])) for x in of]
        each = a_step(len(of))
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        losses = []
        for step in range(1, steps + 1):
            at = np.concatenate([np.take(x, np.arange((step - 1) * each, step * each), mode="wrap") for x in mixed if len(x)])
            loss, grads = self.gradients(*as_columns([words[i] for i in at]), label[at])
            losses.append(loss)
            rate = RATE * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                self.w[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)
        seen = np.zeros(256, bool)
        seen[[32, *set(b"".join(words))]] = True
        for d in "fb":
            self.w[f"x{d}"][~seen] = 0
        return losses


def a_step(languages: int) -> int:
    """Words of a language in a step."""
    return max(1, BATCH // languages)


def as_columns(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and mask, time x batch, of words of at most SPAN bytes, each between two spaces."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    width = int(size.max(initial=0)) + 2
    flat = np.frombuffer(b"".join(b" " + w + b" " + bytes(width - len(w) - 2) for w in words), np.uint8).reshape(len(words), width)
    return flat.T, np.arange(width)[:, None] < (size + 2)[None]


def spans(word: str) -> list[bytes]:
    raw = word.encode()
    return [raw[at : at + SPAN] for at in range(0, len(raw), SPAN)]


def measure(net: Network, words: list[str]) -> np.ndarray:
    """For each word: the sum of its positions' log-probabilities, and their
    number; nothing for a word without a letter."""
    pieces, owner = [], []
    for i, w in enumerate(words):
        own = spans(w) if _lettered(w) else []
        pieces += own
        owner += [i] * len(own)
    order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
    out = np.zeros((len(words), len(net.w["c"]) + 1), np.float32)
    for at in range(0, len(order), 2048):  # of like length
        some = order[at : at + 2048]
        ids, mask = as_columns([pieces[i] for i in some])
        logp = net.log_probabilities(ids, mask) * mask[..., None]
        np.add.at(out, [owner[i] for i in some], np.c_[logp.sum(axis=0), mask.sum(axis=0)])
    return out


def pooled(rows: np.ndarray) -> np.ndarray:
    """Probabilities of a text from its words' rows."""
    total = rows.sum(axis=0, dtype=np.float64)
    y = total[:-1] / max(1.0, total[-1]) * min(max(1.0, total[-1]), EVIDENCE)
    p = np.exp(y - y.max())
    return p / p.sum()


def read_share(rows: np.ndarray) -> tuple[float, float]:
    """Part of a text's positions that lie in words whose label for the text's
    language is likelier than not, and the number of positions."""
    n, total = rows[:, -1], rows.sum(axis=0, dtype=np.float64)
    if not total[-1]:
        return 0.0, 0.0
    good = rows[:, int(total[:-1].argmax())] >= np.log(0.5) * n
    return float(n[good].sum() / total[-1]), float(total[-1])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with a letter of whole texts, by language, in pieces of SPAN bytes;
    a word may come again with a further count."""
    seen: dict[str, Counter] = {}

    def rows() -> pa.RecordBatch:
        lang, word, n = [], [], []
        for k, words in seen.items():
            for w, c in words.items():
                if _lettered(w):
                    own = spans(w)
                    lang += [k] * len(own)
                    word += own
                    n += [c] * len(own)
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            seen.setdefault(lang, Counter()).update(text.split())
            if sum(map(len, seen.values())) > COUNTED:
                yield rows()
    yield rows()


def _drawn_words(spark: SparkSession, labelled: DataFrame) -> tuple[list[str], list[tuple[str, bytes, int]]]:
    """The languages, and lang, word and how often it is drawn: of all words of
    all texts as many a language as the steps take, each as often as it occurs
    in proportion; all of them if there are fewer."""
    counted = labelled.select("lang", "text").mapInArrow(_counted, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = Scratch(spark).keep(counted, "words")  # read twice
    totals = words.groupBy("lang").agg(F.sum("n").alias("all"))
    languages = sorted(r.lang for r in totals.select("lang").collect())
    wanted = STEPS * a_step(max(1, len(languages)))
    # n * wanted / all times on average, rounded up or down by a hash
    chance = F.pmod(F.xxhash64("lang", "word", F.lit(SEED)), F.lit(2**32)) / 2.0**32
    times = F.floor(F.col("n") * F.least(F.lit(1.0), F.lit(float(wanted)) / F.col("all")) + chance).alias("n")
    some = words.join(totals, "lang").select("lang", "word", times).where("n > 0").toArrow()
    return languages, sorted(zip(*(some.column(c).to_pylist() for c in ("lang", "word", "n"))))


def fit(spark: SparkSession, labelled: DataFrame) -> tuple[list[str], Network | None]:
    """Train on rows (doc_id, text, lang), none of them null."""
    prepare(spark)
    languages, rows = _drawn_words(spark, labelled)
    if not rows:
        return [], None
    place = {x: i for i, x in enumerate(languages)}
    net = Network(len(languages))
    net.train([r[1] for r in rows], np.array([place[r[0]] for r in rows]), np.array([r[2] for r in rows]))
    return languages, net


def _predict(languages: list[str], net: Network | None, key: str, least: float | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept(key, lambda: WordTable(lambda words: measure(net, words)))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lang, score, clear = [], [], []
            found = table.of(texts, str.split) if net else iter([None] * len(texts))
            for text, rows in zip(texts, found):
                if rows is None or not len(rows) or not _lettered(text):
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    clear.append(False)
                    continue
                p, (share, n) = pooled(rows), read_share(rows)
                lang.append(languages[int(p.argmax())])
                score.append(float(p.max()))
                clear.append(n < LEAST_POSITIONS or share >= (least or 0.0))
            out = {n: batch.column(n) for n in batch.schema.names if n != "text"}
            out |= {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}
            if least is not None:
                out["clear"] = pa.array(clear, pa.bool_())
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def held_out(doc_id: F.Column, parts: int, part: int) -> F.Column:
    """Whether a document is kept from learning; one without an id always is."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(True))


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row.

    Learns from rows that are not held out and have text and lang. Null texts
    and texts without a letter are ``und`` with score 0, as is everything if
    nothing can be learnt. Repeated rows stay repeated.
    """
    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    languages, net = fit(spark, cols.where("not held_out and text is not null and lang is not null"))
    return cols.select("doc_id", "held_out", "text").mapInArrow(_predict(languages, net, uuid.uuid4().hex), "doc_id long, held_out boolean, lang_pred string, score double")


def _shares(net: Network, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept(key, lambda: WordTable(lambda words: measure(net, words)))
        for batch in batches:
            got = np.array([read_share(rows) for rows in table.of(batch.column("text").to_pylist(), str.split)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["share", "n"])

    return run


def _keep(languages: list[str], net: Network | None, key: str, least: float):
    predict = _predict(languages, net, key, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(next(predict(iter([batch.select(["text"])]))).column("clear"))

    return run


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language can be told, unchanged: null texts
    and texts without a letter go, and longer texts that the network reads as
    no learnt language (``LEAST_POSITIONS``, ``LEAST_READ``, ``SLACK``). Repeated rows go
    or stay together; if nothing can be learnt, texts with a letter stay."""
    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    languages, net = fit(spark, cols.where("not held_out and text is not null and lang is not null"))
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    key = uuid.uuid4().hex
    read = cols.where("held_out and text is not null and lang is not null").select("text").mapInArrow(_shares(net, key), "share double, n double")
    worst = read.where(F.col("n") >= LEAST_POSITIONS).agg(F.min("share")).first()[0]
    least = LEAST_READ if worst is None else min(LEAST_READ, SLACK * worst)
    plain = renamed(docs.withColumn("text", F.col("text").cast("string")))
    return plain.mapInArrow(_keep(languages, net, key, least), plain.schema).toDF(*docs.columns)
