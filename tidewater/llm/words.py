"""Per-word values with a bounded memory, for operators whose result over a
text is a sum over its words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np

_AT_ONCE = 1 << 20


class WordTable:
    """Rows of numbers by word. ``measure`` gives the rows of new words; with
    ``most`` of them known, further ones are kept for the texts at hand only
    (words of a language come early), which changes no value."""

    def __init__(self, measure: Callable[[list[str]], np.ndarray], most: int = 250_000):
        self.measure, self.most = measure, most
        self.place: dict[str, int] = {}
        self.rows: np.ndarray | None = None

    def _learn(self, words: list[str]) -> None:
        new = self.measure(words)
        n = len(self.place)
        if self.rows is None:
            self.rows = np.empty((1024, new.shape[1]), new.dtype)
        while len(self.rows) < n + len(words):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[n : n + len(words)] = new
        self.place.update(zip(words, range(n, n + len(words))))

    def of(self, texts: list[str | None], split: Callable[[str], list[str]]) -> Iterator[np.ndarray]:
        """The rows of each text's words, in order."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (size < _AT_ONCE or not group):
                group.append(split(texts[at] or ""))
                size += len(texts[at] or "")
                at += 1
            before = len(self.place)
            self._learn(sorted({w for words in group for w in words if w not in self.place}))
            get = self.place.__getitem__
            for words in group:
                yield self.rows[np.fromiter(map(get, words), np.int64, len(words))]
            if len(self.place) > self.most:  # the last come go first
                for w in list(islice(reversed(self.place), len(self.place) - max(before, self.most))):
                    del self.place[w]


_tables: dict[str, WordTable] = {}


def forget() -> None:
    """Drop what other operators have left in this worker process."""
    from . import tokens

    _tables.clear()
    tokens._encoders.clear()


def kept(key: str, make: Callable[[], WordTable]) -> WordTable:
    """One table a worker process, kept between the tasks of one model."""
    if key not in _tables:
        forget()
        _tables[key] = make()
    return _tables[key]
