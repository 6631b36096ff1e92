"""Token ids of whole texts.

A public tokenizer splits a text before it merges, and never merges across the
split before a space, so ``encode(text)`` is the concatenation of its words'
ids. Words repeat; each task remembers theirs (a bounded cache, which changes no
id) and hands only new words to the library, many in a call. A text that holds
the string of a special token is encoded whole, as the library does.
"""

from __future__ import annotations

import os
import re
from collections.abc import Hashable, Iterator

import numpy as np

from .words import forget

#: Words that a task remembers; with so many, new ones are kept for the texts
#: at hand only (words of a language come early, later ones hardly repeat).
CACHE_MOST = 500_000
#: Characters of text split at a time, and words encoded in one call.
_AT_ONCE, _CALL = 1 << 20, 4000
#: Marks that end a word.
_ENDS = ".,;:!?%*#$&|"
_RUNS = re.compile(r"\s\s|[^\S \n]")
_SPACE = re.compile(r" (?=\S)")


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        #: what a text with a special string holds as it stands (letters may be in either case)
        self.signs = {next((c for c in x if not c.isalpha()), "") for x in self.special}
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        #: whether a word's ids depend on the space before it
        self.spaced = ids(" b") != ids("b")
        self.lowers = ids("AB cD") == ids("ab cd")
        self.line_id = (ids("\n") or [-1])[0]
        #: of each id, whether it begins a word after a space, or ends a word
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        space, end = (self.tokenizer.id_to_token(ids(x)[0]) if self.spaced == (x == " ") else "\n" for x in (" ", "a"))
        self.begins = np.array([x.startswith(space) for x in names])
        self.ends = np.array([x.endswith(end[1:] or "\n") for x in names])
        #: ids by word: a string stands after a space (or begins with its line end), a 1-tuple at the start of a text
        self.known: dict[Hashable, bytes] = {}

    def _words(self, text: str) -> list[Hashable]:
        if not self.spaced:  # white space only parts words
            text = text.replace("\n", " ")
            return (text.lower() if self.lowers and text.isascii() else text).split(" ")
        # lone line ends part words too, and begin the next one; of white space only the space is printable
        flat = text.replace("\n", " ")
        runs = ("  " in flat or not flat.isprintable()) and _RUNS.search(text)
        words = _SPACE.split(text) if runs else text.replace("\n", " \n").split(" ")
        words[0] = (words[0],)
        return words

    def _letters(self, words: list[str], before: str) -> dict[str, bytes]:
        """Words of letters alone, each after the same character: the library
        takes such a word for one unit, so ids that begin one part them."""
        out: dict[str, bytes] = {}
        for at in range(0, len(words), _CALL):
            part = words[at : at + _CALL]
            x = self.tokenizer.encode_batch_fast([before + before.join(part)], add_special_tokens=False)[0]
            ids = np.array(x.ids, "<u4")
            raw, first = ids.tobytes(), ids == self.line_id if before == "\n" else self.begins[ids] if self.spaced else np.r_[True, self.ends[ids[:-1]]]
            cut = [*(4 * np.flatnonzero(first)).tolist(), len(raw)]
            if len(cut) == len(part) + 1 and not cut[0]:
                out.update(zip(part, map(raw.__getitem__, map(slice, cut[:-1], cut[1:]))))
            else:  # a letter that the library does not take for one
                out.update(self._singly(part, [before + w for w in part]))
        return out

    def _singly(self, keys: list, texts: list[str]) -> dict:
        return {k: np.array(x.ids, "<u4").tobytes() for k, x in zip(keys, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))}

    def _encoded(self, words: list[Hashable]) -> dict[Hashable, bytes]:
        """New words. Letters and the marks that end them are parted by every
        public tokenizer, so these take their ids from the two."""
        spaced, known = self.spaced, self.known
        heads: dict[str, str] = {}
        lines: dict[str, str] = {}
        odd: list[Hashable] = []
        for w in words:
            h = w.rstrip(_ENDS) if isinstance(w, str) else ""
            if h.isalpha() and (spaced or h.isascii() or h.lower().isalpha()):  # lowering may give a mark
                heads[w] = h
            elif spaced and h[:1] == "\n" and h[1:].isalpha():
                lines[w] = h
            else:
                odd.append(w)
        before = " " if spaced else ""
        out = self._singly(odd, [w[0] if isinstance(w, tuple) else w if spaced and w[:1] == "\n" else before + w for w in odd])
        new = {h for h in heads.values() if h not in known}
        out |= self._letters(list(new), " ")
        new = {h for h in lines.values() if h not in known}
        out |= {"\n" + h: x for h, x in self._letters([h[1:] for h in new], "\n").items()}
        ends = {w[len(h) :] for some in (heads, lines) for w, h in some.items()}
        marks = self._singly(list(ends), list(ends))
        for some in (heads, lines):
            for w, h in some.items():
                if w is not h:
                    out[w] = (out[h] if h in out else known[h]) + marks[w[len(h) :]]
        return out

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """In order; null and empty texts have no ids."""
        at, get = 0, self.known.get
        while at < len(texts):
            group: list[bytes | tuple[list, list, list]] = []
            size, new = 0, set()
            while at < len(texts) and (size < _AT_ONCE or not group):
                text = texts[at] or ""
                at, size = at + 1, size + len(text)
                if any(c in text for c in self.signs) and any(s in text.lower() for s in self.special):
                    group.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                    continue
                words = self._words(text)
                ids = list(map(get, words))
                if None in ids:
                    gaps = [i for i, x in enumerate(ids) if x is None]
                    new.update(map(words.__getitem__, gaps))
                    group.append((words, ids, gaps))
                else:
                    group.append(b"".join(ids))
            fresh = self._encoded(list(new))
            if len(self.known) + len(fresh) <= CACHE_MOST:
                self.known.update(fresh)
            for x in group:
                if isinstance(x, tuple):
                    words, ids, gaps = x
                    for i in gaps:
                        ids[i] = fresh[words[i]]
                    x = b"".join(ids)
                yield x


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One a worker process, kept between tasks."""
    if path not in _encoders:
        forget()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
