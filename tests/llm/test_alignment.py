import hashlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidewater.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOK = alignment.Tokenizers(A, B)
PLAIN_A, PLAIN_B = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
PLAIN_A.encode_special_tokens = True
N_B = PLAIN_B.get_piece_size()


@cache
def bytes_of_a(i):
    """The byte-level alphabet: printable bytes are themselves, the others are numbered from 256 on."""
    own = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    names = {chr(c): c for c in own}
    names.update({chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in own)})
    return bytes(names[c] for c in PLAIN_A.id_to_token(i))


def bytes_of_b(i):
    piece = PLAIN_B.id_to_piece(i)
    return bytes([int(piece[1:-1], 16)]) if PLAIN_B.is_byte(i) else piece.replace("▁", " ").encode()


def groups_of(text):
    """Groups of (A ids, B ids) of a whole text, token by token."""
    if not text:
        return []
    raw = (" " + text).encode()
    sides = []
    for ids, of in ((PLAIN_A.encode(" " + text, add_special_tokens=False).ids, bytes_of_a), (PLAIN_B.encode(text), bytes_of_b)):
        if b"".join(map(of, ids)) != raw:
            return []
        ends, at = [], 0
        for i in ids:
            at += len(of(i))
            ends.append((at, i))
        sides.append(ends)
    out, i, j = [], 0, 0
    for cut in sorted({e for e, _ in sides[0]} & {e for e, _ in sides[1]}):
        a, b = [], []
        while i < len(sides[0]) and sides[0][i][0] <= cut:
            a.append(sides[0][i][1])
            i += 1
        while j < len(sides[1]) and sides[1][j][0] <= cut:
            b.append(sides[1][j][1])
            j += 1
        out.append((a, b))
    return out


def brute(rows):
    groups = [(i, groups_of(t)) for i, t in rows]
    count = Counter(p for _, g in groups for p in {(x, y) for a, b in g for x in a for y in b})
    highest = {}
    for (x, _), n in count.items():
        highest[x] = max(highest.get(x, 0), n)
    out = []
    for i, g in groups:
        links = [(x, y) for a, b in g for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", *alignment._FIGURES, "groups_sha256"]


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


ODD = ["a", " a", "a ", " ", "  ", "a  b", "a\nb", "\n\na \n b", "<|endoftext|> <s> </s> <unk> <0x0A>", "é́ ｘ ﬁ½", "日本 語日", "🙂🙂 🙂", "\t\t x", "it's don't  12345 ...!? ", "\x00a \x1c b", "a　b", "▁ ▁a a▁b", "﻿a", "x" * 300, "ÀÉÎ " * 5, "Ünïcödé-wörds, and more.\nNew line", "\x85a b"]


def written(text):
    memory = alignment.Memory(TOK, alignment.Counts(alignment.PerfectHash(1, []), np.empty(0, np.int64), np.zeros(60_000, np.int64)))
    places = next(memory.texts([text]))
    return b";".join(memory.written[i] for i in places).decode(), memory.figures[places].sum(axis=0)[:4].tolist()


def check(text):
    g = groups_of(text)
    want = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
    assert written(text) == (want, [sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(len(a) * len(b) for a, b in g)])


@pytest.mark.parametrize("text", ODD)
def test_chunks_are_aligned_as_the_text(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "the", "Th", "12", "'s", "é", "!", " ", "日", "\r", "▁", "<s>", "🙂", "ing", "\x00", "　", "ß"]), max_size=16).map("".join))
def test_any_mixture(text):
    check(text)


def test_wide_groups_put_equal_ids_together(monkeypatch):
    texts = ["日" * 50, "éa🙂 " * 9, "a" * 77]
    monkeypatch.setattr(alignment, "_WIDE", 0)
    for t in texts:
        x = alignment.Aligned(TOK, [t])
        want = Counter(a * N_B + b for g in groups_of(t) for a in g[0] for b in g[1])
        got = Counter()
        for p, n in zip(x.pair.tolist(), x.times.tolist()):
            got[p] += n
        assert got == want


def test_hash_is_sparks(spark):
    keys = np.random.default_rng(1).integers(0, 1 << 40, 1000)
    df = spark.createDataFrame([(int(k),) for k in keys], "k long").selectExpr("k", "xxhash64(k) h", "pmod(xxhash64(k), 37L) s").toPandas()
    assert (alignment.xxh64(df.k.to_numpy(), 42).astype(np.int64) == df.h.to_numpy()).all()
    assert (alignment.shard_of(df.k.to_numpy(), 37) == df.s.to_numpy()).all()


def test_perfect_hash_is_minimal_and_tells_foreign_keys():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 50, 40_000))
    own, other = keys[::2], keys[1::2]
    for shards in (1, 5):
        parts = [np.sort(own[alignment.shard_of(own, shards) == s]) for s in range(shards)]
        mph = alignment.PerfectHash(shards, [(s, *alignment.built(p)) for s, p in enumerate(parts)])
        places = mph.places(own)
        assert sorted(places) == list(range(len(own))) and (mph.keys[places] == own).all()
        assert (mph.places(other) == -1).all()
    some = alignment.PerfectHash(5, [(3, *alignment.built(parts[3]))])
    assert ((some.places(own) >= 0) == (alignment.shard_of(own, 5) == 3)).all()
    bits = len(alignment.built(own)[1]) * 8
    assert bits < 4.5 * len(own)
    assert (alignment.PerfectHash(1, [(0, *alignment.built(own[:0]))]).places(own) == -1).all()


def test_chunks_do_not_change_each_other():
    memory = alignment.Memory(TOK, alignment.Counts(alignment.PerfectHash(1, []), np.empty(0, np.int64), np.zeros(60_000, np.int64)))
    for text, places in zip(ODD, list(memory.texts(ODD))):
        assert b";".join(memory.written[i] for i in places).decode() == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups_of(text))


def test_align_equals_brute_force(spark, docs_of, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert rows_of(alignment.align(spark, docs.repartition(5), A, B)) == brute([tuple(r) for r in docs.collect()])


def test_small_shards_groups_and_memory(spark, docs_of, monkeypatch):
    """Many shards, rounds of sums, several groups of shards, forgotten chunks."""
    for name, value in (("SHARD", 50), ("FAN", 2), ("KEYS", 120), ("REMEMBERED", 10), ("_MERGE", 40), ("_CALL", 20), ("_AT_ONCE", 30)):
        monkeypatch.setattr(alignment, name, value)
    rng = np.random.default_rng(5)
    words = ["alpha", "Beta", "gamma's", "déjà", "12345", "日本", "x\ny", "zzz!", "q  q"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 12))) for _ in range(120)]
    assert rows_of(alignment.align(spark, docs_of(texts, 7), A, B)) == brute(list(enumerate(texts)))


def test_odd_rows(spark, docs_of):
    texts = [None, "", *ODD, (5, "tie a"), (5, "tie a"), (None, "no id"), "long word " * 3_000, "y" * 900]
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    assert rows_of(alignment.align(spark, docs_of(texts), A, B)) == brute(pairs)
    none = alignment.align(spark, docs_of(["x"]).where("false"), A, B)
    assert none.columns == COLUMNS and none.count() == 0
    assert rows_of(alignment.align(spark, docs_of([None, ""]), A, B)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (0, 1)]


def test_a_long_word_without_common_ends(spark, docs_of):
    """Its links are counted by equal ids, not one by one."""
    text = "y" * 100_000
    row = alignment.align(spark, docs_of([text, "x"]), A, B).where("doc_id = 0").first()
    a, b = PLAIN_A.encode(" " + text, add_special_tokens=False).ids, PLAIN_B.encode(text)
    assert (row.n_a, row.n_b) == (len(a), len(b)) and row.n_links == row.count_sum >= row.n_best > 0
