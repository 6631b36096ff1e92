import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewater.llm import packing, token_files
from tidewater.llm.tokens import WordEncoder

BYTE, WORD = (public_tokenizers.path(f"{x}.json") for x in ("byte_bpe_50k", "word_bpe_49k"))
ODD = ["", " ", "a  b   c", "a\n\n  b \n", " x", "x ", "<|endoftext|> a<|startoftext|>", "x <|endoftext|> y", "<|ENDOFTEXT|>", "ｘ.\nｙ! \nz", "ab1. a\u0301b, \ua7cb\u1c89 x", "\nab.\ncd", "ab\n", "\n", "\x1c a \x1f", "é ́", "it's  don't 12 3 ...!? ", "a b  c", "日本 語", "🙂 🙂🙂", "\t\t a\t b", "A B. C,\r\n D", "end. End, END! § it's§ o\u0301. É. İ. x_. 9.", "a.\nB. ... a..b"]
ENCODERS = {p: WordEncoder(p) for p in (BYTE, WORD)}


def plain(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_give_the_librarys_ids(path):
    got = [np.frombuffer(x, "<u4").tolist() for x in ENCODERS[path].encode_all([*ODD, None])]
    assert got == [plain(path, t) for t in [*ODD, None]]


PLAIN = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "the", "Th", "12", "'s", "é", "!", " ", "日", "\r"]), max_size=14).map("".join))
def test_any_mixture_of_spaces(text):
    for path in (BYTE, WORD):
        assert np.frombuffer(next(ENCODERS[path].encode_all([text])), "<u4").tolist() == PLAIN[path].encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=40))
def test_assign_fills_every_sequence_but_the_last_ones_room(sizes):
    sizes = sorted(sizes, reverse=True)
    pieces = packing.assign(sizes, 64)
    for i, size in enumerate(sizes):
        own = sorted(p[1:3] for p in pieces if p[0] == i)
        assert sum(n for _, n in own) == size and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:]))
    used = {s for *_, s, _ in pieces}
    assert len(used) == -(-sum(sizes) // 64)
    for s in used:
        own = sorted((p[4], p[2]) for p in pieces if p[3] == s)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 64


def test_pack_whole_documents(spark, docs_of):
    texts = ["a b c " * 3000, "", None, "word " * 5, "x", (1, ""), (None, "null id"), (3, "word " * 5), *["t%d " % i * (i % 90) for i in range(200)]]
    rows = packing.pack(spark, docs_of(texts), BYTE).toPandas()
    ids = {}
    for i, t in enumerate(texts):
        k, t = t if isinstance(t, tuple) else (i, t)
        ids.setdefault(-1 if k is None else k, []).append([*plain(BYTE, t), 1])
    total = sum(len(x) for v in ids.values() for x in v)
    assert rows.length.sum() == total
    seq = rows.groupby("sequence_id")
    assert seq.length.sum().max() <= 2048 and len(seq) * 2048 - total < 2048
    for _, s in seq:
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
    for r in rows.itertuples():
        k = -1 if r.doc_id != r.doc_id or r.doc_id is None else int(r.doc_id)
        crcs = [zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in ids[k] if len(x) == r.doc_tokens]
        assert r.ids_crc32 in crcs
    assert packing.pack(spark, docs_of(["x"]).where("false"), BYTE).count() == 0


def test_orc_round_trip(spark, docs_of, tmp_path):
    texts = ["a b", "", None, "long " * 9000, (7, "Tie one"), (7, "Tie two"), (7, "Tie two"), (None, "no id"), (-3, "before")]
    docs = docs_of(texts)
    got = token_files.token_digest(spark, docs, WORD).toPandas().sort_values("start")
    assert got.start.tolist() == [0, *got.n_tokens.cumsum().tolist()[:-1]]
    keys = got.doc_id.tolist()
    assert keys[0] != keys[0] and keys[1:] == sorted(keys[1:])
    want = sorted((zlib.crc32(np.array([*plain(WORD, t[1] if isinstance(t, tuple) else t), 2], "<u4").tobytes())) for t in texts)
    assert sorted(got.ids_crc32) == want
    token_files.write_tokens(spark, docs, str(tmp_path / "o"), WORD, 2)
    back = token_files.read_tokens(spark, str(tmp_path / "o"))
    assert back.where("doc_id = 0").first().ids == [*plain(WORD, "a b"), 2]
    assert token_files.token_digest(spark, docs.where("false"), WORD).count() == 0


def test_starts_point_at_the_stored_ids(spark, docs_of):
    """Also where rows share an id: the ids of all rows in order of start are the files' ids in order."""
    texts = [(5, f"{x} same id") for x in ("b", "a", "c", "a", "")] + [(i, f"row {i} " * (i % 7)) for i in range(200)]
    docs = docs_of(texts)
    rows = token_files.token_digest(spark, docs, WORD).toPandas().sort_values(["start"])
    assert rows.start.tolist() == [0, *rows.n_tokens.cumsum().tolist()[:-1]] and rows.doc_id.is_monotonic_increasing


def test_readers_prune_by_doc_id(spark, docs_of, tmp_path):
    import glob

    from pyarrow import orc

    path = str(tmp_path / "o")
    texts = [" ".join(f"w{i * 7 + k}" for k in range(60)) for i in range(12_000)]
    token_files.write_tokens(spark, docs_of(texts), path, WORD, 2, files=2, stripe_bytes=1 << 18)
    files = sorted(glob.glob(path + "/part-*"))
    ends = []
    for f in files:
        ids = orc.ORCFile(f).read(["doc_id"]).column("doc_id").to_pylist()
        ends.append((ids[0], ids[-1]))
        assert ids == sorted(ids)
    assert len(files) == 2 and ends[0][1] < ends[1][0]  # ranges do not meet, so footers tell which file holds an id
    assert sum(orc.ORCFile(f).nstripes for f in files) > 2  # stripes to be read in parallel
    back = token_files.read_tokens(spark, path).where("doc_id = 4321")
    assert "EqualTo(doc_id,4321)" in back._jdf.queryExecution().executedPlan().toString()
    assert back.count() == 1 and back.first().ids == [*plain(WORD, texts[4321]), 2]
