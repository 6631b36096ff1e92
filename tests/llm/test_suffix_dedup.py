import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import suffix_dedup as S


def covered(texts, length):
    """Removed spans of each text by counting every window (by its checksum)."""
    raw = [(t or "").encode() for t in texts]
    seen, digest = {}, xxhash.xxh3_128_digest
    for b in raw:
        for i in range(len(b) - length + 1):
            w = digest(b[i : i + length])
            seen[w] = seen.get(w, 0) + 1
    out = []
    for b in raw:
        c = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[digest(b[i : i + length])] > 1:
                c[i] += 1
                c[i + length] -= 1
        out.append(np.cumsum(c)[:-1] > 0)
    return raw, out


def check(spark, docs_of, texts, length):
    rows = docs_of(texts)
    got = {r.doc_id: r for r in S.repeat_digest(spark, rows, length).collect()}
    raw, cover = covered(texts, length)
    for i, (b, c) in enumerate(zip(raw, cover)):
        kept = bytes(np.frombuffer(b, np.uint8)[~c])
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), int(c.sum()), int((np.diff(np.r_[0, c.astype(int)]) == 1).sum()))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest() and r.text == kept.decode(errors="replace")


def sample(rng):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    texts = [None, "", "short", "a" * 500, "a" * 130, "ab" * 400, "line of text\n" * 60, shared[0], shared[0], shared[0][:150] + "!" + shared[0][150:]]
    for _ in range(60):
        parts = [prose(rng.randint(0, 40)) for _ in range(3)]
        if rng.random() < 0.6:
            s = rng.choice(shared)
            a = rng.randint(0, 120)
            parts.insert(1, s[a : a + rng.randint(60, 300)])
        texts.append(" ".join(parts))
    return texts


def test_matches_counting_all_windows(spark, docs_of):
    check(spark, docs_of, sample(random.Random(3)), 100)


def test_four_hundred_bytes_on_documents_with_planted_passages(spark, docs_of, sf):
    """The query's length, on given texts: passages of over fifty words in several texts, copies, and short repeats that stay."""
    rng = random.Random(9)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    passage = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n))
    long, short = [passage(75) for _ in range(5)], passage(50)[:399]
    for k, x in enumerate(long):
        for i in rng.sample(range(len(texts)), 4):
            texts[i] = f"{texts[i][: 100 * k]} {x} {texts[i][100 * k :]}"
    texts += [f"{passage(20)} {short} {passage(20)}" for _ in range(3)] + [texts[3], texts[3] + " more"]
    check(spark, docs_of, texts, 400)


def test_a_crowded_anchor_goes_window_by_window(spark, docs_of, monkeypatch):
    monkeypatch.setattr(S, "ANCHOR_MOST", 3)
    check(spark, docs_of, sample(random.Random(4)), 100)


def test_repeated_rows_and_null_ids(spark, docs_of):
    text = "".join(chr(97 + i * i % 23) for i in range(300))
    rows = docs_of([(1, text), (1, text), (None, "other " + text), (2, "")])
    got = S.repeat_digest(spark, rows, 100).collect()
    assert len(got) == 4 and all(r.n_removed == 300 for r in got if r.n_bytes >= 300)
    cut = S.without_repeats(spark, rows, 100)
    assert cut.columns == rows.columns and sorted(r.text for r in cut.collect()) == ["", "", "", "other "]
    assert S.repeat_digest(spark, rows.where("false"), 100).count() == 0


def test_edges_stay_whole_characters():
    raw = "aééé".encode()
    assert S.clean_edges(raw, [(2, 6)]) == [(3, 5)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=70, max_size=260).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=5))
def test_stretches_cover_every_start_once(texts):
    for b in texts:
        first, count, anchor, _ = S.stretches(np.frombuffer(b, np.uint8), 64)
        starts = [s for f, c in zip(first.tolist(), count.tolist()) for s in range(f, f + c)]
        assert starts == list(range(max(0, len(b) - 63)))
        assert all(f <= a + 64 and a - f >= c - 1 for f, c, a in zip(first.tolist(), count.tolist(), anchor.tolist()))


@pytest.mark.parametrize("seed", range(3))
def test_columnwise_flags_equal_windows(seed):
    rng = random.Random(seed)
    core = bytes(rng.randrange(4) for _ in range(80))
    parts, lead = [], []
    for _ in range(12):
        left, right = bytes(rng.randrange(2) for _ in range(rng.randint(0, 30))), bytes(rng.randrange(2) for _ in range(rng.randint(0, 30)))
        parts.append(left + core + right)
        lead.append(len(left))
    flags = S.repeated(np.zeros(len(parts), int), np.array(lead), parts, 85)
    top = max(lead)
    for i, p in enumerate(parts):
        for s in range(lead[i] + 1):
            w = p[s : s + 85]
            same = any(q[lead[j] - lead[i] + s :][:85] == w for j, q in enumerate(parts) if j != i and lead[j] - lead[i] + s >= 0)
            assert flags[i, top - lead[i] + s] == (len(w) == 85 and same)
