import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=20):
    """Scores of all documents for all items, in plain Python."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, c in held if c)
    length = sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            s = 0
            m = 75 + 25 * c.total() * n // length if length else 75
            for t in terms(text):
                if c[t]:
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()))


def items_of(spark, items):
    df = spark.createDataFrame(items, "item_id long, text string")
    for clash in ("doc_id", "n", "terms", "score", "item", "meet"):
        df = df.withColumn(clash, df.item_id)
    return df


@pytest.mark.parametrize("text", ["", None, "A b-C", "É é ß_x", "x1Y2\x00z", "...", "日本 a b", "KK", "a" * 40])
def test_terms(text):
    assert [w.decode() for part in lexical.terms_of(text) for w in part] == terms(text)


def test_long_texts_are_split_whole(monkeypatch):
    monkeypatch.setattr(lexical, "_PIECE", 7)
    text = "abc defghij k lmnopqrstuvwxyz " * 50
    assert [w.decode() for part in lexical.terms_of(text) for w in part] == terms(text)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 60), st.integers(1, 6), st.integers(1, 8), st.sampled_from([1, 2, 9]))
def test_reads_end_with_exact_scores(seed, n, n_terms, k, high):
    """Lists against the sum over all postings, with many ties."""
    rng = np.random.default_rng(seed)
    held = rng.random((n_terms, n)) < 0.5
    impact = rng.integers(1, high + 1, (n_terms, n))
    weights = rng.integers(1, high + 1, n_terms)
    t, d = np.nonzero(held)
    order = rng.permutation(len(t))
    lists = lexical.Lists(t[order], d[order], impact[t, d][order], n_terms)
    if not len(t):
        return
    old, lexical.READ = lexical.READ, 2
    try:
        docs, scores, read = lists.search(np.arange(n_terms), weights, n, k, 1)
    finally:
        lexical.READ = old
    full = (held * impact * weights[:, None]).sum(0)
    assert (full[docs] == scores).all() and read <= len(t)
    want = sorted((-s, i) for i, s in enumerate(full) if s > 0)[:k]
    assert sorted((-s, i) for i, s in zip(docs.tolist(), scores.tolist()) if s > 0)[:k] == want


def test_reads_end_early():
    """A few documents far ahead in every list: most of the lists stay unread."""
    n = 20_000
    impacts = np.where(np.arange(n) < 30, 10_000 - np.arange(n), 1)
    t, d = np.repeat(np.arange(3), n), np.tile(np.arange(n), 3)
    docs, _, read = lexical.Lists(t, d, np.tile(impacts, 3), 3).search(np.arange(3), np.ones(3, np.int64), n, 20, 1)
    assert sorted(docs)[:20] == list(range(20)) and read < 3 * 2000


def test_search_equals_brute_force(spark, docs_of, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    want = brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert rows(lexical.search(spark, docs.repartition(5), items)) == want


def test_small_blocks_and_groups_of_items(spark, docs_of, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(300)]
    items = [(i, " ".join(rng.choice(words, 5))) for i in range(9)]
    want = brute(list(enumerate(texts)), items)
    for name, value in (("ITEMS", 2), ("DOCS", 16), ("_MEET", 2)):
        monkeypatch.setattr(lexical, name, value)
    assert rows(lexical.search(spark, docs_of(texts), items_of(spark, items))) == want


def test_odd_rows(spark, docs_of):
    """Nulls, repeats, ties, very long and empty texts, clashing columns."""
    texts = [None, "", "...", "apple pear", (4, "apple pear"), (4, "apple pear"), "apple " * 60_000, (9, "Pear! APPLE"), *[(20 + i, "fig") for i in range(30)]]
    items = [(1, "apple"), (2, None), (3, ""), (4, "nowhere"), (5, "FIG fig"), (6, "pear fig pear"), (6, "pear fig pear"), (7, "pear Apple é")]
    got = rows(lexical.search(spark, docs_of(texts), items_of(spark, items)))
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    assert got == brute(pairs, sorted(set(items), key=str))
    assert [r[2] for r in got if r[0] == 5] == list(range(20, 40))
    null = lexical.search(spark, docs_of([(None, "apple"), (3, "apple"), "x", "y", "z"]), items_of(spark, [(1, "apple")])).orderBy("rank").collect()
    assert [r.doc_id for r in null] == [3, None]


def test_empty_tables(spark, docs_of):
    empty = docs_of(["x"]).where("false")
    for docs, items in ((empty, items_of(spark, [(1, "x")])), (docs_of(["x"]), items_of(spark, []).where("false")), (docs_of([None, ""]), items_of(spark, [(1, "x")]))):
        out = lexical.search(spark, docs, items)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0
