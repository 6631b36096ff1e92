"""Column names with dots, words of any length, signs that are no letters."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import langid, suffix_dedup, toxicity


def dotted(docs):
    return docs.select("*", F.lit(1).alias("a.b"), F.struct(F.lit(2).alias("c")).alias("a"), F.lit("x").alias("c0"))


def test_dotted_names_pass_the_stages(spark, docs_of):
    text = "the one long line of words that is found in two of these texts and not only in one of them " * 3
    docs = dotted(docs_of([f"first {text}", f"second {text}", None, "short"]))
    out = suffix_dedup.without_repeats(spark, docs, 200)
    assert out.columns == docs.columns and out.count() == 4 and {r["a.b"] for r in out.collect()} == {1}
    assert all(len(r.text) < 120 for r in out.where("doc_id < 2").collect())
    kept = langid.keep_identified(spark, docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 1, 3}


@pytest.mark.parametrize("text, want", [("½ ② ⁵", False), ("12 _ !", False), ("Ⅷ", False), ("½x", True), ("日", True), ("", False), ("é", True)])
def test_numerals_are_no_letters(text, want):
    assert langid._lettered(text) is want


def test_a_long_word_takes_no_more_than_its_own_room():
    """Beside thousands of short ones; with the same ratios as by itself."""

    class Two(toxicity.Model):
        def __init__(self):
            rng = np.random.default_rng(1)
            self.symbol = {c: 3 + i for i, c in enumerate("abcdefghij")}
            self.ratio = rng.normal(size=(5, 16)).astype(np.float32)
            self.follow = rng.integers(0, 5, (5, 16))
            self.start = 0

    model = Two()
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghijz"), rng.integers(1, 12))) for _ in range(4095)] + ["abcdefghij" * 3000]
    tracemalloc.start()
    got = model.ratios(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    for i in (0, 7, 4095):
        assert np.array_equal(model.ratios([words[i]])[0], got[i])
    state, total = 0, np.float32(0)
    for c in [*(model.symbol.get(c, 0) for c in words[7]), 2]:
        total += model.ratio[state, c]
        state = model.follow[state, c]
    assert np.isclose(got[7, 0], total) and got[7, 1] == len(words[7]) + 1
