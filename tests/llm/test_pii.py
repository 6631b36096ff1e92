import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def check_digit(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain(text):
    """The patterns as they are written down."""
    out = []
    digits = lambda s: [c for c in s if c in "0123456789"]
    for kind, pattern, ok in (
        ("email", EMAIL, lambda m: True),
        ("ip", IP, lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", CARD, lambda m: 14 <= len(digits(m)) <= 19 and check_digit(digits(m))),
        ("phone", PHONE, lambda m: 10 <= len(digits(m)) <= 15),
    ):
        out += [(m.start(), pii.KINDS.index(kind), m.end(), kind) for m in pattern.finditer(text) if ok(m[0])]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


ODD = [
    "", "a@b.c@d.e", "x@y", "a@@b.c", ".@-.-", "é@a.b", "a@b.é", "a.b+c%d@e-f.g.h. ", "1.2.3.4.5.6.7.8", "1.2.3.256.1.2.3.4", "01.002.0003.000255", "1..2.3.4", "4111 1111 1111 1111", "4111-1111 1111-1111 4111", "4111  1111 1111 1111",
    "+1 (743) 555-3824", "+1", "+12", "+123", "+1 (743) 555-3824 +44 20 7946 0958", "+1((((((((((2", "+1 234 567 890 123 456", "٤١١١ 1.2.3.4", "4111111111111111.", "x4111111111111111y", "+4111111111111111",
]


@pytest.mark.parametrize("text", ODD)
def test_base_patterns(text):
    assert [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in pii.base_spans(text)] == plain(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["@", ".", "a", "b-", "+", "1", "25", "255", "300", " ", "-", "(", ")", "4111111111111111", "é", "a@b.c", "1.2.3.4", "+1 743 555 3824"]), max_size=24).map("".join))
def test_any_mixture(text):
    assert [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in pii.base_spans(text)] == plain(text)
    assert [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e, base, _ in pii.candidates(text) if base] == plain(text)


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "1 " * 150_000, "+" * 300_000, "+1(" * 100_000, "a@" * 150_000, "@ " * 150_000, "(at)" * 75_000, "a" * 200_000 + "@b.c", "1.2.3.4 " * 20_000, "4111111111111111 " * 15_000])
def test_long_texts_take_linear_time(text):
    start = time.time()
    pii.candidates(text)
    assert time.time() - start < 20


def test_em_tells_reliable_labelers():
    rng = np.random.default_rng(1)
    n = 20_000
    truth = rng.random(n) < 0.4
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.6, 0.7])
    says = np.where(rng.random((n, 6)) < right, truth[:, None], ~truth[:, None])
    silent = rng.random((n, 6)) < 0.3
    code = ((says & ~silent) << np.arange(6)).sum(1) + ((~says & ~silent) << np.arange(6, 12)).sum(1)
    votes, at, count = np.unique(code, return_inverse=True, return_counts=True)
    p, rate = pii.em(votes, count.astype(float))
    assert np.abs(rate.sum(2) - 1).max() < 0.01
    got = rate[0, :, 0] / (rate[0, :, 0] + rate[0, :, 1])
    assert np.abs(got - right).max() < 0.03
    assert ((p[at] > 0.5) == truth).mean() > 0.93


def luhn_of(rng, lead):
    body = lead + "".join(map(str, rng.integers(0, 10, 15 - len(lead))))
    return next(body + str(i) for i in range(10) if check_digit(body + str(i)))


def corpus():
    """Texts with base spans, further ones (planted) and decoys."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    texts, planted, clean = [], {}, []
    for i in range(600):
        base = {0: f"{word()}@{word()}.com", 1: ".".join(map(str, rng.integers(1, 220, 4))), 2: luhn_of(rng, "4"), 3: f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"}[i % 4]
        cue = {0: "mail", 1: "host", 2: "card", 3: "phone"}[i % 4] if i % 3 else word()
        texts.append(f"{word()} {word()} {cue} {base} {word()}")
    for i in range(120):
        more = {0: f"phone ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}", 1: f"mail {word()} (at) {word()} (dot) com", 2: f"card {luhn_of(rng, '51')} {rng.integers(10**15, 10**16)}"}[i % 3]
        planted[len(texts)] = more
        texts.append(f"{word()} {word()} {more} {word()}")
    for i in range(300):
        number = str(rng.integers(10**15, 10**16))
        if check_digit(number):
            number = number[:-1] + str((int(number[-1]) + 1) % 10)
        decoy = {0: number, 1: f"version {rng.integers(1, 9)}.{rng.integers(0, 9)}", 2: 'token = "' + hashlib.sha1(number.encode()).hexdigest() + '"', 3: f"page {rng.integers(1000, 9999)}"}[i % 4]
        clean.append(len(texts))
        texts.append(f"{word()} {word()} {decoy} {word()}")
    return texts, planted, clean


def test_spans_are_added_and_decoys_left(spark, docs_of):
    texts, planted, clean = corpus()
    rows = {r.doc_id: r for r in pii.find(spark, docs_of(texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        base = plain(text)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(filter(None, rows[i].spans.split(",")))
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(k) for x in base) for k in pii.KINDS]
    assert all(rows[i].spans == ",".join(plain(texts[i])) for i in clean)
    found = sum(rows[i].spans != ",".join(plain(texts[i])) for i in planted)
    assert found >= 0.9 * len(planted)
    model = pii.fit(pii.propose(spark, docs_of(texts)))
    table = {(r.kind, r.labeler): (r.yes_if_true, r.yes_if_false) for r in pii.reliabilities(spark, model).collect()}
    assert table["card", "check"][0] > 0.9 > table["card", "check"][1]


def test_result_does_not_hang_on_partitions(spark, docs_of):
    texts = corpus()[0]
    one, many = ({r.doc_id: r.spans for r in pii.find(spark, docs_of(texts, parts)).collect()} for parts in (1, 7))
    assert one == many


def test_odd_rows(spark, docs_of):
    texts = [None, "", "x " * 200_000 + "a@b.cd", (5, "a@b.cd"), (5, "a@b.cd"), (None, "1.2.3.4"), "tie 4111111111111111 4111111111111111"]
    rows = pii.find(spark, docs_of(texts)).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    empty = hashlib.sha256(b"").hexdigest()
    assert by[0][0].base_sha256 == by[1][0].base_sha256 == empty and by[0][0].spans == ""
    assert by[2][0].spans == "email:400000:400006" and [r.n_email for r in by[5]] == [1, 1] and by[None][0].n_ip == 1
    none = pii.find(spark, docs_of(["x"]).where("false"))
    assert none.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"] and none.count() == 0
    assert pii.find(spark, docs_of(["no data here", None])).count() == 2


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in pii.find(spark, docs).collect()}
    for r in docs.collect():
        base = plain(r.text or "")
        assert rows[r.doc_id].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(filter(None, rows[r.doc_id].spans.split(",")))
