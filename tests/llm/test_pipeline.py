import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import simhash


def near_groups(texts, k=5, least=0.8):
    sets = [simhash.shingles((t or "").encode(), k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= least * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in range(len(texts)) if find(i) == i}


def test_one_of_each_group_of_near_copies_stays(spark, docs_of):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 300))) for _ in range(60)]
    texts = list(base)
    for t in base[:40]:
        for _ in range(3):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [base[50]] * 40 + [None, "", "  "]
    docs = docs_of(texts)
    got = simhash.keep_one(spark, docs)
    kept = {r.doc_id for r in got.collect()}
    want = near_groups(texts)
    assert got.columns == docs.columns
    assert set(range(60)) <= kept and len(kept ^ want) <= 0.02 * len(texts)
    assert simhash.keep_one(spark, docs.where("false")).count() == 0
    assert simhash.keep_one(spark, docs_of([(1, "same row"), (1, "same row"), (None, "same row")])).count() == 1


def test_stages_pass_on_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert sorted(out.columns) == sorted(docs.columns), name
        out = spark.createDataFrame(out.toArrow(), docs.schema)
        assert 0 < out.count() <= n
        docs, n = out, out.count()
    last = corpus_pipeline.run(spark, sf).toPandas()
    assert set(last.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert last.groupby("sequence_id").length.sum().max() <= 2048


def kept_ids(spark, docs_of, texts):
    return {r.doc_id for r in simhash.keep_one(spark, docs_of(texts)).collect()}


def test_near_copies_around_a_loose_centre_are_found(spark, docs_of):
    rng = random.Random(8)
    centre = [f"c{i}" for i in range(200)]
    texts = [" ".join(centre)]
    for i in range(100):  # 200 texts: pairs of near copies, each about 0.6 like the centre
        w = list(centre)
        at = 2 * (i % 50)
        w[at : at + 45] = [f"p{i}x{j}" for j in range(45)]
        texts.append(" ".join(w))
        w[rng.randrange(160, 200)] = f"odd{i}"
        texts.append(" ".join(w))
    want = near_groups(texts)
    assert len(want) == 101
    assert kept_ids(spark, docs_of, texts) == want


def test_pairs_just_above_the_limit_all_meet(spark, docs_of):
    rng = random.Random(9)
    texts = []
    for g in range(150):
        w = [f"g{g}w{rng.randrange(10**6)}" for _ in range(200)]
        texts.append(" ".join(w))
        for at in rng.sample(range(10, 190, 9), 4):  # 0.8 to 0.85
            w[at] = f"new{g}x{at}"
        texts.append(" ".join(w))
    want = near_groups(texts)
    assert len(want) == 150
    assert kept_ids(spark, docs_of, texts) == want
    body, line = " ".join(f"b{i}" for i in range(300)), " ".join(f"b{i}" for i in range(10, 20))
    assert kept_ids(spark, docs_of, [body, body + (" " + line) * 100]) == {0}  # a line that repeats is one set of shingles


def test_texts_that_share_an_identity_are_told_apart(spark, docs_of, monkeypatch):
    monkeypatch.setattr(simhash, "_identity", lambda text: F.length(text).cast("long"))
    texts = ["one two three four five six", "six five four three two one", "seven", "eight", "seven", None, ""]
    assert kept_ids(spark, docs_of, texts) == near_groups(texts) == {0, 1, 2, 3, 5}


def test_balls_find_near_copies_before_the_exact_pass(spark, docs_of, monkeypatch):
    rng = random.Random(11)
    texts = []
    for g in range(40):
        w = [f"g{g}w{rng.randrange(10**6)}" for _ in range(400)]
        texts += [" ".join(w), " ".join([*w[:-1], "other"])]
    texts += ["two words", "other words"]

    def nothing(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    monkeypatch.setattr(simhash, "_meeting", lambda least: nothing)
    assert kept_ids(spark, docs_of, texts) == near_groups(texts) == {*range(0, 80, 2), 80, 81}


def alike(n, rng):
    """Texts around one, near each other or just not."""
    base, out = [f"b{i}" for i in range(200)], []
    for i in range(n):
        w, at, long = list(base), rng.randrange(190), rng.randint(6, 10)
        w[at : at + long] = [f"own{i}x{j}" for j in range(long)]
        out.append(" ".join(w))
    return out


def test_texts_that_share_many_shingles_meet_once(spark, docs_of, monkeypatch):
    made, keep, distinct = [], simhash.Scratch.keep, type(spark.range(0)).distinct

    def counted(df):
        if df.columns == ["a", "b"]:
            made.append([df.count(), distinct(df).count()])
        return distinct(df)

    def kept(self, df, name="t"):
        if name == "pairs":
            made[-1].append("crossing")
        return keep(self, df, name)

    monkeypatch.setattr(type(spark.range(0)), "distinct", counted)
    monkeypatch.setattr(simhash.Scratch, "keep", kept)
    texts = alike(80, random.Random(12))
    assert kept_ids(spark, docs_of, texts) == near_groups(texts)
    rows, pairs = np.array([x[:2] for x in made if x[2:]]).sum(axis=0)
    assert 0 < pairs <= rows <= 1.5 * pairs


def test_pairs_that_meet_once_are_all_there(spark, docs_of, monkeypatch):
    rng = random.Random(13)
    texts = alike(60, rng) + [" ".join(rng.sample(t.split(), 60)) for t in alike(5, rng)]
    want = near_groups(texts)
    monkeypatch.setattr(simhash, "BUCKET_FEW", 2)
    for rounds, earlier in ((0, 8), (6, 1)):
        monkeypatch.setattr(simhash, "ROUNDS", rounds)
        monkeypatch.setattr(simhash, "EARLIER", earlier)
        monkeypatch.setattr(simhash, "PAIRS_A_TASK", 1000)
        assert kept_ids(spark, docs_of, texts) == want


def test_maps_of_long_sets_tell_them_apart():
    rng = np.random.default_rng(1)
    differ = lambda u, v: int(np.bitwise_count((u ^ v).view(np.uint64)).sum())
    for n in (40, 600, 3000, 50_000):
        h = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b, c = h[:n], h[n // 2 : n + n // 2], np.r_[h[: n - n // 20], h[n : n + n // 20]]
        most = 2 * n - 2 * np.ceil(0.8 / 1.8 * 2 * n - 1e-9)
        assert differ(simhash.parity(a), simhash.parity(b)) > most  # half in common
        assert differ(simhash.parity(a), simhash.parity(c)) <= 2 * (n // 20) <= most
    x, y = simhash.parity(h[:512]), simhash.parity(h[:513])
    assert 2 * len(x) == len(y) and differ(x, y[: len(x)] ^ y[len(x) :]) == 1


def test_near_copies_with_maps_of_unlike_sizes(spark, docs_of):
    texts = []
    for g in range(12):
        w = [f"g{g}w{i}" for i in range(616)]
        texts += [" ".join(w[:516]), " ".join(w), " ".join(w[:516] + w[:4] * 35)]
    want = near_groups(texts)
    assert len(want) == 12
    assert kept_ids(spark, docs_of, texts) == want
