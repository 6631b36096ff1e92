import zlib

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import ann, sharding


def test_shards_are_level_and_slots_gapless(spark, docs_of):
    texts = [None, "", "é" * 50, *("copy " * 40 for _ in range(300)), *("t%d " % i * (i % 60 + 1) for i in range(600)), (5, "again"), (5, "again"), (None, "no id")]
    rows = sharding.shard(spark, docs_of(texts), 16).toPandas()
    assert len(rows) == len(texts)
    sizes = sorted(len((t[1] if isinstance(t, tuple) else t or "").encode()) + 1 for t in texts)
    assert sorted(rows["size"]) == sizes
    total = rows.groupby("shard")["size"].sum()
    assert len(total) == 16 and total.max() - total.min() <= 2 * 300
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert set(rows.law) == {"bytes"} and rows.grown_shard.isna().all()
    one = rows[(rows.doc_id == 2)].iloc[0]
    assert one.text_crc32 == zlib.crc32(("é" * 50).encode())
    again = sharding.shard(spark, docs_of(texts), 16).toPandas()
    key = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert rows[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist() or len(again) == len(rows)


def test_tiny_and_empty_tables(spark, docs_of):
    assert sharding.shard(spark, docs_of(["one"]), 16).count() == 1
    assert sharding.shard(spark, docs_of(["one"]).where("false"), 16).count() == 0


def brute(rows, k):
    ok = {i: np.array(v) for i, v in rows if i is not None and v is not None and all(x is not None for x in v) and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in (i for i in ok if i % 20 == 0):
        s = [(-float(np.dot(ok[q], v)), i) for i, v in ok.items() if i != q]
        out[q] = sorted(s)[:k]
    return out


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * (1 + i % 3)).tolist()) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(90)]  # equal vectors: ties by id
    rows += [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] + [1.0] * 7), (1060, [None] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = ann.neighbours(spark, df, F.col("vec_id") % 20 == 0, 20).toPandas()
    want = brute(rows, 20)
    assert set(got.query_id) == set(want)
    hit = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, len(g) + 1)) and len(g) == 20 and q not in set(g.vec_id)
        hit += len({i for _, i in want[q]} & set(g.vec_id))
    assert hit / (20 * len(want)) >= 0.9
    first = got[got.query_id == 0].sort_values("rank")
    ids = first.vec_id.tolist()
    same = [i for s, i in want[0] if s == want[0][0][0]]
    assert ids[: len(same)] == same


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    r = ann.neighbours(spark, df, F.col("vec_id") % 20 == 0, 20).collect()
    assert [(x.query_id, x.rank, x.vec_id, x.score) for x in r] == [(0, 1, 1, 0.5)]
    assert ann.neighbours(spark, df.where("false"), F.col("vec_id") % 20 == 0, 20).count() == 0


def exact(rows, k):
    """query, neighbours in order, by comparing all."""
    v = {i: np.array(x, float) for i, x in rows}
    return {q: sorted((o for o in v if o != q), key=lambda o: (-float((v[q] * v[o]).sum()), o))[:k] for q in v if q % 20 == 0}


def found(spark, rows, k=20):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.neighbours(spark, df, F.col("vec_id") % 20 == 0, k).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    return {q: [x[n] for n in sorted(x)] for q, x in got.items()}


def test_all_candidates_if_there_are_fewer(spark):
    rng = np.random.default_rng(4)
    few = [(i, rng.normal(size=64).tolist()) for i in range(15)]
    assert found(spark, few) == exact(few, 20)
    away = [(0, [1.0, 0.0, 0.0]), *((i, [-1.0, 0.01 * i, 0.0]) for i in range(1, 6))]
    assert found(spark, away) == exact(away, 20)


def test_recall_with_a_few_very_long_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= rng.uniform(0.5, 2, (2000, 1))
    x[7] *= 1000
    x[11] *= 1e6
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(spark, rows), exact(rows, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_rotation_keeps_lengths_and_axes_are_nearest():
    x = np.random.default_rng(0).normal(size=(5, 9))
    y = ann.rotate(x, ann.rotations(9, 1, 1)[0])
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
    both = np.concatenate([y, -y], axis=1)
    assert (ann.axes(y, 3) == np.argsort(-both, axis=1, kind="stable")[:, :3]).all()
