import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import ann


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    """All have length 1 up to rounding; rows of 32-bit numbers fall to both sides of it."""
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    local = rows.orderBy("vec_id").toPandas()
    ids, x = local.vec_id.to_numpy(), np.stack(local.embedding.to_numpy()).astype(float)
    got = {}
    for r in ann.neighbours(spark, rows, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = np.flatnonzero(ids % 20 == 0)
    assert set(got) == set(ids[asked].tolist())
    recall = []
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        found = sorted(got[ids[q]])
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(a[2] >= b[2] for a, b in zip(found, found[1:]))
        recall.append(len(want & {v for _, v, _ in found}) / 20)
    print(sf, np.mean(recall), min(recall))
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.8


def test_hot_buckets_are_cut_on_both_sides(spark, monkeypatch):
    """A crowd of near equal vectors that all ask: parts of queries meet blocks of vectors, with the same result."""
    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(size=16) + rng.normal(size=(300, 16)) * 1e-3, rng.normal(size=(100, 16))]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, ann.neighbours(spark, df, F.lit(True), k=3).collect()))
    monkeypatch.setattr(ann, "BLOCK", 32)
    monkeypatch.setattr(ann, "ASKS", 16)
    assert sorted(map(tuple, ann.neighbours(spark, df, F.lit(True), k=3).collect())) == whole
