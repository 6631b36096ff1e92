import random

import xxhash

from tidewater.llm import simhash


def slow(text, k=3):
    w = (text or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hs) > len(hs))


def groups(fps):
    """component (least position) by comparing all."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_groups_match_brute_force(spark, sf, docs_of):
    base = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()][:120]
    rng = random.Random(1)
    for t in base[:60]:
        w = t.split()
        w[rng.randrange(len(w))] = "other"
        base.append(" ".join(w))
    base += [base[0]] * 30 + [None, "", " \n", "one", "ONE", "two words", "é É", "a\x0bb\x0cc d"]
    got = simhash.simhash_groups(spark, docs_of(base)).toPandas().sort_values("doc_id")
    fps = [slow(t) for t in base]
    assert [int(x, 16) for x in got.fingerprint] == fps
    assert got.component_id.tolist() == groups(fps)


def test_chains_join_and_a_large_bucket_loses_no_link(spark):
    from tidewater.llm.common import Scratch

    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 400:  # a cloud around one centre, and its chains outwards
        x = rng.choice(sorted(fps))
        for b in rng.sample(range(64), rng.choice([1, 3, 4])):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = groups(fps)

    def parts(most):
        old, simhash.BUCKET_MOST = simhash.BUCKET_MOST, most
        try:
            from pyspark.sql import functions as F

            from tidewater.llm.common import components

            s = Scratch(spark)
            found = simhash.links(spark, spark.createDataFrame([(x,) for x in signed], "f0 long"), s, 3, 1, 32)
            rows = components(spark, found.select(F.col("a0").alias("a"), F.col("b0").alias("b")), s).collect()
        finally:
            simhash.BUCKET_MOST = old
        root = {r.node: r.root for r in rows}
        return {tuple(sorted(i for i, y in enumerate(signed) if root.get(y, y) == g)) for g in {root.get(x, x) for x in signed}}

    expect = {tuple(i for i, w in enumerate(want) if w == g) for g in set(want)}
    assert parts(4096) == expect  # compared in buckets
    assert parts(8) == expect  # whole balls


def test_empty_table(spark, docs_of):
    assert simhash.simhash_groups(spark, docs_of(["x"]).where("false")).count() == 0
