"""Findings of the third round: names that clash, ties, copies of one place."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidewater import plans
from tidewater.operators import models as M
from tidewater.operators import places as P
from tidewater.streaming import streams as S


def test_thermal_features_have_their_own_water(spark, sf):
    assert plans.QUERIES["f18_thermal_features"](spark, sf).where("thermal_index IS NOT NULL").count() == 150


def test_scores_on_a_tie_are_those_of_the_sql(spark, tmp_path):
    """value * 0.01 + k * weight is 0.5, exactly or but for the last bit."""
    con = duckdb.connect()
    con.execute("""create table events as select i AS event_id, TIMESTAMP '2024-01-01' AS ts, u::BIGINT AS user_id, 'click' AS event_type, v::DOUBLE AS value, '{"k": ' || k || '}' AS props
        from (values (0, 1, 132.0, 41), (1, 6, 164.0, 57), (2, 0, 190.0, 35), (3, 1, 188.0, 69), (4, 3, 10.0, 20), (5, 2, 50.0, 9), (6, 4, 200.0, 1)) t(i, u, v, k)""")
    con.execute(f"copy events to '{tmp_path}/events.parquet'")
    got = plans.QUERIES["m11_score_per_user"](spark, str(tmp_path)).select("event_id", "account", "prediction").collect()
    want = con.execute("select event_id, account, prediction from (" + plans.SQL["m11_score_per_user"] + ")").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def crowd(spark, points=50, sites=40):
    """Two places of points and two of sites, with many of them at each."""
    p = spark.range(2 * points).select(F.col("id").alias("point_id"), (F.col("id") % 2).cast("double").alias("lon"), F.lit(0.0).alias("lat"))
    s = spark.range(2 * sites).select(F.col("id").alias("site_id"), (F.col("id") % 2 + 0.001).alias("site_lon"), F.lit(0.0).alias("site_lat"), F.lit(0.5).alias("area"), F.when(F.col("id") % 4 < 2, 8.0).alias("height"))
    return p, s


def test_points_and_sites_at_one_place_are_compared_once(spark, monkeypatch):
    p, s = crowd(spark)
    assert P._near_places(p, s, 0.005).count() == 2
    want = {(i, j) for i in range(100) for j in range(80) if i % 2 == j % 2}
    for most in (2**26, 300):  # whole, and dealt over several tasks
        monkeypatch.setattr(P, "PAIRS_A_CUT", most)
        rows = P.radius_join(p, s, 0.005, 4).collect()
        assert len(rows) == len(want) and {(r.point_id, r.site_id) for r in rows} == want and {r.distance for r in rows} == {0.001}
    assert P.radius_join(p.withColumn("lat", F.lit(None).cast("double")), s, 0.005).count() == 0


def test_features_around_a_place_of_many_rows(spark):
    p, s = crowd(spark)
    p = p.unionByName(spark.createDataFrame([(1000, None, 0.0), (1001, 50.0, 0.0)], "point_id long, lon double, lat double"))
    b = {r.point_id: r for r in P.building_features(p, s, 500.0).collect()}
    assert len(b) == 102 and abs(b[7].density * 3.14159265 * 0.25 - 40) < 1e-6 and b[7].mean_height == 8.0
    assert b[1000].density == b[1001].density == 0.0
    n = {r.point_id: r for r in P.proximity_features(p, s, 0.0015).collect()}
    assert len(n) == 102 and n[7].n_near == 40 and abs(n[7].area_wide - 40 * 0.5 * 10_000) < 1e-6 and n[1000].nearest == 1.0 and n[1001].n_near == 0


def test_windows_are_made_once_a_pixel(spark):
    p = spark.range(60).select(F.col("id").alias("point_id"), (F.col("id") % 3 + 0.5).alias("lon"), F.lit(1.5).alias("lat"))
    raster = spark.range(16).select((F.col("id") / 4).cast("int").alias("row"), (F.col("id") % 4).cast("int").alias("col"), F.col("id").cast("double").alias("v"))
    asked = []

    def figures(points):
        asked.append(points.count())
        return P.window_texture(P.raster_window(points, raster, 3, (0.0, 4.0, 1.0), (4, 4)), "v")

    got = {r.point_id: r[1:] for r in P.by_pixel(p, (0.0, 4.0, 1.0), figures).collect()}
    plain = {r.point_id: r[1:] for r in P.window_texture(P.raster_window(p, raster, 3, (0.0, 4.0, 1.0), (4, 4)), "v").collect()}
    assert asked == [3] and len(got) == 60 and got == plain


def test_users_are_fitted_alike_alone_and_side_by_side(spark):
    """In batches of many users, over tasks that a join has dealt by user before; each user once."""
    rng = np.random.default_rng(4)
    rows = [(f"{u}-{i}", f"u{u}", float(a), float(round(b)), int(a + b + rng.normal() > 0)) for u in range(60) for i in range(5 + 3 * u) for a, b in [rng.normal(size=2)]]
    df = spark.createDataFrame(rows, "id string, user string, a double, b double, y int")
    by_user = df.join(df.groupBy("user").agg(F.max("id").alias("_m")).hint("merge"), "user").drop("_m")
    models = lambda d: sorted(M.choose_per_user(d, "id", "user", ["a", "b"], "y").collect())
    got = models(by_user)
    assert len(got) == 60 == len({r.user for r in got})
    for u in ("u0", "u17", "u59"):
        assert models(df.where(F.col("user") == u)) == [r for r in got if r.user == u]
    x, y = (np.array([[r[j] for j in c] for r in rows if r[1] == "u59"], float) for c in ((2, 3), (4,)))
    _, bias = M._logistic(x[None], y.T, np.ones((1, len(x)), bool))
    z, w = np.c_[x, np.ones(len(x))], np.zeros(3)
    for _ in range(15):  # one user, as plain as can be
        p = 1 / (1 + np.exp(-(z @ w)))
        w += np.linalg.solve((z.T * (p * (1 - p) + 1e-6)) @ z + 0.1 * np.eye(3), z.T @ (y[:, 0] - p) - 0.1 * w)
    assert abs(bias[0] - w[2]) < 1e-9


def test_users_of_many_rows_are_fitted_from_all_of_them(spark, monkeypatch):
    """In blocks over tasks as in one task: the same models and the same metrics, in one group of users or more."""
    rng = np.random.default_rng(6)
    rows = []
    for u in range(6):
        for i in range(40 if u == 5 else 300 + 150 * u):
            a, b = rng.normal(size=2)
            y = [a + b + rng.normal() > 0, abs(a) < 0.7, a > 0.3, a > 0.3 or b < -1, rng.random() < 0.4, a > 0][u] != (rng.random() < 0.05)
            rows.append((f"{u}-{i}", f"u{u}", float(a), float(round(b, 1)), 3.0, int(y)))
    df = spark.createDataFrame(rows, "id string, user string, a double, b double, c double, y int")
    plain = {r.user: r for r in M.choose_per_user(df, "id", "user", ["a", "b", "c"], "y").collect()}
    monkeypatch.setattr(M, "LARGE_AT_ONCE", 3, raising=False)
    blocks = M.choose_per_user(df.repartition(7), "id", "user", ["a", "b", "c"], "y", most=100).cache()
    assert blocks.count() == 6
    for r in blocks.collect():
        want = plain[r.user]
        assert (r.n, r.n_unseen, r.chosen, r.feature) == (want.n, want.n_unseen, want.chosen, want.feature)
        assert r.n + r.n_unseen == (40 if r.user == "u5" else 300 + 150 * int(r.user[1]))
        for c in ("score", "precision", "recall", "f1", "weights", "bias", "squares", "linear", "base", "edge", "amount", "level"):
            assert np.allclose(r[c], want[c], rtol=1e-7, atol=1e-7), (r.user, c)
    every = M.choose_per_user(df.where("user = 'u0'"), "id", "user", ["a", "b", "c"], "y", most=100, unseen=1.0).first()
    assert (every.n, every.n_unseen) == (300, 0)  # held out all, so none


def test_the_driver_lists_some_files_at_a_time(spark, sf, monkeypatch):
    """And its plan names none of them afterwards; the rows are those of one part."""
    from tidewater.plans import sources

    listed = []
    plain = sources.io.read_files if hasattr(sources.io, "read_files") else None
    monkeypatch.setattr(sources.io, "read_files", lambda s, folder: (listed.append(plain(s, folder)), listed[-1])[1], raising=False)
    want = sorted((r.page_id, r.page_id % 10, len((r.html or "").encode())) for r in spark.read.parquet(f"{sf}/pages.parquet").collect())
    monkeypatch.setattr(sources, "FILES_AT_ONCE", 10, raising=False)
    got = plans.QUERIES["s6_read_labelled_files"](spark, sf)
    assert not [f for f in got.inputFiles() if "/page=" in f]
    assert sorted(got.collect()) == want
    pages = [len([f for f in x.inputFiles() if "/page=" in f]) for x in listed]
    assert sum(pages) == len(want) and len(pages) == -(-len(want) // 10) and max(pages) < len(want)


def test_sliding_windows_from_panes(spark):
    rows = [(u, f"2024-01-01 {i % 3:02d}:{(i * 7) % 60:02d}:01") for u in (1, 2) for i in range(40)]
    e = spark.createDataFrame(rows, "u int, t string").select("u", F.col("t").cast("timestamp").alias("ts"))
    panes = S.stream_counts(e, "ts", "u", "15 minutes")
    assert panes.count() <= 2 * 12
    got, want = S.sliding_counts(panes, "u", 3600, 900), S.stream_counts(e, "ts", "u", "1 hour", "15 minutes")
    assert sorted(got.select("u", "start", "end", "n").collect()) == sorted(want.select("u", "start", "end", "n").collect())
