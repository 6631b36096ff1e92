"""Rules stated by hand, row in and label out, apart from the SQL of the queries."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import expressions as X
from tidewater.operators import logs as L
from tidewater.operators import measures as M
from tidewater.operators import models as ML
from tidewater.operators import places as P
from tidewater.operators import records as R


def test_cases(spark):
    rows = [
        (True, False, 0.0, "Case 1"), (False, True, 0.0, "Case 2"), (True, True, 0.0, "Case 3"), (False, False, 0.4, "Case 4"),
        (True, False, 0.4, "Case 5"), (False, True, 0.4, "Case 6"), (False, False, 0.0, "Case 7"), (True, True, 0.4, "Normal"),
    ]
    df = spark.createDataFrame(rows, "d boolean, h boolean, f double, want string")
    assert df.where(X.anomaly_case(F.col("d"), F.col("h"), F.col("f")) != F.col("want")).count() == 0


def test_alerts_and_what_follows(spark):
    rows = [
        (1, 12.0, 0.81, "HIGH : Call 911", "critical"), (2, 11.9, 0.9, "MIDDLE : Notify Doctor", "high"), (3, 100.0, 0.8, "MIDDLE : Notify Doctor", "high"), (4, 6.0, -2.0, "MIDDLE : Notify Doctor", "high"),
        (5, 3.0, 0.0, "LOW : Ping User", "moderate"), (6, 2.9, 0.99, "Normal Activity - No alerts", "low"), (7, 30.0, None, "MIDDLE : Notify Doctor", "high"),
    ]
    df = spark.createDataFrame(rows, "user_id int, hours double, deviation double, want string, cls string")
    a = df.withColumn("alert", X.guardian_alert(F.col("hours"), F.col("deviation")))
    assert a.where("alert <> want").count() == 0 and a.where(X.alert_class(F.col("alert")) != F.col("cls")).count() == 0
    assert tuple(R.alert_summary(a).first()) == (1, 4, 1, 6, 7)
    got = {r.user_id: (r.severity, r.type, r.recipient, r.contact, r.description, str(r.follow_up_at)) for r in R.interventions(a, "2024-01-01 00:00:00").collect()}
    high = ("high", "doctor_notification", "doctor", "email", "Automated intervention for MIDDLE : Notify Doctor", "2024-01-02 00:00:00")
    assert got == {1: ("emergency", "emergency_call", "emergency", "phone", "Automated intervention for HIGH : Call 911", "2024-01-02 00:00:00"), 2: high, 3: high, 4: high, 7: high}
    m = {r.user_id: r.message for r in R.render_message(a.withColumn("patient", F.lit("Ann")).withColumn("caregiver", F.lit("Bo"))).collect()}
    assert m[1].greeting == "Dear Bo, we need your immediate attention regarding Ann." and len(m[1].actions) == 5 and m[1].contacts[0].number == "911"
    assert m[2].summary.startswith("Ann has been inactive for 11 hours and their activity level has decreased by 90%")
    assert m[5].actions[0].startswith("Give Ann a friendly call") and len(m[5].contacts) == 3 and len(m[5].resources) == 3
    assert m[6].greeting == "Hello Bo, here's a routine update about Ann." and "0% less" not in m[6].summary and " 0% less" in m[6].summary.replace("99%", "0%")


def test_severity_and_tiers(spark):
    rows = [(80.0, 0.9, "CRITICAL"), (72.0, 0.9, "HIGH"), (1.0, 0.61, "HIGH"), (49.0, 0.0, "HIGH"), (25.0, 0.0, "MODERATE"), (0.0, 0.41, "MODERATE"), (24.0, 0.4, "LOW"), (49.0, None, "HIGH")]
    df = spark.createDataFrame(rows, "h double, d double, want string")
    assert df.where(X.clinical_severity(F.col("h"), F.col("d")) != F.col("want")).count() == 0
    c = {r.p: r for r in R.churn_report(spark.createDataFrame([(0.71,), (0.7,), (0.4,)], "p double"), "p", {"a": 0.1, "b": 0.5, "c": 0.2, "d": 0.2}).collect()}
    assert [len(c[p].recommendations) for p in (0.71, 0.7, 0.4)] == [3, 3, 2] and c[0.4].recommendations == ["Continue monitoring", "Send weekly tips"]
    assert c[0.71].contributing_factors == ["b", "c", "d"] and c[0.4].confidence == 0.6


def test_logons_of_any_kind_count(spark):
    rows = [(1, "Unlock"), (2, "Privileged Logon"), (3, "Logon"), (4, "Lock")]
    j = spark.createDataFrame(rows, "event_id int, activity string").select(
        F.lit("a").alias("account"), F.lit("P").alias("host"), F.lit("2024-01-01 09:00:00").cast("timestamp").alias("unlock_time"), F.lit("2024-01-01 10:00:00").cast("timestamp").alias("lock_time"),
        F.lit("2024-01-01 09:30:00").cast("timestamp").alias("ts"), "activity", F.lit(None).cast("string").alias("details"),
    )
    prim = spark.createDataFrame([("a", "P")], "account string, primary_host string")
    assert L.activity_counters(j, prim).first().logon_own_normal == 3
    assert L.inject_default_logon(j.where("activity in ('Unlock', 'Lock')")).count() == 2
    for some in ("true", "activity = 'Lock'", "activity in ('Lock', 'Unlock')"):
        for host in ("P", "Q"):
            here = prim.withColumn("primary_host", F.lit(host))
            once = L.activity_counters(j.where(some), here, default_logon=True).collect()
            assert once == L.activity_counters(L.inject_default_logon(j.where(some)), here).collect() and len(once) == 1
    assert L.inject_default_logon(j.where("activity = 'Lock'")).where("activity = 'Logon' and ts = unlock_time").count() == 1


def test_weights(spark):
    rows = [(float(i), 0.0 if i % 2 else 1.0, 0.0) for i in range(101)]
    got = {int(r.y): r.weight for r in M.sample_weights(spark.createDataFrame(rows, "y double, a double, b double"), "y", ["a", "b"]).collect()}
    assert {i for i, w in got.items() if w == 4.0} == {*range(6), *range(95, 101)}
    assert set(got.values()) == {4.0, 0.5}  # over three quarters have no less variance than the others
    varied = [(float(i), float(i % 10), 0.0) for i in range(101)]
    got = {int(r.y): r.weight for r in M.sample_weights(spark.createDataFrame(varied, "y double, a double, b double"), "y", ["a", "b"]).collect()}
    limit = np.percentile([(i % 10) ** 2 / 4 for i in range(101)], 75)
    assert all(got[i] == (2.0 if (i % 10) ** 2 / 4 > limit else 0.5) for i in range(6, 95))


def test_sites_around_points(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0)], "point_id long, lon double, lat double")
    s = spark.createDataFrame([(1, 0.0005, 0.0, 2e-6, 10.0), (2, 0.0, 0.001, 3e-6, None), (3, 0.0, 0.002, 4e-6, 20.0)], "site_id long, site_lon double, site_lat double, area double, height double")
    near = {r.point_id: r for r in P.proximity_features(p, s).collect()}
    assert near[1].nearest == pytest.approx(0.05) and near[1].n_near == 1 and near[1].area_wide == pytest.approx(0.05)
    assert near[2].n_near == 0 and near[2].area_wide == 0.0 and near[2].nearest == pytest.approx(100 * math.hypot(5.0, 4.998))
    assert P.proximity_features(p, s.where("false")).first().nearest == 1.0
    b = {r.point_id: r for r in P.building_features(p, s, 500.0).collect()}
    assert b[1].density == pytest.approx(3 / (math.pi * 0.25)) and b[1].mean_height == 15.0 and b[2].mean_height == 0.0
    assert P.building_features(p, s.drop("height")).where("point_id = 1").first().mean_height == 10.0


def test_between_two_hot_places(spark):
    hot = [("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 9.0, 9.0)]
    p = spark.createDataFrame([(1, 0.5, 0.1), (2, -0.5, 0.0), (3, 0.5, 0.6), (4, 0.0, 0.0)], "point_id long, lon double, lat double")
    got = {r.point_id: r for r in P.thermal_features(p, hot, [("g", 0.5, 1.0)], [("w", 3.0, 3.0)]).collect()}
    assert [got[i].between_hot for i in (1, 2, 3, 4)] == [1, 0, 0, 0]
    assert got[4].hot_1km == 1 and got[4].cool_heat_ratio == pytest.approx(124.3, abs=0.3)  # no heat distance to divide by


def test_windows_move_inside_at_the_upper_left(spark):
    pix = spark.createDataFrame([(r, c, float(r * 6 + c)) for r in range(6) for c in range(6) if (r, c) != (0, 1)], "row int, col int, v double")
    pts = spark.createDataFrame([(1, 0.5, 5.5), (2, 5.5, 0.5), (3, 2.5, 3.5)], "point_id long, lon double, lat double")
    w = P.raster_window(pts, pix, 3, (0.0, 6.0, 1.0), (6, 6))
    cells = {i: {(r.row, r.col): r.v for r in w.where(f"point_id = {i}").collect()} for i in (1, 2, 3)}
    assert set(cells[1]) == {(r, c) for r in range(3) for c in range(3)} and cells[1][0, 1] == 0.0
    assert set(cells[2]) == {(4, 4), (4, 5), (5, 4), (5, 5)}
    assert P.sub_window(P.raster_window(pts, pix, 5, (0.0, 6.0, 1.0), (6, 6)), 3).select("point_id", "row", "col", "v").exceptAll(w.select("point_id", "row", "col", "v")).count() == 0
    d = {r.point_id: r for r in P.disc_stats(w, "v", 1).collect()}
    assert d[1].mean == pytest.approx((0 + 6 + 7 + 8 + 13) / 5) and d[2].mean == 0.0 and d[3].median == cells[3][2, 2]
    assert all(abs(x) < 1e-9 for x in P.texture(np.full((5, 5), 3.0))[:-1]) and P.texture(np.full((5, 5), 3.0))[-1] == 1.0


def test_nearest_by_brute_force(spark):
    rng = random.Random(5)
    crowd = [(i, 10 + rng.random() * 0.001, 50 + rng.random() * 0.001) for i in range(300)] + [(300 + i, 10.3, 50.3) for i in range(40)]
    sites = crowd + [(400 + i, rng.uniform(-180, 180), rng.uniform(-89, 89)) for i in range(30)]
    points = [(i, 10 + rng.random() * 0.4, 50 + rng.random() * 0.4) for i in range(60)] + [(60 + i, rng.uniform(-180, 180), rng.uniform(-89, 89)) for i in range(20)] + [(80, 10.3, 50.3), (81, 10.3, 50.3)]
    p = spark.createDataFrame(points, "point_id long, lon double, lat double")
    s = spark.createDataFrame(sites, "site_id long, site_lon double, site_lat double")
    for planar in (False, True):
        def far(a, b):
            if planar:
                return math.hypot(a[1] - b[1], a[2] - b[2])
            x, y, u, v = map(math.radians, (*a[1:], *b[1:]))
            return 12742 * math.asin(min(1, math.sqrt(math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2)))

        want = {(a[0], n + 1, b[0]) for a in points for n, b in enumerate(sorted(sites, key=lambda b: (far(a, b), b[0]))[:5])}
        assert {(r.point_id, r["rank"], r.site_id) for r in P.knn_join(p, s, 5, planar=planar).collect()} == want


@pytest.mark.parametrize("leaf,block", [(4096, 4096), (16, 20), (4, 7)])
def test_nearest_rows_by_brute_force(spark, leaf, block):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(150, 3)), np.repeat([[1.0, 2.0, 3.0]], 50, 0), 0.01 * rng.normal(size=(40, 3))])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(999, None, 0.0, 0.0), (998, float("inf"), 0.0, 0.0), (997, float("nan"), 0.0, 0.0)], "id long, a double, b double, c double")
    got = {}
    for r in P.knn_features(df, "id", ["a", "b", "c"], 4, leaf, block).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.neighbour
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert len(got) == len(x)
    for i in range(len(x)):
        assert [got[i][n] for n in (1, 2, 3, 4)] == sorted(range(len(x)), key=lambda j: (d[i, j], j))[:4]


def test_nearest_rows_meet_few_others():
    """Rows of four features meet about as many others at eight times the rows; one value in most of a column, ties."""
    rng, met = np.random.default_rng(3), []
    for n in (2_000, 16_000):
        y = rng.normal(size=(n, 4))
        tree = P._tree(y, 64)
        leaf = P._leaf(tree, y)
        low, high = (np.array([f(y[leaf == i], axis=0) for i in range(leaf.max() + 1)]) for f in (np.min, np.max))
        p, _, d = P._nearest(y, y, 5)
        assert (np.bincount(p) == 5).all() and leaf.max() + 1 == (tree[0] < 0).sum()
        met.append(sum(len(who) for who, _ in P._reached(tree, P._boxes(tree, low, high), y, d[4::5])) / n)
    assert met[1] < 1.5 * met[0] and met[1] < 16_000 / 64 / 10
    y = np.unique(np.where(rng.random((600, 3)) < 0.8, 0.0, rng.integers(0, 9, (600, 3))), axis=0)
    p, at, d = P._nearest(y, y, 5, most=8)
    far = np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2))
    for i in range(len(y)):
        assert list(at[p == i]) == sorted(range(len(y)), key=lambda j: (far[i, j], j))[:5]


def test_quantiles_in_rounds(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=30_000), np.full(20_000, 0.25), rng.lognormal(0, 9, 10_000)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double").repartition(8)
    qs = [0.0, 0.02, 0.25, 0.5, 0.61803, 0.98, 1.0]
    for most in (10**6, 500):
        assert M.quantiles(df, [("v", q) for q in qs], most) == pytest.approx(list(np.quantile(x, qs)), rel=1e-9)
    assert M.quantiles(df.where("false"), [("v", 0.5)]) == [None]


def test_running_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(float(i), int(n)) for i, n in zip(rng.permutation(500), rng.integers(0, 9, 500))]
    df = spark.createDataFrame(rows, "s double, n int")
    up = {r.s: r.t for r in M.running_sums(df, "s", {"t": "n"}, cuts=7).collect()}
    down = {r.s: r.t for r in M.running_sums(df, "s", {"t": "n"}, True, cuts=7).collect()}
    assert all(up[s] == sum(m for t, m in rows if t <= s) and down[s] == sum(m for t, m in rows if t >= s) for s, _ in rows)
    codes = M.label_encode(spark.createDataFrame([("b",), ("a",), (None,), ("ü",), ("b",)], "c string"), "c").collect()
    assert {(r.c, r.code) for r in codes} == {("a", 0), ("b", 1), ("ü", 2), (None, None)}


def test_stratified_split_has_exact_parts(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(1000)], "id long, c string")
    got = M.split_stratified(df, "id", "c", 0.2).groupBy("c").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    assert {(r.c, r.n, r.t) for r in got} == {("a", 666, 133), (None, 334, 66)}


def test_models_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2)) * [3.0, 1.0]
    y = x @ [1.5, -2.0] + 0.3 + np.where(np.arange(400) % 2, 1.0, -1.0) + 0.01 * rng.normal(size=400)
    df = spark.createDataFrame([(i, float(a), float(b), float(c), "odd" if i % 2 else "even") for i, ((a, b), c) in enumerate(zip(x, y))], "id long, a double, b double, y double, r string")
    got = {r.id: r.p for r in ML.regional_predict(df, df, ["a", "b"], "y", "r").collect()}
    z = np.c_[x, np.ones(400)]
    solve = lambda m: np.linalg.solve(z[m].T @ z[m] + 1e-3 * np.eye(3), z[m].T @ y[m])
    part = [solve(np.arange(400) % 2 == i) for i in (0, 1)]
    every = solve(np.ones(400, bool))
    assert all(got[i] == pytest.approx(0.7 * z[i] @ part[i % 2] + 0.3 * z[i] @ every, abs=1e-6) for i in range(400))
    comp = {r.id: r.components for r in ML.pca_reduce(df, ["a", "b"], 0.5).collect()}
    first = np.linalg.svd(x - x.mean(axis=0))[2][0]
    assert len(comp[0]) == 1 and all(abs(comp[i][0]) == pytest.approx(abs(x[i] @ first), abs=1e-6) for i in range(400))
    clusters = spark.createDataFrame([(i, float(i % 4) * 10 + 0.01 * (i % 7), 0.0) for i in range(200)], "id int, a double, b double")
    seen = ML.cluster_points(clusters, ["a", "b"], 4).groupBy("cluster").agg(F.count_distinct(F.col("id") % 4).alias("kinds")).collect()
    assert len(seen) == 4 and {r.kinds for r in seen} == {1}
    w = ML.fit_per_user(df.withColumn("t", (F.col("y") > 0).cast("int")), "id", "r", ["a", "b"], "t").collect()
    for r in w:
        m = np.arange(400) % 2 == (r.r == "odd")
        s, t = x[m].std(axis=0), (y[m] > 0).astype(float)
        p = 1 / (1 + np.exp(-(x[m] @ np.array(r.weights) + r.bias)))
        slope = ((x[m] - x[m].mean(axis=0)) / s).T @ (t - p) - 0.1 * np.array(r.weights) * s
        assert r.n == 200 and np.abs(slope).max() < 1e-3  # the penalised likelihood is at its top
    folds = ML.fit_regressor(df, "id", ["a", "b"], "y", "linear", 3).collect()
    assert all(r.r2 > 0.9 for r in folds)
    stacked = ML.stack_predict(df.where("id % 5 <> 0"), df.where("id % 5 = 0"), "id", ["a", "b"], "y").collect()
    assert np.corrcoef([r.y for r in stacked], [r.p for r in stacked])[0, 1] > 0.95


# -- synthetic rows, augmentation, quantile mapping, draws


def test_scenarios_come_back_as_their_case(spark, sf):
    """Every realised row, run through the profile of its account, is of the case that its scenario names."""
    from tidewater.operators import models as ML
    from tidewater.plans.fixtures import access_events

    e = access_events(spark, sf)
    days, hours, hosts = L.weekday_class(L.day_profile(e)), L.hour_profile(e), L.host_profile(e)
    made = ML.synthesize_anomalies(e, hours, days, 3)
    rows = L.working_hour(L.working_day(made, days).drop("day"), hours).join(hosts, ["account", "host"], "left").fillna(0.0, ["freq"])
    got = rows.select("event_id", "scenario", "realised", X.anomaly_case(F.col("working_day"), F.col("working_hour"), F.col("freq")).alias("case")).collect()
    assert len(got) == e.count() and sum(r.realised for r in got) > 0.7 * len(got)
    assert all(r["case"] == f"Case {r.scenario}" for r in got if r.realised)
    assert {r.scenario for r in got if r.realised} == set(range(1, 8))
    again = {r.event_id: r for r in ML.synthesize_anomalies(e.repartition(3), hours, days, 3).collect()}
    assert all(again[r.event_id] == r for r in made.collect())
    span = {r.account: (r.a, r.b) for r in e.groupBy("account").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b")).collect()}
    assert all(span[r.account][0] <= r.ts.date() <= span[r.account][1] and r.unlocks + r.locks == 1 for r in again.values())
    both = ML.with_anomalies(e, 3)
    assert both.groupBy("target").count().orderBy("target").collect() == [(0, e.count()), (1, e.count())]


def test_scenarios_of_odd_accounts(spark):
    """Two weeks of mornings, one row, and rows without account or host."""
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1, 9)  # a Monday
    rows = [(i, "a", "PC1", t0 + dt.timedelta(days=i % 14, hours=i // 14 % 3), "Unlock") for i in range(70) if i % 7 < 5 or i < 14]
    rows += [(900, "one", "PC2", t0, "Lock"), (901, None, "PC3", t0, "Lock"), (902, "none", None, t0, None)]
    e = spark.createDataFrame(rows, "event_id long, account string, host string, ts timestamp, activity string")
    made = {r.event_id: r for r in ML.synthesize_anomalies(e, L.hour_profile(e), L.weekday_class(L.day_profile(e)), 1).collect()}
    assert set(made) == {r[0] for r in rows} - {901}
    for r in made.values():
        if r.account == "a" and r.realised:
            work = r.ts.weekday() < 5  # from 9 to 11; at weekends 9 only
            assert work == (r.scenario in (1, 3, 5)) and (9 <= r.ts.hour <= (11 if work else 9)) == (r.scenario in (2, 3, 6))
            assert (r.host == "PC1") == (r.scenario in (4, 5, 6)) and r.unlocks == 1
    assert sum(r.realised for r in made.values() if r.account == "a") > 40
    assert made[900].ts.date() == t0.date() and made[902].host.startswith("NEW")
    empty = e.where("false")
    assert ML.with_anomalies(empty).count() == 0


def test_beta_weights_and_normals(spark):
    df = spark.range(20_000).select(M.beta_variate(0.5, 0.5, 1, "id").alias("a"), M.beta_variate(0.4, 0.4, 2, "id").alias("b"), M.beta_variate(0.3, 0.9, 2, "id").alias("c"), M.normal_variate(3, "id").alias("z"), M.uniform(4, "id").alias("u")).toPandas()
    for name, a, b in (("a", 0.5, 0.5), ("b", 0.4, 0.4), ("c", 0.3, 0.9)):
        mean, var = a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))
        assert abs(df[name].mean() - mean) < 0.01 and abs(df[name].var() - var) < 0.005 and df[name].between(0, 1).all()
    assert abs(np.quantile(df.a, 0.25) - np.sin(np.pi / 8) ** 2) < 0.01  # the arcsine law
    assert abs(df.z.mean()) < 0.03 and abs(df.z.std() - 1) < 0.02 and abs(df.u.mean() - 0.5) < 0.01


def test_new_rows_lie_between_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2))
    x[10] = x[11]
    y = x.sum(axis=1)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id long, p double, q double, y double")
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    near = np.argsort(apart, axis=1, kind="stable")[:, :4]
    out = ML.augment(df, "id", ["p", "q"], "y", "mixup", 6).collect()
    assert len(out) == 360
    for r in out:
        assert r.neighbour in near[r.id]
        assert np.allclose([r.p, r.q], r.share * x[r.id] + (1 - r.share) * x[r.neighbour]) and np.isclose(r.y, r.share * y[r.id] + (1 - r.share) * y[r.neighbour])
    assert {r.neighbour for r in out if r.id == 5} >= set(near[5][:2])
    low, high = np.quantile(y, [0.1, 0.9])
    tails = set(np.flatnonzero((y <= low) | (y >= high)).tolist())
    out = ML.augment(df, "id", ["p", "q"], "y", "extremes", 2).collect()
    assert {r.id for r in out} == tails and {r.neighbour for r in out} <= tails
    assert all(np.allclose([r.p, r.q], r.share * x[r.id] + (1 - r.share) * x[r.neighbour], atol=0.003) for r in out)
    with pytest.raises(ValueError):
        ML.augment(df, "id", ["p"], "y", "other")


def test_quantile_normal(spark):
    """Against numpy's quantiles and interpolation, and the standard library's normal quantile."""
    from statistics import NormalDist

    rng = np.random.default_rng(3)
    train = np.r_[np.repeat(1.0, 400), rng.exponential(size=2600), np.repeat(7.5, 100)].round(3)
    test = np.r_[train[:300], -1.0, 100.0, 1.0, 1.0005, 7.5, train.min(), train.max()]
    frame = lambda v: spark.createDataFrame([(i, float(a)) for i, a in enumerate(v)], "id long, v double")
    marks = M.landmarks(frame(train), "v", 1000)
    assert np.allclose(marks, np.quantile(train, np.linspace(0, 1, 1000)), atol=1e-12)
    refs = np.linspace(0, 1, 1000)
    share = (np.interp(test, marks, refs) - np.interp(-test, -np.array(marks)[::-1], -refs[::-1])) / 2
    share = np.where(test - 1e-7 < marks[0], 0, np.where(test + 1e-7 > marks[-1], 1, share)).clip(1e-7, 1 - 1e-7)
    want = [NormalDist().inv_cdf(p) for p in share]
    got = [r.v for r in M.quantile_normal(frame(train), frame(test), ["v"]).orderBy("id").collect()]
    assert np.allclose(got, want, atol=1e-9)
    odd = spark.createDataFrame([(1, None), (2, float("nan")), (3, 2.0)], "id long, v double")
    assert [r.v for r in M.quantile_normal(odd.where("id < 3"), odd, ["v"]).orderBy("id").collect()] == [None, None, None]
    assert [r.v is None for r in M.quantile_normal(odd, odd, ["v"]).orderBy("id").collect()] == [True, True, False]
    p = spark.createDataFrame([(x,) for x in (1e-7, 1e-3, 0.02, 0.074, 0.076, 0.3, 0.5, 0.9, 0.99999)], "p double")
    assert np.allclose([r[0] for r in p.select(M.normal_quantile(F.col("p"))).collect()], [NormalDist().inv_cdf(r.p) for r in p.collect()], atol=1e-12)


def test_weighted_sample_draws_exactly_n(spark):
    rows = [(i, w) for i, w in enumerate([1.0, 0.0, 3.0, None, 1000.0, 2.0, -1.0] + [0.5] * 200)]
    df = spark.createDataFrame(rows, "id long, w double")
    got = M.weighted_sample(df, "w", 5000, "id", 7)
    count = {r.id: r["count"] for r in got.groupBy("id").count().collect()}
    total = sum(w for _, w in rows if w and w > 0)
    assert got.count() == 5000 and not {1, 3, 6} & set(count)
    assert abs(count[4] / 5000 - 1000 / total) < 0.02 and got.where("id = 4").select("copy").distinct().count() == count[4]
    assert M.weighted_sample(df.where("w is null"), "w", 5, "id").count() == 0


def test_zones_are_dense_cells_that_touch(spark):
    """Against walking from cell to cell: a long winding zone, a corner, a single cell, thin cells between."""
    rng = np.random.default_rng(4)
    cells = {(i, 0) for i in range(40)} | {(39, j) for j in range(30)} | {(40, 30), (41, 31), (-9, -9)} | {(int(a), int(b)) for a, b in rng.integers(50, 62, (60, 2))}
    rows = [((x + 0.5) * 0.1, (y + 0.5) * 0.1) for x, y in cells for _ in range(5 if x != 20 else 6)] + [(0.05, 9.05)] * 4 + [(None, 1.0)]
    got = {(r.zone_x, r.zone_y): (r.zone, r.n) for r in P.zones(spark.createDataFrame(rows, "lon double, lat double"), 0.1, 5).collect()}
    left, groups = set(cells), []
    while left:
        todo, group = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            group.add((x, y))
            for c in [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if c in left:
                    left.discard(c)
                    todo.append(c)
        groups.append(group)
    assert set(got) == cells and len({z for z, _ in got.values()}) == len(groups)
    assert all(len({got[c][0] for c in g}) == 1 for g in groups)
    sizes = {got[next(iter(g))][0]: sum(got[c][1] for c in g) for g in groups}
    assert [sizes[z] for z in sorted(sizes)] == sorted(sizes.values(), reverse=True)
    trips = spark.createDataFrame([(0.05, 0.05, "2024-01-01 07:30:00"), (9.9, 0.0, "2024-01-01 07:10:00")], "lon double, lat double, p string").withColumn("pickup", F.to_timestamp("p"))
    zone = got[0, 0][0]
    assert {tuple(r) for r in P.demand_by_zone(trips, spark.createDataFrame([(zone, 0, 0)], "zone int, zone_x long, zone_y long"), 0.1).collect()} == {(zone, 7, 1), (0, 7, 1)}


def test_site_and_water_features(spark):
    site = spark.createDataFrame([(0.5, 2.0, 10.0, 20.0, 4.0, 3.0), (0.5, 0.0, None, 20.0, 4.0, 3.0)], "building_coverage double, building_density double, avg_building_height double, temp_mean double, temp_std double, wind_speed_mean double")
    a, b = P.interactions(site).collect()
    assert (a.building_coverage_ratio, a.building_density_squared, a.height_to_coverage_ratio, a.temp_building_interaction, a.temp_std_coverage_ratio, a.temp_wind_building, a.wind_energy, a.building_volume, a.temp_variation_coefficient) == (0.25, 4.0, 20.0, 40.0, 1.0, 120.0, 9.0, 20.0, 0.2)
    assert (b.building_coverage_ratio, b.height_to_coverage_ratio, b.temp_std_coverage_ratio, b.temp_building_interaction) == (None, None, None, 0.0) and "lst_building_interaction" not in a.asDict()
    w = spark.createDataFrame([(0.3, 0.1, 0.2, 0.0, 7.0, "2024-04-10")], "nir double, green double, swir16 double, swir22 double, pet double, sample_date string")
    r = P.water_features(w).first()
    assert np.allclose([r.ndwi, r.ndmi, r.mndwi, r.nir_swir16, r.pet_ndmi, r.pet_mndwi, r.ndmi_squared, r.log_nir, r.month_sin, r.month_cos], [-0.5, 0.2, -1 / 3, 1.5, 1.4, -7 / 3, 0.04, math.log(1.3), math.sin(2 * math.pi / 3), math.cos(2 * math.pi / 3)])
    assert r.green_swir22 is None and r.day_of_year == 101


def test_report_over_a_period_and_default_caregiver(spark):
    users = spark.createDataFrame([(1,), (2,), (2,)], "user_id long")
    alerts = spark.createDataFrame([("2024-01-03 00:00:00", "high"), ("2024-01-10 00:00:00", "high"), ("2024-01-05 00:00:00", None), ("2024-01-02 23:59:59", "low"), ("2024-01-10 00:00:01", "low"), (None, "low")], "timestamp string, severity string")
    tiers = spark.createDataFrame([(1, "high"), (1, "medium"), (2, "low")], "user_id long, tier string")
    r = R.analytics_report(users, alerts, tiers, users, "2024-01-10 00:00:00").first()
    assert (r.users, r.alerts, r.by_severity, r.at_risk, r.interventions, str(r.period_start), str(r.period_end)) == (2, 3, {"high": 2, "unknown": 1}, 1, 3, "2024-01-03 00:00:00", "2024-01-10 00:00:00")
    none = R.analytics_report(users, alerts, tiers, users, "2020-01-10 00:00:00").first()
    assert (none.alerts, none.by_severity) == (0, {})
    people = spark.createDataFrame([(1, "Ann", "Bo", "daughter"), (3, "Cy", None, None)], "user_id long, patient string, caregiver string, relationship string")
    got = {r.user_id: (r.patient, r.caregiver, r.relationship) for r in R.add_caregiver(spark.createDataFrame([(1,), (2,), (3,)], "user_id long"), people).collect()}
    assert got == {1: ("Ann", "Bo", "daughter"), 2: ("Patient 2", "Family Member", "family member"), 3: ("Cy", "Family Member", "family member")}


def test_each_user_gets_the_model_that_fits(spark):
    """Classes apart by a line, by spread, and by a step; scored as chosen; metrics on rows held out."""
    rng = np.random.default_rng(9)
    rows = []
    for user in ("line", "spread", "step"):
        for i in range(400):
            a, b = rng.normal(size=2)
            if user == "line":
                y = int(a + b + 0.05 * rng.normal() > 0)
            elif user == "spread":
                y = i % 2
                a, b = (a * 0.1, b * 0.1) if y else (a * 4, b * 4)
            else:
                y = int((a > 0.3) != (rng.random() < 0.02))
            rows.append((f"{user}{i}", user, float(a), float(b), y))
    rows += [("n1", "line", None, 1.0, 1), ("n2", "line", float("nan"), 1.0, 0), *((f"o{i}", "one", 1.0, 2.0, 0) for i in range(3))]
    df = spark.createDataFrame(rows, "id string, user string, a double, b double, y int")
    models = ML.choose_per_user(df, "id", "user", ["a", "b"], "y").cache()
    got = {r.user: r for r in models.collect()}
    assert set(got) == {"line", "spread", "step", "one"} and got["spread"].chosen != "logistic"
    for user in ("line", "spread", "step"):
        r = got[user]
        assert r.n + r.n_unseen == 400 and 5 < r.n_unseen < 40 and r.score > 0.9 and r.f1 > 0.85
    scored = ML.score_chosen(df, models, "user", ["a", "b"])
    right = {r.user: r.share for r in scored.where("user <> 'one' AND prediction IS NOT NULL").groupBy("user").agg(F.avg((F.col("prediction") == F.col("y")).cast("int")).alias("share")).collect()}
    assert min(right.values()) > 0.93
    assert [r.prediction for r in scored.where("id = 'n1' OR user = 'one'").orderBy("id").collect()] == [None, 0, 0, 0]
    again = {r.user: r for r in ML.choose_per_user(df.repartition(5), "id", "user", ["a", "b"], "y").collect()}
    assert {u: (r.chosen, r.score, r.f1) for u, r in again.items()} == {u: (r.chosen, r.score, r.f1) for u, r in got.items()}
    assert set(L.passing_models(models.select(F.col("user").alias("account")), models.select(F.col("user").alias("account"), "precision", "recall", "f1"), 0.85).select("account").collect()) >= {("spread",)}


def test_churn_is_scored_on_rows_held_out(spark):
    rows = [(i, float(i % 10), i % 10 // 7) for i in range(200)]
    got = ML.fit_churn(spark.createDataFrame(rows, "user_id long, x double, churned_max int"), ["x"])
    share = {(r.churned_max, r.is_test): r["count"] for r in got.groupBy("churned_max", "is_test").count().collect()}
    assert share == {(0, True): 28, (0, False): 112, (1, True): 12, (1, False): 48}
    assert got.where("is_test AND (p > 0.5) <> (churned_max = 1)").count() == 0
