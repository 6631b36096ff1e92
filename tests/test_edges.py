"""Hand-made rows for what the given tables do not hold."""

from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewater.functions import expressions as X
from tidewater.operators import logs as L
from tidewater.operators import measures as M
from tidewater.operators import models as ML
from tidewater.operators import places as P
from tidewater.operators import records as R
from tidewater.sources import io


def at(h, m=0, d=1):
    return datetime(2024, 1, d, h, m)


@pytest.fixture(scope="module")
def log(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = [
        (1, at(8), "a", "P", "Unlock", None), (2, at(8), "a", "P", "Lock", None),  # one instant: no match
        (3, at(9), "a", "P", "Unlock", None), (4, at(10), "a", "P", "Logon", None), (5, at(11), "a", "P", "Lock", None),  # two unlocks, one lock
        (6, at(11), "a", "P", "PeFileWritten", "x.DOC"), (7, at(12), "a", "P", "Lock", None), (8, at(13), "a", "P", "Unlock", None),
        (9, at(7), "b", "Q", "Lock", None), (10, None, "b", "Q", "Unlock", None), (11, at(9), None, "Q", "Unlock", None), (12, at(9), "b", None, "Unlock", None),
    ]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, account string, host string, activity string, details string")


def test_sessions_are_strict_and_keep_the_earliest_unlock(log):
    s = [(r.account, r.unlock_time.hour, r.lock_time.hour) for r in L.match_sessions(log).collect()]
    assert s == [("a", 8, 11)]
    assert [r.unlock_time.hour for r in L.unmatched_unlocks(log).collect()] == [13]
    assert sorted((r.account, r.lock_time.hour) for r in L.unmatched_locks(log).collect()) == [("a", 8), ("b", 7)]


def test_interval_ends(log):
    s = L.match_sessions(log)
    both = {r.event_id for r in L.events_in_sessions(log, s, "both").collect()}
    left = {r.event_id for r in L.events_in_sessions(log, s, "left").collect()}
    assert both - left == {5, 6}


def test_default_logon_once_a_session(spark, log):
    s = L.match_sessions(log)
    j = L.events_in_sessions(log.where("activity not in ('Logon', 'Unlock')"), s, "left")
    assert L.inject_default_logon(j).where("activity = 'Logon'").count() == 1


def test_primary_host_ties_by_name(spark):
    e = spark.createDataFrame([("a", "Z"), ("a", "B")], "account string, host string")
    assert L.primary_host(e).first().primary_host == "B"


def test_eligible_users_needs_more_than_the_limits(spark):
    rows = [("x", at(0, 0, 1 + i % 7)) for i in range(100)] + [("y", at(0, 0, 1 + i % 8)) for i in range(101)]
    e = spark.createDataFrame(rows, "account string, ts timestamp")
    assert {r.account for r in L.eligible_users(e).select("account").distinct().collect()} == {"y"}


def test_weekday_ties_mark_more_than_two(spark):
    p = spark.createDataFrame([("a", *[1 / 7] * 7)], ["account", *[d.lower() for d in X.DAYS]])
    assert set(L.weekday_class(p).first()[1:]) == {"abnormal"}


def test_dialogue_rules(spark):
    t = lambda rows: spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    c = t([(1, 0, "customer", "hi"), (1, 1, "agent", "a1"), (1, 2, "customer", "q"), (1, 3, "agent", "a2"), (1, 4, "customer", "bye"), (2, 0, "agent", "only")])
    assert [(r.response, r.context) for r in R.context_pairs(c).orderBy("turn").collect()] == [("a1", "customer: hi"), ("a2", "customer: hi agent: a1 customer: q")]
    assert [r.response for r in R.merged_context_pairs(c).collect()] == ["a2"]
    assert R.merged_context_pairs(c.where("turn < 4")).count() == 0 and R.merged_context_pairs(c.where("turn < 4"), include_last=True).count() == 1
    assert R.context_pairs(c.where("false")).count() == 0


def test_paging_over_equal_times(spark):
    rows = [(i, 1, at(1 + i // 3)) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, workspace_id int, created_at timestamp")
    seen, cursor = [], None
    while True:
        page = R.page(df, 1, 4, cursor).collect()
        seen += [r.doc_id for r in page]
        if not page or not page[0].has_next:
            break
        cursor = page[-1].cursor
    assert seen == list(range(9, -1, -1))
    first = R.page(df, 1, 4).collect()
    skipped = [r.doc_id for r in R.page(df, 1, 9, first[-1].cursor, ties=False).collect()]
    assert first[-1].doc_id == 6 and skipped == [5, 4, 3, 2, 1, 0]


def test_grid_joins_at_cell_edges(spark):
    p = spark.createDataFrame([(1, 0.01, 0.01), (2, -0.01, 0.0)], "point_id long, lon double, lat double")
    s = spark.createDataFrame([(1, 0.02, 0.01), (2, 0.0, 0.01), (3, 0.0299, 0.01), (4, -0.02, 0.0)], "site_id long, site_lon double, site_lat double")
    got = {(r.point_id, r.site_id) for r in P.radius_join(p, s, 0.01).collect()}
    assert got == {(1, 1), (1, 2), (2, 4)} or got == {(1, 1), (1, 2), (2, 4), (2, 2)}
    near = P.knn_join(p, s, 2, cell=0.005).collect()
    assert {(r.point_id, r.site_id) for r in near} == {(1, 1), (1, 2), (2, 4), (2, 2)} or len(near) == 4


def test_nearest_sites_however_far_and_in_the_north(spark):
    import random

    from tidewater.functions.expressions import EARTH_KM

    rng = random.Random(3)
    sites = [(i, 20 + rng.random() * 0.2, 65 + rng.random() * 0.2) for i in range(60)] + [(60, 179.99, 0.0), (61, -179.97, 0.0), (62, 20.0, 85.0)]
    points = [(i, 20 + rng.random() * 0.2, 65 + rng.random() * 0.2) for i in range(40)] + [(40, 24.0, 65.0), (41, 20.0, -65.0), (42, -179.99, 0.0), (43, 200.0 - 360, 89.9)]

    def km(a, b):
        import math

        x, y, u, v = map(math.radians, (*a[1:], *b[1:]))
        h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
        return 2 * EARTH_KM * math.asin(min(1, math.sqrt(h)))

    want = {(p[0], n + 1, q[0]) for p in points for n, q in enumerate(sorted(sites, key=lambda q: (km(p, q), q[0]))[:3])}
    p = spark.createDataFrame(points, "point_id long, lon double, lat double")
    s = spark.createDataFrame(sites, "site_id long, site_lon double, site_lat double")
    assert {(r.point_id, r["rank"], r.site_id) for r in P.knn_join(p, s, 3).collect()} == want
    assert P.knn_join(p, s.where("site_id < 2"), 3).count() == 2 * len(points)


def test_raster_borders(spark):
    pix = spark.createDataFrame([(r, c, float(r * 4 + c)) for r in range(4) for c in range(4)], "row int, col int, value double")
    pts = spark.createDataFrame([(1, 0.5, 3.5), (2, 9.0, 9.0)], "point_id long, lon double, lat double")
    affine = (0.0, 4.0, 1.0)
    assert {r.point_id: r.value for r in P.sample_raster(pts, pix, affine).collect()} == {1: 0.0, 2: None}
    w = P.raster_window(pts, pix, 3, affine, (4, 4))
    assert {(r.row, r.col) for r in w.collect()} == {(r, c) for r in range(3) for c in range(3)}  # moved inside
    assert P.disc_stats(w, "value", 1).first().mean == 5.0


def test_lists_files_and_names(spark, tmp_path):
    df = spark.createDataFrame([Row(a=["x", "y"], b=["x"], c=None)], "a array<string>, b array<string>, c array<string>")
    assert tuple(io.flatten_list_columns(df).first()) == ("y", "x", "")
    assert M.sanitize_columns(spark.createDataFrame([(1, 2, 3)], ["a b", "ab", "c"])).columns == ["ab", "ab_1", "c"]
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "1.png").write_bytes(b"abc")
    (tmp_path / "l.csv").write_text("imageFile,classID\n1.png,7\n2.png,8\n")
    r = io.read_labelled_files(spark, str(tmp_path / "l.csv"), str(tmp_path / "img"), "imageFile string, classID int").collect()
    assert [(x.classID, x.length) for x in r] == [(7, 3)]
    io.write_by_hour(spark.createDataFrame([(at(5),)], "ts timestamp"), str(tmp_path / "h"), "ts")
    assert spark.read.parquet(str(tmp_path / "h")).first().hour_stamp in ("010124_00", "10124_00", 1012400)


def test_history_and_upsert_are_repeatable(spark):
    t = spark.createDataFrame([(1, ["a"]), (2, None)], "id long, h array<string>")
    e = spark.createDataFrame([(2, "t2", "y"), (2, "t1", "x")], "id long, at string, note string")
    assert {r.id: r.h for r in R.append_history(t, e, "id", "h").collect()} == {1: ["a"], 2: ["t1 x", "t2 y"]}
    base = spark.createDataFrame([(1, 1), (2, 2)], "id long, v int")
    new = spark.createDataFrame([(2, 9), (3, 3)], "id long, v int")
    once = R.upsert(base, new, ["id"])
    assert sorted(map(tuple, R.upsert(once, new, ["id"]).collect())) == sorted(map(tuple, once.collect())) == [(1, 1), (2, 9), (3, 3)]


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    r = M.classification_metrics(df, "y", "p").first()
    assert (r.tp, r.tn, r.precision, r.recall, r.f1, r.accuracy) == (0, 2, None, None, None, 1.0)
    assert M.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 3).orderBy("bin").collect()[0].n == 2


def test_profile_database_in_parts(spark, tmp_path):
    """Four connections read each row once, nulls too; an upsert replaces by key; a table of one key or none."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "createTableColumnTypes": "name VARCHAR(20)"}
    rows = [(i, f"n{i}") for i in range(1, 101)] + [(None, "none"), (10**12, "far")]
    io.write_profile(spark.createDataFrame(rows, "id long, name string"), "people", url, **options)
    for bounds in (None, (20, 60)):
        back = io.read_profile(spark, "people", url, "id", bounds, 4, **options)
        assert back.rdd.getNumPartitions() == 4 and sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    io.upsert_profile(spark.createDataFrame([(5, "five"), (500, "new")], "id long, name string"), "people", url, ["id"], "id", 4, **options)
    got = sorted(map(tuple, io.read_profile(spark, "people", url, "id", parts=4, **options).collect()), key=str)
    assert got == sorted([r for r in rows if r[0] != 5] + [(5, "five"), (500, "new")], key=str)
    one = spark.createDataFrame([(7, "a")], "id long, name string")
    for part in (one, one.where("false")):
        io.write_profile(part, "few", url, **options)
        assert io.read_profile(spark, "few", url, "id", parts=4, **options).collect() == part.collect()
