"""Queries of models; checked by rows, since their results are iterative."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as L
from ..operators import models as M
from ..operators import records as R
from ..operators.measures import classification_metrics
from ..session import settle
from .fixtures import ACC, DAYC, DAYP, DAYS7, FEAT, HOURP, LONGP, Registry, access_events, features, geo_points, r6, wearables, with_

add = Registry()
_X = ["x1", "x2", "x3", "x4"]


@add()
def m3_cluster_points(spark, d):
    return M.cluster_points(geo_points(spark, d), ["lon", "lat"], 5).select("point_id", "cluster")


@add()
def m4_pca_reduce(spark, d):
    o = M.pca_reduce(features(spark, d), _X, 0.9)
    return o.select("vec_id", F.size("components").alias("n"), r6(F.col("components")[0]).alias("first"))


@add()
def m6_fit_regressor(spark, d):
    return M.fit_regressor(features(spark, d), "vec_id", _X, "y", "forest", 3)


@add()
def m7_fit_churn(spark, d):
    return M.fit_churn(R.user_features(wearables(spark, d)).fillna(0), ["steps_mean", "steps_std", "heart_rate_mean", "class_attended_sum"]).select("user_id", "churned_max", "is_test", r6("p").alias("p"))


@add()
def m7_churn_metrics(spark, d):
    """On the fifth of each class that the model has not seen."""
    scored = M.fit_churn(R.user_features(wearables(spark, d)).fillna(0), ["steps_mean", "steps_std", "heart_rate_mean", "class_attended_sum"])
    return classification_metrics(scored.where("is_test").withColumn("predicted", (F.col("p") > 0.5).cast("int")), "churned_max", "predicted")


@add()
def m8_regional_predict(spark, d):
    f = features(spark, d).withColumn("region", F.col("label").cast("string"))
    return M.regional_predict(f.where("vec_id % 5 <> 0"), f.where("vec_id % 5 = 0"), _X, "y", "region", 20).select("vec_id", F.round("p", 4).alias("p"))


@add()
def m9_stack_predict(spark, d):
    f = features(spark, d)
    return M.stack_predict(f.where("vec_id % 5 <> 0"), f.where("vec_id % 5 = 0"), "vec_id", _X, "y").select("vec_id", F.round("p", 4).alias("p"))


@add()
def m10_fit_per_user(spark, d):
    e = access_events(spark, d).withColumn("y", (F.col("activity") == "Lock").cast("int"))
    return M.fit_per_user(e, "event_id", "account", ["value", "k"], "y").select("account", r6("bias").alias("bias"), "n")


def _draw(tag: str, n: str) -> str:
    return f"(CAST('0x' || substr(md5('1{tag}:' || event_id), 1, 8) AS BIGINT) % ({n}))"


_DAYS = "[" + ", ".join(f"'{x.lower()}'" for x in DAYS7) + "]"
_N7 = " ".join(f"WHEN i < round_even(n / 7.0 * {i}, 0) THEN {i}" for i in range(1, 7))
#: Synthetic rows as SQL: the days that each account has for each scenario, then the draws.
_MADE = f"""span AS (SELECT account, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM acc GROUP BY account),
week0 AS (SELECT h.account, list_position({_DAYS}, lower(h.day)) - 1 AS i, cls = 'normal' AS normal, start_hour AS s, end_hour AS e, NOT (start_hour = 0 AND end_hour = 23) AS profiled, a, b FROM hourp h JOIN dayc c ON h.account = c.account AND lower(h.day) = c.day JOIN span p ON p.account = h.account),
week1 AS (SELECT *, a + CAST((i - (isodow(a) - 1) + 7) % 7 AS INT) AS first FROM week0),
week AS (SELECT account, i, normal, first, (b - first) // 7 + 1 AS dates,
 CASE WHEN profiled THEN list_filter(range(24), lambda h: h BETWEEN s AND e) ELSE list_filter(range(24), lambda h: false) END AS usual,
 CASE WHEN NOT profiled THEN range(24) WHEN len(list_filter(range(24), lambda h: h < s - 1 OR h > e + 1)) > 0 THEN list_filter(range(24), lambda h: h < s - 1 OR h > e + 1) ELSE list_filter(range(24), lambda h: h < s OR h > e) END AS unusual
 FROM week1 WHERE first <= b),
wanted AS (SELECT * FROM (VALUES (1, true, false, false), (2, false, true, false), (3, true, true, false), (4, false, false, true), (5, true, false, true), (6, false, true, true), (7, false, false, false)) t(scenario, day, hour, known)),
chosen AS (SELECT account, scenario, known, list({{'f': first, 'n': dates, 'h': CASE WHEN hour THEN usual ELSE unusual END}} ORDER BY i) FILTER (normal = day AND len(CASE WHEN hour THEN usual ELSE unusual END) > 0) AS fit, list({{'f': first, 'n': dates, 'h': range(24)}} ORDER BY i) AS every FROM week, wanted GROUP BY account, scenario, known),
placed AS (SELECT event_id, account, CASE {_N7} ELSE 7 END AS scenario FROM (SELECT event_id, account, row_number() OVER (PARTITION BY account ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY account) AS n FROM acc)),
ratios AS (SELECT account, count(*) FILTER (activity IN ('Logon','Privileged Logon','Unlock')) * 1.0 / nullif(count(*) FILTER (activity IN ('Logon','Privileged Logon','Unlock','Lock')), 0) AS ratio FROM acc GROUP BY account),
pool AS (SELECT account, host, row_number() OVER (PARTITION BY account ORDER BY ts, event_id) - 1 AS j, count(*) OVER (PARTITION BY account) AS m FROM acc WHERE host IS NOT NULL),
drawn AS (SELECT p.event_id, p.account, p.scenario, known, fit IS NOT NULL AS realised, coalesce(fit, every) AS days, ratio, m FROM placed p JOIN chosen c ON p.account = c.account AND p.scenario = c.scenario JOIN ratios r ON r.account = p.account LEFT JOIN (SELECT DISTINCT account, m FROM pool) q ON q.account = p.account),
dated AS (SELECT *, days[{_draw("day", "len(days)")} + 1] AS d FROM drawn),
made AS (SELECT t.event_id, t.account, CASE WHEN known AND host IS NOT NULL THEN host ELSE 'NEW' || substr(md5('1new:' || t.event_id), 1, 12) END AS host,
 CAST(d.f + CAST(7 * {_draw("date", "d.n").replace("event_id", "t.event_id")} AS INT) AS TIMESTAMP) + to_hours(d.h[{_draw("hour", "len(d.h)").replace("event_id", "t.event_id")} + 1]) + to_seconds({_draw("second", "3600").replace("event_id", "t.event_id")}) AS ts,
 CASE WHEN {_draw("lock", "1000000").replace("event_id", "t.event_id")} < coalesce(ratio, 0.5) * 1000000 THEN 1 ELSE 0 END AS unlocks, t.scenario, realised AND (host IS NOT NULL OR NOT known) AS realised
 FROM dated t LEFT JOIN pool h ON known AND t.account = h.account AND h.j = {_draw("host", "t.m").replace("event_id", "t.event_id")})"""
_SYNTH = with_(ACC, DAYP, LONGP, DAYC, HOURP, _MADE)
_AT = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


@add()
def m10_choose_per_user(spark, d):
    """Anomalous rows told from the others by each account's own best model."""
    return M.choose_per_user(_profiled(spark, d), "row_id", "account", _PROFILE, "target").select("account", "chosen", *(r6(c).alias(c) for c in ("score", "precision", "recall", "f1")), "n", "n_unseen")


@add()
def m10_passing_models(spark, d):
    """The quality gate reads these metrics."""
    m = settle(M.choose_per_user(_profiled(spark, d), "row_id", "account", _PROFILE, "target"))  # read twice
    return L.passing_models(m.select("account", "chosen"), m.select("account", "precision", "recall", "f1"), 0.6).select("account", "chosen", *(r6(c).alias(c) for c in ("precision", "recall", "f1")))


_PROFILE = ["day_ok", "hour_ok", "freq", "hour"]


def _profiled(spark, d):
    e = access_events(spark, d)
    days, hours, hosts = L.weekday_class(L.day_profile(e)), L.hour_profile(e), L.host_profile(e)
    rows = L.apply_profile(M.with_anomalies(e), hosts, days, hours)
    flag = lambda c: F.col(c).cast("int")
    return rows.select(F.concat_ws(":", "event_id", "target").alias("row_id"), "account", flag("working_day").alias("day_ok"), flag("working_hour").alias("hour_ok"), "freq", F.hour("ts").alias("hour"), "target")


@add(_SYNTH + f"SELECT event_id, account, host, {_AT}, unlocks, 1 - unlocks AS locks, scenario, realised, 1 AS target FROM made")
def m12_synthesize_anomalies(spark, d):
    e = access_events(spark, d)
    o = M.synthesize_anomalies(e, L.hour_profile(e), L.weekday_class(L.day_profile(e)))
    return o.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@add(_SYNTH + f"SELECT event_id, account, host, {_AT}, CAST(activity IN ('Logon','Privileged Logon','Unlock') AS INT) AS unlocks, CAST(activity = 'Lock' AS INT) AS locks, 0 AS scenario, 0 AS target FROM acc UNION ALL SELECT event_id, account, host, {_AT}, unlocks, 1 - unlocks, scenario, 1 FROM made")
def m12_with_anomalies(spark, d):
    return M.with_anomalies(access_events(spark, d)).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@add("WITH acc AS (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events) SELECT 'u' || user_id AS account, scenario, count(*) AS n FROM (SELECT user_id, CASE " + " ".join(f"WHEN i < round_even(n / 7.0 * {i}, 0) THEN {i}" for i in range(1, 7)) + " ELSE 7 END AS scenario FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM acc)) GROUP BY 1, 2")
def m12_scenario_counts(spark, d):
    e = access_events(spark, d)
    return M.synthesize_anomalies(e, L.hour_profile(e), L.weekday_class(L.day_profile(e))).groupBy("account", "scenario").agg(F.count("*").alias("n"))


def _u(*keys: str, seed: int = 1) -> str:
    return f"((CAST('0x' || substr(md5('{seed}:' || " + " || ':' || ".join(keys) + "), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"


def _gauss(*keys: str) -> str:
    return f"sqrt(-2 * ln({_u(*keys, repr('a'))})) * cos(2 * pi() * {_u(*keys, repr('b'))})"


@add(with_(FEAT) + f"SELECT vec_id, CAST(copy AS INT) AS copy, round(x1 + 0.05 * s * {_gauss('vec_id', 'copy', repr('x1'))}, 6) AS x1 FROM feat, (SELECT unnest(range(1, 3)) AS copy), (SELECT stddev_pop(x1) AS s FROM feat)")
def m13_augment_noise(spark, d):
    return M.augment(features(spark, d), "vec_id", _X, "y", "noise", 2).select("vec_id", "copy", r6("x1").alias("x1"))


def _mixed(source: str, shape: float, copies: int, jitter: str = "") -> str:
    """Neighbours by comparing all rows, and the first pair of powers with a sum of at most 1."""
    power = 1 / shape
    pair = f"{{'x': pow({_u('vec_id', 'copy', 'i', repr('a'))}, {power}), 'y': pow({_u('vec_id', 'copy', 'i', repr('b'))}, {power})}}"
    apart = " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in _X)
    return f"""{source},
near AS (SELECT * FROM (SELECT a.vec_id, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt({apart}), b.vec_id) AS p FROM src a JOIN src b ON a.vec_id <> b.vec_id) WHERE p <= 4),
drawn AS (SELECT *, list_filter(list_transform(range(1, 25), lambda i: {pair}), lambda z: z.x + z.y <= 1)[1] AS z, CAST(floor({_u('vec_id', 'copy', repr('near'))} * (SELECT least(4, count(*) - 1) FROM src)) AS INT) + 1 AS pick FROM src, (SELECT unnest(range(1, {copies + 1})) AS copy)),
shares AS (SELECT *, z.x / (z.x + z.y) AS w FROM drawn)
SELECT s.vec_id, CAST(copy AS INT) AS copy, neighbour, round(w, 6) AS share, round(w * s.x1 + (1 - w) * o.x1{jitter}, 6) AS x1, round(w * s.y + (1 - w) * o.y, 6) AS y FROM shares s JOIN near n ON s.vec_id = n.vec_id AND n.p = pick JOIN src o ON o.vec_id = n.neighbour"""


@add(_mixed(with_(FEAT).rstrip() + ", src AS (SELECT * FROM feat)", 0.5, 1))
def m13_augment_mixup(spark, d):
    o = M.augment(features(spark, d), "vec_id", _X, "y", "mixup", 1)
    return o.select("vec_id", "copy", "neighbour", r6("share").alias("share"), r6("x1").alias("x1"), r6("y").alias("y"))


@add(_mixed(with_(FEAT).rstrip() + ", src AS (SELECT f.* FROM feat f, (SELECT quantile_cont(y, 0.1) AS a, quantile_cont(y, 0.9) AS b FROM feat) WHERE y <= a OR y >= b)", 0.4, 2, " + 0.0005 * " + _gauss("s.vec_id", "copy", repr("x1"))))
def m13_augment_extremes(spark, d):
    o = M.augment(features(spark, d), "vec_id", _X, "y", "extremes", 2)
    return o.select("vec_id", "copy", "neighbour", r6("share").alias("share"), r6("x1").alias("x1"), r6("y").alias("y"))
