"""Queries of statistics, metrics, samples and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import logs as L
from ..operators import measures as M
from .fixtures import ACC, DAYP, DAYS7, FEAT, HOSTP, HOURP, POINTS, PRED, SCORES, Registry, access_events, features, geo_points, load, prediction_sets, r6, scores, with_

add = Registry()
_F = ["x1", "x2", "x3", "x4"]
_HOLES = "holes AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 11 = 0 THEN CAST('nan' AS DOUBLE) WHEN vec_id % 13 = 0 THEN CAST('inf' AS DOUBLE) ELSE x1 END AS x1, x2 FROM feat)"


def _holes(spark, d):
    v = F.col("vec_id")
    return features(spark, d).select("vec_id", F.when(v % 7 == 0, F.lit(None)).when(v % 11 == 0, float("nan")).when(v % 13 == 0, float("inf")).otherwise(F.col("x1")).alias("x1"), "x2")


@add(with_(FEAT, _HOLES) + "SELECT vec_id, round(x1, 6) AS x1 FROM holes WHERE x1 IS NOT NULL AND NOT isnan(x1) AND abs(x1) < 'inf'::DOUBLE")
def p11_drop_incomplete(spark, d):
    return M.drop_incomplete(_holes(spark, d), ["x1", "x2"]).select("vec_id", r6("x1").alias("x1"))


@add(with_(FEAT, _HOLES) + "SELECT vec_id, round(CASE WHEN x1 IS NULL OR isnan(x1) OR isinf(x1) THEN 0 ELSE x1 END, 6) AS x1 FROM holes")
def p12_nan_to_num(spark, d):
    return _holes(spark, d).select("vec_id", r6(X.nan_to_num(F.col("x1"))).alias("x1"))


@add(with_(FEAT) + "SELECT vec_id, round(greatest(-0.05, least(0.05, x1)), 6) AS x1 FROM feat")
def p13_clip(spark, d):
    return features(spark, d).select("vec_id", r6(X.clip(F.col("x1"), -0.05, 0.05)).alias("x1"))


@add("SELECT c_custkey, c_name, NULL::VARCHAR AS missing FROM customer")
def p7_project(spark, d):
    return M.project(load(spark, d, "customer"), ["c_name", "missing", "c_custkey"])


@add('SELECT c_custkey AS key, c_name AS "name", c_acctbal AS key_2 FROM customer')
def p8_sanitize_columns(spark, d):
    return M.sanitize_columns(load(spark, d, "customer").select(F.col("c_custkey").alias("k e/y"), F.col("c_name").alias("na-me"), F.col("c_acctbal").alias("key")))


@add(with_(FEAT) + "SELECT vec_id, round(coalesce(CASE WHEN vec_id % 7 <> 0 THEN x1 END, m), 6) AS x1 FROM feat, (SELECT median(x1) AS m FROM feat WHERE vec_id % 7 <> 0)")
def a30_impute_median(spark, d):
    f = features(spark, d).select("vec_id", F.when(F.col("vec_id") % 7 != 0, F.col("x1")).alias("x1"))
    return M.impute_median(f, ["x1"]).select("vec_id", r6("x1").alias("x1"))


@add(with_(FEAT) + "SELECT vec_id, round(greatest(a, least(b, x1)), 6) AS x1 FROM feat, (SELECT quantile_cont(x1, 0.01) AS a, quantile_cont(x1, 0.99) AS b FROM feat)")
def f27_winsorize(spark, d):
    return M.winsorize(features(spark, d), ["x1"]).select("vec_id", r6("x1").alias("x1"))


@add(with_(FEAT, "c AS (SELECT vec_id, 0.92 + (y - a) / (b - a) * 0.17 AS c FROM feat, (SELECT min(y) AS a, max(y) AS b FROM feat))") + "SELECT vec_id, round(CASE WHEN c < p THEN p - (p - c) / 2 WHEN c > q THEN q + (c - q) / 2 ELSE c END, 6) AS calibrated FROM c, (SELECT quantile_cont(c, 0.02) AS p, quantile_cont(c, 0.98) AS q FROM c)")
def f28_calibrate(spark, d):
    return M.calibrate(features(spark, d), "y").select("vec_id", r6("calibrated").alias("calibrated"))


@add(with_(FEAT) + "SELECT vec_id, round((y - a) / (b - a) * 10, 2) AS scaled FROM feat, (SELECT min(y) AS a, max(y) AS b FROM feat)")
def f29_min_max(spark, d):
    return M.min_max(features(spark, d), "y").select("vec_id", "scaled")


@add(with_(FEAT) + "SELECT vec_id, round((y - m) / s, 5) AS z FROM feat, (SELECT avg(y) AS m, stddev_pop(y) AS s FROM feat) WHERE abs((y - m) / s) > 2")
def f30_zscore_anomalies(spark, d):
    return M.zscore_anomalies(features(spark, d), "y", 2.0).select("vec_id", F.round("z", 5).alias("z"))


_TR, _TE = "SELECT * FROM feat WHERE vec_id % 5 <> 0", "(SELECT * FROM feat WHERE vec_id % 5 = 0) t"


@add(with_(FEAT) + f"SELECT vec_id, round((x1 - m) / s, 5) AS x1 FROM {_TE}, (SELECT avg(x1) AS m, stddev_pop(x1) AS s FROM ({_TR}))")
def m1_standard_scale(spark, d):
    f = features(spark, d)
    return M.standard_scale(f.where("vec_id % 5 <> 0"), f.where("vec_id % 5 = 0"), ["x1"]).select("vec_id", F.round("x1", 5).alias("x1"))


@add(with_(FEAT) + f"SELECT vec_id, round((x1 - m) / (b - a), 5) AS x1 FROM {_TE}, (SELECT quantile_cont(x1, 0.25) AS a, median(x1) AS m, quantile_cont(x1, 0.75) AS b FROM ({_TR}))")
def m2_robust_scale(spark, d):
    f = features(spark, d)
    return M.robust_scale(f.where("vec_id % 5 <> 0"), f.where("vec_id % 5 = 0"), ["x1"]).select("vec_id", F.round("x1", 5).alias("x1"))


def _poly(c, x):
    out = repr(c[-1])
    for v in reversed(c[:-1]):
        out = f"({out} * {x} + {v!r})"
    return out


def _ratio(parts, x):
    return f"{_poly(parts[0], x)} / {_poly(parts[1], x)}"


_RANKED = f"""sorted AS (SELECT list(x1 ORDER BY x1) AS v, count(*) AS rows_n, least(1000, count(*)) AS n FROM ({_TR})),
marks AS (SELECT n, list_transform(range(n), lambda i: v[(i * (rows_n - 1)) // (n - 1) + 1] + (v[least(rows_n, (i * (rows_n - 1)) // (n - 1) + 2)] - v[(i * (rows_n - 1)) // (n - 1) + 1]) * (((i * (rows_n - 1)) % (n - 1)) / CAST(n - 1 AS DOUBLE))) AS q FROM sorted),
placed AS (SELECT vec_id, x1, q, n, len(list_filter(q, lambda v: v < x1)) AS lo, len(list_filter(q, lambda v: v <= x1)) AS hi FROM {_TE}, marks),
share AS (SELECT vec_id, least(1 - 1e-7, greatest(1e-7, CASE WHEN x1 - 1e-7 < q[1] THEN 0.0 WHEN x1 + 1e-7 > q[n] THEN 1.0 WHEN hi > lo THEN (lo + hi - 1) / 2.0 / (n - 1) ELSE (lo - 1 + (x1 - q[lo]) / (q[lo + 1] - q[lo])) / (n - 1) END)) AS p FROM placed),
side AS (SELECT vec_id, p, CAST(p AS DOUBLE) - 0.5 AS s, sqrt(-ln(CASE WHEN p < 0.5 THEN p ELSE 1 - p END)) AS r FROM share)"""


@add(with_(FEAT, _RANKED) + f"SELECT vec_id, round(CASE WHEN abs(s) <= 0.425 THEN s * {_ratio(M.NORMAL_MIDDLE, '(0.180625 - s * s)')} ELSE sign(s) * CASE WHEN r <= 5 THEN {_ratio(M.NORMAL_NEAR, '(r - 1.6)')} ELSE {_ratio(M.NORMAL_FAR, '(r - 5)')} END END, 5) AS x1 FROM side")
def m2_quantile_normal(spark, d):
    f = features(spark, d)
    return M.quantile_normal(f.where("vec_id % 5 <> 0"), f.where("vec_id % 5 = 0"), ["x1"]).select("vec_id", F.round("x1", 5).alias("x1"))


@add(with_(FEAT) + "SELECT vec_id, round(x1 * x1, 6) AS x1_x1, round(x1 * x2, 6) AS x1_x2, round(x2 * x2, 6) AS x2_x2 FROM feat")
def f26_polynomial(spark, d):
    o = M.polynomial(features(spark, d).select("vec_id", "x1", "x2"), ["x1", "x2"])
    return o.select("vec_id", *(r6(c).alias(c) for c in ("x1_x1", "x1_x2", "x2_x2")))


@add("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders")
def f15_label_encode(spark, d):
    return M.label_encode(load(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").select("o_orderkey", "code")


@add("SELECT count(*) AS n, 0 AS nulls, round(avg(o_totalprice), 3) AS mean, round(median(o_totalprice), 4) AS median, round(stddev_samp(o_totalprice), 3) AS std, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")
def a26_prediction_stats(spark, d):
    o = M.prediction_stats(load(spark, d, "orders"), "o_totalprice")
    return o.withColumns({"mean": F.round("mean", 3), "median": F.round("median", 4), "std": F.round("std", 3)})


@add(with_(POINTS) + "SELECT round(lon, 4) AS lon, round(lat, 4) AS lat, round(avg(target * 1000 + 0.00123), 2) AS target, count(*) AS n FROM points GROUP BY 1, 2")
def a27_station_averages(spark, d):
    return M.station_averages(geo_points(spark, d).withColumn("target", F.col("target") * 1000 + 0.00123), ["target"])


@add(with_(POINTS) + "SELECT round(min(target), 6) AS target_min, round(max(target), 6) AS target_max, round(avg(target), 6) AS target_mean, count(DISTINCT (lon, lat)) AS stations FROM points")
def a28_target_stats(spark, d):
    o = M.target_stats(geo_points(spark, d), ["target"])
    return o.withColumns({c: r6(c) for c in o.columns if c != "stations"})


@add("SELECT CAST(b.bin AS INT) AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(12)) AS bin) b LEFT JOIN (SELECT least(11, CAST(floor((o_totalprice - lo) * 12 / (hi - lo)) AS INT)) AS bin, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1) h ON b.bin = h.bin")
def a29_histogram(spark, d):
    return M.histogram(load(spark, d, "orders"), "o_totalprice", 12)


@add("SELECT label, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM embeddings GROUP BY label")
def a31_class_counts(spark, d):
    return M.class_counts(load(spark, d, "embeddings"), "label").withColumn("share", r6("share"))


@add("WITH m AS (SELECT l_shipmode AS model, avg(a) AS ta, avg(b) AS ec, avg(c) AS drp FROM (SELECT 'm' || (l_suppkey % 6) AS l_shipmode, l_discount AS a, l_tax AS b, l_quantity AS c FROM lineitem) GROUP BY 1), l AS (SELECT model, 'ta' AS target, ta AS score FROM m UNION ALL SELECT model, 'ec', ec FROM m UNION ALL SELECT model, 'drp', drp FROM m) SELECT target, model, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, model) AS n FROM l) WHERE n = 1")
def a34_best_model(spark, d):
    m = load(spark, d, "lineitem").groupBy(F.concat(F.lit("m"), (F.col("l_suppkey") % 6).cast("string")).alias("model")).agg(F.avg("l_discount").alias("ta"), F.avg("l_tax").alias("ec"), F.avg("l_quantity").alias("drp"))
    return M.best_model(m, ["ta", "ec", "drp"]).withColumn("score", r6("score"))


@add(with_(POINTS, PRED) + "SELECT round(avg(pow(a - b, 2)), 9) AS mse, round(sqrt(avg(pow(a - b, 2))), 9) AS rmse, round(avg(abs(a - b)), 9) AS mae, round(1 - avg(pow(a - b, 2)) / var_pop(a), 6) AS r2, round(100 * (1 - sqrt(avg(pow(a - b, 2))) / avg(a)), 6) AS accuracy FROM pred")
def a35_regression_metrics(spark, d):
    a, b = prediction_sets(spark, d)
    o = M.regression_metrics(a.join(b, ["point_id", "lon", "lat"]), "a", "b")
    return o.select(*(F.round(c, 6 if c in ("r2", "accuracy") else 9).alias(c) for c in o.columns))


_RATES = "tp, fp, fn, tn, round(tp * 1.0 / nullif(tp + fp, 0), 6) AS precision, round(tp * 1.0 / nullif(tp + fn, 0), 6) AS recall, round(CASE WHEN tp + fp = 0 OR tp + fn = 0 OR tp = 0 THEN NULL ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1, round((tp + tn) * 1.0 / nullif(tp + fp + fn + tn, 0), 6) AS accuracy, round(fp * 1.0 / nullif(fp + tn, 0), 6) AS fpr, round(tn * 1.0 / nullif(fp + tn, 0), 6) AS tnr"
_CONF = "count(*) FILTER (WHERE label = 1 AND {0}) AS tp, count(*) FILTER (WHERE label = 0 AND {0}) AS fp, count(*) FILTER (WHERE label = 1 AND NOT ({0})) AS fn, count(*) FILTER (WHERE label = 0 AND NOT ({0})) AS tn"


@add(with_(SCORES) + f"SELECT lang, {_RATES} FROM (SELECT lang, {_CONF.format('score > 0.04')} FROM scores GROUP BY lang)")
def a36_classification_metrics(spark, d):
    s = scores(spark, d).withColumn("p", (F.col("score") > 0.04).cast("int"))
    o = M.classification_metrics(s, "label", "p", ["lang"])
    return o.select("lang", "tp", "fp", "fn", "tn", *(r6(c).alias(c) for c in o.columns[5:]))


@add(with_(SCORES) + f"SELECT round(t, 3) AS threshold, {_RATES} FROM (SELECT t, {_CONF.format('score > t')} FROM scores, (SELECT unnest(range(20, 61)) / 1000.0 AS t) GROUP BY t)")
def a37_threshold_sweep(spark, d):
    o = M.threshold_sweep(scores(spark, d), "score", "label", [i / 1000 for i in range(20, 61)])
    return o.select(F.round("threshold", 3).alias("threshold"), "tp", "fp", "fn", "tn", *(r6(c).alias(c) for c in o.columns[5:]))


@add(with_(SCORES) + "SELECT round(s, 6) AS auc FROM (SELECT (sum(CASE WHEN label = 1 THEN r END) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)) AS s FROM (SELECT label, avg(n) OVER (PARTITION BY score) AS r FROM (SELECT label, score, row_number() OVER (ORDER BY score) AS n FROM scores)))")
def a38_roc_auc(spark, d):
    return M.roc_auc(scores(spark, d), "score", "label").select(r6("auc").alias("auc"))


@add("SELECT count(*) AS n, count(DISTINCT user_id) AS distinct_keys FROM events")
def a43_dataset_summary(spark, d):
    return M.dataset_summary(load(spark, d, "events"), "user_id")


@add(with_(FEAT) + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(pow(corr({c}, y), 2) / (1 - pow(corr({c}, y), 2)) * (count(*) - 2), 4) AS score FROM feat" for c in _F) + ")")
def a41_f_scores(spark, d):
    return M.f_scores(features(spark, d), _F, "y").withColumn("score", F.round("score", 4))


def _mi(c):
    ends = lambda x: "[" + ", ".join(f"(SELECT quantile_cont({x}, {i / 8}) FROM feat)" for i in range(1, 8)) + "]"
    at = lambda x: f"len(list_filter({ends(x)}, lambda e: {x} > e))"
    return f"SELECT '{c}' AS feature, round(sum(n / t * ln(n * t / (pa * pb))), 5) AS score FROM (SELECT n * 1.0 AS n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a) AS pa, sum(n) OVER (PARTITION BY b) AS pb FROM (SELECT {at(c)} AS a, {at('y')} AS b, count(*) AS n FROM feat GROUP BY 1, 2))"


@add(with_(FEAT) + " UNION ALL ".join(_mi(c) for c in _F))
def a42_mi_scores(spark, d):
    return M.mi_scores(features(spark, d), _F, "y", 8).withColumn("score", F.round("score", 5))


@add(with_(FEAT, "s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, y)) AS r, stddev_pop({c}) AS sd FROM feat" for c in _F) + ")") + "SELECT feature, round(0.7 * r / mr + 0.3 * sd / ms, 5) AS combined, rank FROM (SELECT *, row_number() OVER (ORDER BY 0.7 * r / mr + 0.3 * sd / ms DESC, feature) AS rank FROM s, (SELECT max(r) AS mr, max(sd) AS ms FROM s)) WHERE rank <= 3")
def w11_select_features(spark, d):
    f = features(spark, d)
    one = f.agg(*(F.struct(F.abs(F.corr(c, "y")).alias("r"), F.stddev_pop(c).alias("sd")).alias(c) for c in _F))
    s = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}.r"), F.col(f"{c}.sd")) for c in _F))).alias("s")).select("s.*")
    return M.select_features(s, 3, {"r": 0.7, "sd": 0.3}).select("feature", F.round("combined", 5).alias("combined"), "rank")


@add("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15")
def t3_top_n(spark, d):
    return M.top_n(load(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 15, ["c_custkey"])


@add(with_(ACC) + "SELECT event_id, round(lag(value) OVER w, 6) AS value_lag, round(avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS value_mean, round(var_samp(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) + 1.3e-6, 4) AS value_var FROM acc WINDOW w AS (PARTITION BY account ORDER BY ts, event_id)")
def w12_rolling_features(spark, d):
    o = M.rolling_features(access_events(spark, d), "account", ["ts", "event_id"], "value", 3)
    return o.select("event_id", r6("value_lag").alias("value_lag"), r6("value_mean").alias("value_mean"), F.round(F.col("value_var") + 1.3e-6, 4).alias("value_var"))


def _bucket(key, seed, n):
    return f"CAST(CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT) % {n} AS INT)"


@add(f"SELECT o_orderkey, {_bucket('o_orderkey', 42, 10000)} < 2000 AS is_test FROM orders")
def t8_split(spark, d):
    return M.split(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.2)


@add(f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_bucket('o_orderkey', 42, 2**31 - 1)}, o_orderkey) <= floor(count(*) OVER (PARTITION BY o_orderpriority) * 0.2) AS is_test FROM orders")
def t8_split_stratified(spark, d):
    return M.split_stratified(load(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 0.2).select("o_orderkey", "is_test")


@add(f"SELECT o_orderkey, {_bucket('o_orderkey', 42, 5)} AS fold FROM orders")
def t9_folds(spark, d):
    return M.folds(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5)


@add(f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {_bucket('o_orderkey', 1, 2**31 - 1)}, o_orderkey LIMIT 1000")
def t7_sample_n(spark, d):
    return M.sample_n(load(spark, d, "orders"), 1000, 1, "o_orderkey").select("o_orderkey", "o_custkey")


_V = "((pow(x1 - (x1+x2+x3+x4)/4, 2) + pow(x2 - (x1+x2+x3+x4)/4, 2) + pow(x3 - (x1+x2+x3+x4)/4, 2) + pow(x4 - (x1+x2+x3+x4)/4, 2)) / 4)"


@add(with_(FEAT) + f"SELECT vec_id, CAST(CASE WHEN y <= a OR y >= b THEN 4.0 WHEN {_V} > c THEN 2.0 ELSE 0.5 END AS DOUBLE) AS weight FROM feat, (SELECT quantile_cont(y, 0.05) AS a, quantile_cont(y, 0.95) AS b, quantile_cont({_V}, 0.75) AS c FROM feat)")
def t10_sample_weights(spark, d):
    return M.sample_weights(features(spark, d), "y", _F).select("vec_id", "weight")


#: Points thrown on the line of all weights, in the order of vec_id.
_DRAWN = f"""feat2 AS (SELECT *, CAST(CASE WHEN y <= a OR y >= b THEN 4.0 WHEN {_V} > c THEN 2.0 ELSE 0.5 END AS DOUBLE) AS weight FROM feat, (SELECT quantile_cont(y, 0.05) AS a, quantile_cont(y, 0.95) AS b, quantile_cont({_V}, 0.75) AS c FROM feat)),
line AS (SELECT vec_id, weight, sum(weight) OVER (ORDER BY vec_id) AS e FROM feat2),
points AS (SELECT j, (CAST('0x' || substr(md5('42:' || j), 1, 8) AS BIGINT) + 0.5) / 4294967296.0 * (SELECT sum(weight) FROM feat2) AS spot FROM (SELECT unnest(range((SELECT count(*) FROM embeddings))) AS j))"""


@add(with_(FEAT, _DRAWN) + "SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY j) AS INT) AS copy FROM points JOIN line ON spot > e - weight AND spot <= e")
def t10_weighted_sample(spark, d):
    f = features(spark, d)
    w = M.sample_weights(f, "y", _F)
    return M.weighted_sample(w, "weight", load(spark, d, "embeddings").count(), "vec_id").select("vec_id", "copy")


@add(with_(ACC) + "SELECT event_id FROM acc ORDER BY ts, event_id")
def t1_sort_events(spark, d):
    return access_events(spark, d).orderBy("ts", "event_id").select("event_id")


@add("SELECT c_custkey AS id, c_name AS label, c_acctbal AS x FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def u1_union_all(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_acctbal").alias("x"))
    s = load(spark, d, "supplier").select(F.col("s_name").alias("label"), F.col("s_suppkey").alias("id"))
    return c.unionByName(s, allowMissingColumns=True)


@add("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def u2_distinct_rows(spark, d):
    return load(spark, d, "orders").select("o_custkey", "o_orderstatus").distinct()


@add(with_(ACC) + "SELECT DISTINCT date_trunc('hour', ts) = ts AS on_hour, account, host FROM acc")
def u3_dedup(spark, d):
    e = access_events(spark, d).withColumn("on_hour", F.date_trunc("hour", "ts") == F.col("ts"))
    return e.dropDuplicates(["on_hour", "account", "host"]).select("on_hour", "account", "host")


@add(with_(ACC, DAYP) + f"SELECT account, round({' + '.join(x.lower() for x in DAYS7)}, 6) AS total, ({' + '.join(x.lower() for x in DAYS7)}) > 0.9 AS ok FROM dayp")
def v1_validate_days(spark, d):
    return M.validate_days(L.day_profile(access_events(spark, d))).withColumn("total", r6("total"))


@add(with_(ACC, HOSTP) + "SELECT account, round(sum(freq), 6) AS total, true AS ok FROM hostp GROUP BY account")
def v2_validate_hosts(spark, d):
    return M.validate_hosts(L.host_profile(access_events(spark, d))).withColumn("total", r6("total"))


@add(with_(ACC, HOURP) + "SELECT account, day, start_hour BETWEEN 0 AND 23 AND end_hour BETWEEN 0 AND 23 AS ok FROM hourp")
def v3_validate_hours(spark, d):
    return M.validate_hours(L.hour_profile(access_events(spark, d))).select("account", "day", "ok")


@add("SELECT 'doc_id' AS \"column\", count(*) FILTER (WHERE d.doc_id IS NULL) AS nulls FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id UNION ALL SELECT 'quality', count(*) FILTER (WHERE quality IS NULL) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def v4_null_counts(spark, d):
    j = load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return M.null_counts(j)


@add("SELECT * FROM (SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS n, false AS agree UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), false UNION ALL SELECT 'events', (SELECT count(*) FROM events), false)")
def v5_check_counts(spark, d):
    return M.check_counts(**{n: load(spark, d, n) for n in ("orders", "customer", "events")})


# -- scalar functions


@add("SELECT event_id, strftime(try_strptime(CASE WHEN event_id % 9 = 0 THEN 'none' ELSE strftime(ts, '%m/%d/%y %H:%M:%S') END, '%m/%d/%y %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS parsed FROM events")
def f1_parse_ts(spark, d):
    raw = F.when(F.col("event_id") % 9 == 0, "none").otherwise(F.date_format("ts", "MM/dd/yy HH:mm:ss"))
    return load(spark, d, "events").select("event_id", F.date_format(X.parse_ts(raw), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@add("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS made FROM events")
def f2_make_ts(spark, d):
    made = X.make_ts(F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"))
    return load(spark, d, "events").select("event_id", F.date_format(made, "yyyy-MM-dd HH:mm:ss").alias("made"))


@add("SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS weekday, dayname(ts) AS day, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS clock FROM events")
def f3_time_parts(spark, d):
    return load(spark, d, "events").select("event_id", F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"), F.date_format("ts", "EEEE").alias("day"), F.date_format("ts", "yyyy-MM-dd").alias("date"), X.clock(F.col("ts")).alias("clock"))


@add("SELECT event_id, " + ", ".join(f"CAST(dayname(ts) = '{x}' AS INT) AS {x.lower()}" for x in DAYS7) + " FROM events")
def f5_weekday_flags(spark, d):
    return load(spark, d, "events").select("event_id", *X.weekday_flags(F.date_format("ts", "EEEE")))


@add("SELECT event_id, " + ", ".join(f"CAST(hour(ts) = {h} AS INT) AS h{h:02d}" for h in range(24)) + " FROM events")
def f6_hour_flags(spark, d):
    return load(spark, d, "events").select("event_id", *X.hour_flags(F.col("ts")))


@add("SELECT c_custkey, upper(split_part(lower(c_name) || '.corp.local', '.', 1)) AS host FROM customer")
def f10_short_host(spark, d):
    return load(spark, d, "customer").select("c_custkey", X.short_host(F.concat(F.lower("c_name"), F.lit(".corp.local"))).alias("host"))


@add("SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR)) AS h FROM customer")
def f11_hash_id(spark, d):
    return load(spark, d, "customer").select("c_custkey", X.hash_id(F.col("c_custkey")).alias("h"))


@add(with_(ACC) + "SELECT event_id, CASE WHEN regexp_matches(lower(details), '\\.docx?$') THEN 'document' WHEN regexp_matches(lower(details), '\\.(dll|mui|exe|tmp)$') THEN 'executable' ELSE 'other' END AS kind, coalesce(regexp_matches(lower(details), '\\.(docx|txt)$'), false) AS allowed FROM acc")
def f12_file_kind(spark, d):
    return access_events(spark, d).select("event_id", X.file_kind(F.col("details")).alias("kind"), X.allowed_file(F.col("details"), ["docx", "txt"]).alias("allowed"))




@add(with_(ACC) + "SELECT event_id, coalesce(regexp_matches(lower(details), '\\.(doc|exe)$'), false) AS allowed FROM acc")
def f44_allowed_file(spark, d):
    return access_events(spark, d).select("event_id", X.allowed_file(F.col("details"), ["doc", "exe"]).alias("allowed"))


@add("SELECT doc_id, trim(split_part(text, chr(10), 1)) AS line FROM documents")
def f13_first_line(spark, d):
    return load(spark, d, "documents").select("doc_id", X.first_line(F.col("text")).alias("line"))


@add("SELECT doc_id, lang || ' - ' || source AS zipped FROM documents")
def f14_zip_concat(spark, d):
    return load(spark, d, "documents").select("doc_id", X.zip_concat(F.array("lang"), F.array("source"))[0].alias("zipped"))


@add("SELECT vec_id, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS arg FROM embeddings")
def f41_argmax(spark, d):
    return load(spark, d, "embeddings").select("vec_id", X.argmax(F.slice("embedding", 1, 10)).alias("arg"))


@add("SELECT a.vec_id, round(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: pow(z[1] - z[2], 2))) / 64, 6) AS error FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f40_reconstruction_error(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return e.join(b, "vec_id").select("vec_id", r6(X.reconstruction_error(F.col("a"), F.col("b"))).alias("error"))


@add("SELECT vec_id, round((CAST(embedding[1] AS DOUBLE) / 255.0 - 0.5) / 0.5, 6) AS first FROM embeddings")
def f42_rescale(spark, d):
    return load(spark, d, "embeddings").select("vec_id", r6(X.rescale(F.col("embedding").cast("array<double>"))[0]).alias("first"))


@add("SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, lang || ',' || source AS tags FROM documents")
def f43_stringify_ids(spark, d):
    from ..sources.io import stringify_ids

    o = stringify_ids(load(spark, d, "documents").select("doc_id", F.col("doc_id").alias("id"), F.array("lang", "source").alias("tags")), ["id"])
    return o.select("doc_id", "id", F.array_join("tags", ",").alias("tags"))
