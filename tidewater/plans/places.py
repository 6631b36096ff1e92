"""Queries over points, sites and rasters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import places as P
from .fixtures import AFFINE, PIXELS, POINTS, PRED, SITES, Registry, geo_points, load, pixels, prediction_sets, r6, sites, with_

add = Registry()
_SHAPE = (200, 200)
_LON0, _LAT0, _SIZE = AFFINE
_ROWCOL = f"CAST(floor(({_LAT0} - lat) / {_SIZE}) AS INT) AS row, CAST(floor((lon - {_LON0}) / {_SIZE}) AS INT) AS col"


def _hav(x1, y1, x2, y2):
    return f"2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))))"


def _round(df, *skip):
    return df.select(*(c if c in skip or t not in ("double", "float") else r6(c).alias(c) for c, t in df.dtypes))


_BOXES = [("Lower", -74.02, -73.92, 40.70, 40.80), ("Upper", -73.96, -73.82, 40.76, 40.90)]
_BOX = "CASE " + " ".join(f"WHEN lon BETWEEN {a} AND {b} AND lat BETWEEN {c} AND {d} THEN '{n}'" for n, a, b, c, d in _BOXES) + " ELSE 'Unknown' END"


@add(with_(POINTS) + f"SELECT point_id, {_BOX} AS region FROM points")
def p10_assign_region(spark, d):
    return geo_points(spark, d).select("point_id", X.first_box(F.col("lon"), F.col("lat"), _BOXES).alias("region"))


@add(with_(POINTS) + f"SELECT point_id, CAST({_BOX} = 'Lower' AS INT) AS is_lower, CAST({_BOX} = 'Upper' AS INT) AS is_upper FROM points")
def f24_region_flags(spark, d):
    r = X.first_box(F.col("lon"), F.col("lat"), _BOXES)
    return geo_points(spark, d).select("point_id", (r == "Lower").cast("int").alias("is_lower"), (r == "Upper").cast("int").alias("is_upper"))


_R = 500 / 111_000.0
_DIST = "sqrt(pow(lon - site_lon, 2) + pow(lat - site_lat, 2))"


@add(with_(POINTS, SITES) + f"SELECT point_id, site_id, round({_DIST}, 6) AS distance FROM points, sites WHERE abs(lon - site_lon) <= 0.0051 AND {_DIST} <= 0.005")
def j19_radius_join(spark, d):
    return P.radius_join(geo_points(spark, d), sites(spark, d), 0.005, 6).select("point_id", "site_id", "distance")


@add(with_(POINTS, SITES) + f"SELECT point_id, site_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, site_id) AS rank FROM (SELECT point_id, site_id, {_hav('lon', 'lat', 'site_lon', 'site_lat')} AS distance FROM points, sites)) WHERE rank <= 5")
def j20_knn_join(spark, d):
    return P.knn_join(geo_points(spark, d), sites(spark, d), 5).select("point_id", "site_id", r6("distance").alias("distance"), "rank")


_NTH = ", ".join([*(f"round(max(CASE WHEN rank = {n} THEN area * 1e9 END), 4) AS value{n}" for n in (1, 2, 3)), *(f"round(max(CASE WHEN rank = {n} THEN 1 / (distance + 1e-4) END), 2) AS weight{n}" for n in (1, 2, 3))])


@add(with_(POINTS, SITES) + f"SELECT point_id, round(sum(area * 1e9 / (distance + 1e-4)) / sum(1 / (distance + 1e-4)), 4) AS idw, round(avg(area * 1e9), 4) AS mean, round(stddev_pop(area * 1e9), 4) AS std, round(min(area * 1e9), 4) AS least, round(max(area * 1e9), 4) AS most, round(max(CASE WHEN rank = 1 THEN area * 1e9 END), 4) AS nearest, round(max(CASE WHEN rank = 1 THEN distance END), 4) AS nearest_km, {_NTH} FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, site_id) AS rank FROM (SELECT point_id, site_id, area, {_hav('lon', 'lat', 'site_lon', 'site_lat')} AS distance FROM points, sites)) WHERE rank <= 5 GROUP BY point_id")
def f19_idw_features(spark, d):
    s = sites(spark, d).withColumn("price", F.col("area") * 1e9)
    near = P.knn_join(geo_points(spark, d), s, 5).join(s.select("site_id", "price"), "site_id")
    out = P.idw_features(near, "price")
    return out.select("point_id", *(F.round(c, 2 if c.startswith("weight") else 4).alias(c) for c in out.columns[1:]))


@add(with_(POINTS, PIXELS, f"p AS (SELECT point_id, {_ROWCOL} FROM points)") + "SELECT point_id, p.row, p.col, round(value, 6) AS value FROM p LEFT JOIN pixels x ON p.row = x.row AND p.col = x.col")
def j22_sample_raster(spark, d):
    return P.sample_raster(geo_points(spark, d), pixels(spark, d), AFFINE).select("point_id", "row", "col", r6("value").alias("value"))


def _win(size, extra=""):
    h = size // 2
    return with_(
        POINTS, PIXELS, f"p AS (SELECT point_id, {_ROWCOL} FROM points)", f"n AS (SELECT unnest(range({size})) AS i)",
        f"spot AS (SELECT point_id, p.row AS pr, p.col AS pc, greatest(0, p.row - {h}) + a.i AS r, greatest(0, p.col - {h}) + b.i AS c, a.i AS y, b.i AS x FROM p, n a, n b WHERE p.row BETWEEN 0 AND 199 AND p.col BETWEEN 0 AND 199)",
        "win AS (SELECT s.*, coalesce(value, 0) AS v FROM spot s LEFT JOIN pixels q ON q.row = s.r AND q.col = s.c WHERE r <= 199 AND c <= 199)",
    )


def _window(spark, d, size, figures):
    """``figures`` of each point's window."""
    raster = pixels(spark, d).select("row", "col", "value")
    return P.by_pixel(geo_points(spark, d), AFFINE, lambda points: figures(P.raster_window(points, raster, size, AFFINE, _SHAPE)))


@add(_win(5) + "SELECT point_id, count(*) FILTER (WHERE near) AS n3, count(*) AS n5, round(sum(CASE WHEN near THEN v ELSE 0 END), 4) AS total3, round(sum(v), 4) AS total FROM (SELECT *, r - greatest(0, pr - 1) BETWEEN 0 AND 2 AND c - greatest(0, pc - 1) BETWEEN 0 AND 2 AS near FROM win) GROUP BY point_id")
def j23_raster_window(spark, d):
    """Windows of five and, as a part of them, three pixels."""
    sums = lambda df, n: df.groupBy("point_id").agg(F.count("*").alias(f"n{n}"), F.round(F.sum("value"), 4).alias("total" if n == 5 else "total3"))
    return _window(spark, d, 5, lambda w: sums(w, 5).join(sums(P.sub_window(w, 3), 3), "point_id"))


@add(_win(5) + """SELECT point_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.5), 6) AS median, round(min(v), 6) AS least, round(max(v), 6) AS most,
 round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(max(v) - min(v), 6) AS "range", round(sum(v * v) + 1.3e-6, 2) AS energy, round(sum(pow(v - m, 2)) + 1.3e-6, 3) AS contrast, round(-sum(v * log2(v + 1e-10)) + 1.3e-6, 3) AS entropy,
 round(CASE WHEN min(v) < max(v) THEN avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5) ELSE 0 END, 5) AS skew, round(CASE WHEN min(v) < max(v) THEN avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2) - 3 ELSE 0 END, 5) AS kurt
 FROM (SELECT *, avg(v) OVER (PARTITION BY point_id) AS m FROM win) GROUP BY point_id""")
def a23_window_stats(spark, d):
    out = _window(spark, d, 5, lambda w: P.window_stats(w, "value"))
    digits = {"energy": 2, "contrast": 3, "entropy": 3, "skew": 5, "kurt": 5}  # sums in another order may differ in their last bits
    return out.select("point_id", *(F.round(F.col(c) + (1.3e-6 if digits.get(c, 6) < 5 else 0), digits.get(c, 6)).alias(c) for c in out.columns[1:]))


@add(_win(3) + "SELECT point_id, round(-sum(v * log2(v + 1e-10)) + 1.3e-6, 3) AS entropy FROM win GROUP BY point_id")
def a23_window_entropy(spark, d):
    o = _window(spark, d, 5, lambda w: P.window_stats(P.sub_window(w, 3), "value"))
    return o.select("point_id", F.round(F.col("entropy") + 1.3e-6, 3).alias("entropy"))


_DISC = {"mean": "avg(v)", "std": "stddev_pop(v)", "median": "quantile_cont(v, 0.5)", "least": "min(v)", "most": "max(v)", "skew": "CASE WHEN min(v) < max(v) THEN avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5) ELSE 0 END", "iqr": "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)"}


@add(_win(5) + "SELECT point_id, " + ", ".join(f"CASE WHEN count(*) = 13 THEN round({e}, 5) ELSE 0 END AS {n}" for n, e in _DISC.items()) + " FROM (SELECT *, avg(v) OVER (PARTITION BY point_id) AS m FROM win WHERE pow(y - 2, 2) + pow(x - 2, 2) <= 4) GROUP BY point_id")
def a24_disc_stats(spark, d):
    o = _window(spark, d, 7, lambda w: P.disc_stats(w, "value", 2))
    return o.select("point_id", *(F.round(c, 5).alias(c) for c in o.columns[1:]))


def _texture_sql(size):
    """The same sums as joins of cells with weights of their neighbours; ``mirror`` folds an index back into 0..n-1."""
    mirror = lambda i, n: f"(CASE WHEN ({i}) < 0 THEN -1 - ({i}) WHEN ({i}) >= {n} THEN 2 * {n} - 1 - ({i}) ELSE ({i}) END)"
    return _win(size) + f"""
 , cell AS (SELECT point_id, y, x, v, max(y) OVER (PARTITION BY point_id) + 1 AS h, max(x) OVER (PARTITION BY point_id) + 1 AS w FROM win)
 , g AS (SELECT o, exp(-0.5 * o * o) / sum(exp(-0.5 * o * o)) OVER () AS k FROM (SELECT unnest(range(-4, 5)) AS o))
 , down AS (SELECT a.point_id, a.y, a.x, a.h, a.w, sum(b.v * k) AS v FROM cell a CROSS JOIN g JOIN cell b ON b.point_id = a.point_id AND b.x = a.x AND b.y = {mirror('a.y + o', 'a.h')} GROUP BY ALL)
 , soft AS (SELECT a.point_id, a.y, a.x, a.h, a.w, sum(b.v * k) AS v FROM down a CROSS JOIN g JOIN down b ON b.point_id = a.point_id AND b.y = a.y AND b.x = {mirror('a.x + o', 'a.w')} GROUP BY ALL)
 , n3 AS (SELECT unnest(range(-1, 2)) AS o)
 , slope AS (SELECT a.point_id, a.y, a.x, sum(b.v * i.o * (2 - abs(j.o))) AS gy, sum(b.v * j.o * (2 - abs(i.o))) AS gx, sum(b.v * CASE WHEN i.o = 0 AND j.o = 0 THEN -4 WHEN i.o = 0 OR j.o = 0 THEN 1 ELSE 0 END) AS lap
   FROM soft a CROSS JOIN n3 i CROSS JOIN n3 j JOIN soft b ON b.point_id = a.point_id AND b.y = {mirror('a.y + i.o', 'a.h')} AND b.x = {mirror('a.x + j.o', 'a.w')} GROUP BY ALL)
 , step AS (SELECT a.point_id, avg(CASE WHEN b.y = a.y THEN abs(a.v - b.v) END) AS across, avg(CASE WHEN b.x = a.x THEN abs(a.v - b.v) END) AS along FROM soft a JOIN soft b ON b.point_id = a.point_id AND ((b.y = a.y AND b.x = a.x + 1) OR (b.x = a.x AND b.y = a.y + 1)) GROUP BY a.point_id)
 SELECT point_id, round(avg(m), 4) AS gradient_mean, round(stddev_pop(m), 4) AS gradient_std, round(max(m), 4) AS gradient_max, round(avg(lap) + 1.3e-7, 4) + 0.0 AS laplace_mean, round(stddev_pop(lap), 4) AS laplace_std,
  round(any_value(across), 4) AS horizontal_edge, round(any_value(along), 4) AS vertical_edge, round(avg(abs(lap)), 4) AS roughness, round(avg(1 / (1 + m)), 4) AS homogeneity FROM (SELECT *, sqrt(gx * gx + gy * gy) AS m FROM slope) JOIN step USING (point_id) GROUP BY point_id"""


@add(_texture_sql(7))
def a25_window_texture(spark, d):
    o = _window(spark, d, 7, lambda w: P.window_texture(w, "value"))
    return o.select("point_id", *((F.round(F.col(c) + (1.3e-7 if c == "laplace_mean" else 0), 4) + 0.0).alias(c) for c in o.columns[1:]))


@add(with_(POINTS, SITES) + f"SELECT p.point_id, round(coalesce(n, 0) / (pi() * 0.25), 6) AS density, round(coalesce(h, 0), 6) AS mean_height, round(coalesce(a, 0) / (pi() * {_R} * {_R}), 6) AS coverage FROM points p LEFT JOIN (SELECT point_id, count(*) AS n, avg(height) AS h, sum(area) AS a FROM points, sites WHERE abs(lon - site_lon) <= 0.0051 AND {_DIST} <= {_R} GROUP BY point_id) x ON p.point_id = x.point_id")
def a21_building_features(spark, d):
    o = P.building_features(geo_points(spark, d), sites(spark, d), 500.0)
    return o.select("point_id", r6("density").alias("density"), r6("mean_height").alias("mean_height"), r6("coverage").alias("coverage"))


@add(with_(POINTS, SITES) + f"SELECT point_id, round(min(x) * 100, 7) AS nearest, count(*) FILTER (WHERE x < 0.001) AS n_near, round(coalesce(sum(area) FILTER (WHERE x < 0.002), 0) * 10000, 9) AS area_wide FROM (SELECT point_id, area, {_DIST} AS x FROM points, sites) GROUP BY point_id")
def a22_proximity_features(spark, d):
    o = P.proximity_features(geo_points(spark, d), sites(spark, d))
    return o.select("point_id", F.round("nearest", 7).alias("nearest"), "n_near", F.round("area_wide", 9).alias("area_wide"))


def _sqlratio(a, b):
    return f"({a}) / nullif({b}, 0)"


_NDVI, _NDBI = _sqlratio("nir - red", "nir + red"), _sqlratio("swir1 - nir", "swir1 + nir")
_EVI = "nir + red * 6 - blue * 7.5 + 1"
_INDEX = {
    "ndvi": _NDVI, "evi": _sqlratio("(nir - red) * 2.5", "nir + red * 6 - blue * 7.5 + 1"), "savi": _sqlratio("(nir - red) * 1.5", "nir + red + 0.5"), "ndbi": _NDBI, "bui": f"{_NDBI} - {_NDVI}", "ndwi": _sqlratio("green - nir", "green + nir"),
    "mndwi": _sqlratio("green - swir1", "green + swir1"), "ui": _sqlratio("swir2 - nir", "swir2 + nir"), "ebi": _sqlratio("swir1 + red - nir - blue", "swir1 + red + nir + blue"), "ndmi": _sqlratio("nir - swir1", "nir + swir1"),
}


@add(with_(PIXELS) + "SELECT row, col, " + ", ".join(f"round({e} + 1.3e-7, 4) + 0.0 AS {n}" if n != "evi" else f"CASE WHEN abs({_EVI}) > 1e-6 THEN round({e} + 1.3e-7, 2) + 0.0 END AS evi" for n, e in _INDEX.items()) + " FROM pixels")
def f21_spectral_indices(spark, d):
    """All pixels; near its singularity EVI is null, since its digits there hang on the order of a sum."""
    p = P.spectral_indices(pixels(spark, d)).withColumn("evi", F.when(F.abs(F.expr(_EVI)) > 1e-6, F.col("evi")))
    return p.select("row", "col", *((F.round(F.col(c) + 1.3e-7, 2 if c == "evi" else 4) + 0.0).alias(c) for c in _INDEX))


@add(with_(PIXELS) + "SELECT row, col, round(nir * 1000 * 2.75e-5 - 0.2, 6) AS nir, round(swir2 * 1000 * 0.00341802 + 149.0 - 273.15, 6) AS swir2 FROM pixels")
def f22_scale_bands(spark, d):
    p = pixels(spark, d).select("row", "col", (F.col("nir") * 1000).alias("nir"), (F.col("swir2") * 1000).alias("swir2"))
    return _round(P.scale_bands(p, ["nir"], ["swir2"]))


_POIS = [("square", -73.985, 40.758), ("park", -73.965, 40.782), ("island", -74.01, 40.71)]
_D = [_hav("lon", "lat", str(x), str(y)) for _, x, y in _POIS]
_MIN = f"least({', '.join(_D)})"


def _poi_sql():
    n, x, y = _POIS[0]
    by = f"sin(radians({x} - lon)) * cos(radians({y}))"
    bx = f"cos(radians(lat)) * sin(radians({y})) - sin(radians(lat)) * cos(radians({y})) * cos(radians({x} - lon))"
    out = {f"poi_{p[0]}": e for p, e in zip(_POIS, _D)}
    out |= {"poi_min": _MIN, "poi_mean": f"({' + '.join(_D)}) / 3", "poi_decay": f"exp(-{_MIN} / 5)", "poi_inverse": f"1 / (1 + {_MIN})", "poi_manhattan": f"(abs({y} - lat) + abs({x} - lon) * cos(radians(lat))) * 111.0", "poi_sin": f"sin(atan2({by}, {bx}))", "poi_cos": f"cos(atan2({by}, {bx}))", "poi_square": f"pow({_D[0]}, 2)", "poi_wave": f"sin({_D[0]} * pi())"}
    return out


@add(with_(POINTS) + "SELECT point_id, " + ", ".join(f"round({e}, 5) AS {n}" for n, e in _poi_sql().items()) + " FROM points")
def f17_poi_features(spark, d):
    o = P.poi_features(geo_points(spark, d), _POIS)
    return o.select("point_id", *(F.round(c, 5).alias(c) for c in _poi_sql()))


@add(with_(POINTS) + f"SELECT point_id, round({_D[0]}, 6) AS km FROM points")
def f16_haversine(spark, d):
    return geo_points(spark, d).select("point_id", r6(X.haversine(F.col("lon"), F.col("lat"), F.lit(_POIS[0][1]), F.lit(_POIS[0][2]))).alias("km"))


_HOT = _POIS
_GREEN, _WATER = [("g1", -73.97, 40.78), ("g2", -73.96, 40.66)], [("w1", -74.02, 40.72), ("w2", -73.93, 40.80)]


def _inv(ps):
    return "(" + " + ".join(f"1 / ({_hav('lon', 'lat', str(x), str(y))} + 0.1)" for _, x, y in ps) + ")"


_COOL = "least(" + ", ".join(_hav("lon", "lat", str(x), str(y)) for _, x, y in _GREEN + _WATER) + ")"
# the two nearest hot places a and b of each point
_AB = "(SELECT *, h[1].x AS ax, h[1].y AS ay, h[2].x AS bx, h[2].y AS by_, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS norm FROM (SELECT *, list_sort([" + ", ".join(f"{{'d': {e}, 'x': CAST({x} AS DOUBLE), 'y': CAST({y} AS DOUBLE)}}" for e, (_, x, y) in zip(_D, _POIS)) + "]) AS h FROM points))"
_ALONG = "((lon - ax) * (bx - ax) + (lat - ay) * (by_ - ay)) / norm"


@add(with_(POINTS) + f"SELECT point_id, round({_inv(_HOT)} / ({_inv(_GREEN)} + {_inv(_WATER)} + 0.1), 5) AS thermal_index, round(CASE WHEN {_MIN} > 0 THEN {_COOL} / {_MIN} ELSE {_COOL} END, 4) AS cool_heat_ratio, " + ", ".join(f"{' + '.join(f'CAST({e} < {km} AS INT)' for e in _D)} AS hot_{km}km" for km in (1, 3)) + f", round(({' + '.join(_D)}) / 3, 5) AS hot_mean3, CAST({_ALONG} > 0 AND {_ALONG} < {_hav('ax', 'ay', 'bx', 'by_')} AND abs((lon - ax) * (by_ - ay) - (lat - ay) * (bx - ax)) < 0.5 AS INT) AS between_hot FROM {_AB}")
def f18_thermal_features(spark, d):
    o = P.thermal_features(geo_points(spark, d), _HOT, _GREEN, _WATER)
    return o.select("point_id", F.round("thermal_index", 5).alias("thermal_index"), F.round("cool_heat_ratio", 4).alias("cool_heat_ratio"), "hot_1km", "hot_3km", F.round("hot_mean3", 5).alias("hot_mean3"), "between_hot")


@add(with_(POINTS) + f"SELECT point_id, round({_hav('lon', 'lat', 'cx', 'cy')}, 5) AS centroid_km FROM points, (SELECT avg(lon) AS cx, avg(lat) AS cy FROM points)")
def f20_centroid_distance(spark, d):
    return P.centroid_distance(geo_points(spark, d)).select("point_id", F.round("centroid_km", 5).alias("centroid_km"))


_WEATHER = "weather AS (SELECT o_orderstatus AS location, o_totalprice / 1e4 AS temp, CAST(o_orderkey % 101 AS DOUBLE) AS humidity, CAST(o_orderkey % 37 AS DOUBLE) AS wind, CAST(o_orderkey % 997 AS DOUBLE) AS solar, CAST(o_orderkey % 360 AS DOUBLE) AS direction FROM orders)"


def _weather(spark, d):
    k = F.col("o_orderkey")
    return load(spark, d, "orders").select(F.col("o_orderstatus").alias("location"), (F.col("o_totalprice") / 1e4).alias("temp"), *((k % m).cast("double").alias(n) for n, m in (("humidity", 101), ("wind", 37), ("solar", 997), ("direction", 360))))


_WAGG = "SELECT location, round(avg(temp), 5) AS temp_mean, round(max(temp), 5) AS temp_max, round(min(temp), 5) AS temp_min, round(stddev_samp(temp), 5) AS temp_std, round(avg(humidity), 5) AS humidity_mean, max(humidity) AS humidity_max, min(humidity) AS humidity_min, round(avg(wind), 5) AS wind_mean, round(avg(solar), 5) AS solar_mean, max(solar) AS solar_max, round(avg(direction), 5) AS direction_mean FROM weather GROUP BY location"


@add(with_(_WEATHER) + _WAGG)
def a20_weather_features(spark, d):
    o = P.weather_features(_weather(spark, d))
    return o.select("location", *(F.round(c, 5).alias(c) for c in o.columns[1:]))


@add(with_(POINTS, _WEATHER, f"w AS ({_WAGG})") + f"SELECT point_id, temp_mean, wind_mean FROM points LEFT JOIN w ON CASE {_BOX} WHEN 'Lower' THEN 'O' WHEN 'Upper' THEN 'F' ELSE 'X' END = location")
def j18_add_weather(spark, d):
    region = X.first_box(F.col("lon"), F.col("lat"), _BOXES)
    p = geo_points(spark, d).withColumn("location", F.when(region == "Lower", "O").when(region == "Upper", "F").otherwise("X"))
    w = P.weather_features(_weather(spark, d)).select("location", *(F.round(c, 5).alias(c) for c in ("temp_mean", "wind_mean")))
    return p.join(w, "location", "left").select("point_id", "temp_mean", "wind_mean")


@add(with_(POINTS, PRED) + "SELECT point_id, round(abs(a - b), 6) AS difference, round(abs(a - b) / nullif(abs(a), 0) * 100, 5) AS percent FROM pred")
def j25_compare_predictions(spark, d):
    a, b = prediction_sets(spark, d)
    return P.compare_predictions(a, b, ["point_id", "lon", "lat"]).select("point_id", r6("difference").alias("difference"), F.round("percent", 5).alias("percent"))


@add(with_(POINTS, PRED) + "SELECT round(avg(pow(a - b, 2)), 9) AS mse, round(sqrt(avg(pow(a - b, 2))), 9) AS rmse, round(1 - sum(pow(a - b, 2)) / (var_pop(a) * count(a)), 6) AS r2, round(avg(p), 6) AS mean_percent, round(median(p), 6) AS median_percent, round(100 - avg(p), 6) AS similarity FROM (SELECT *, abs(a - b) / nullif(abs(a), 0) * 100 AS p FROM pred)")
def a39_comparison_metrics(spark, d):
    a, b = prediction_sets(spark, d)
    o = P.comparison_metrics(P.compare_predictions(a, b, ["point_id", "lon", "lat"]))
    return o.select(*(F.round(c, 9 if "mse" in c else 6).alias(c) for c in o.columns))


@add(with_(POINTS, PRED) + "SELECT point_id, round(abs(a - b), 6) AS difference FROM pred ORDER BY round(abs(a - b), 6) DESC, point_id LIMIT 10")
def t2_top_differences(spark, d):
    a, b = prediction_sets(spark, d)
    o = P.compare_predictions(a, b, ["point_id", "lon", "lat"]).select("point_id", r6("difference").alias("difference"))
    return o.orderBy(F.desc("difference"), "point_id").limit(10)


_TRIPS = "trips AS (SELECT o_orderkey, o_orderdate + to_minutes(o_orderkey % 1440) AS pickup, o_orderdate + to_minutes(o_orderkey % 1440) + to_minutes(o_custkey % 90 + 1) AS dropoff, -74.02 + (o_custkey * 7919 % 2000) / 10000.0 AS lon, 40.70 + (o_custkey * 6007 % 2000) / 10000.0 AS lat, -74.02 + (o_orderkey * 7919 % 2000) / 10000.0 AS lon2, 40.70 + (o_orderkey * 6007 % 2000) / 10000.0 AS lat2 FROM orders)"


def _trips(spark, d):
    pt = lambda k: (F.lit(-74.02) + (k * 7919 % 2000) / 10000.0, F.lit(40.70) + (k * 6007 % 2000) / 10000.0)
    (a, b), (c, e) = pt(F.col("o_custkey")), pt(F.col("o_orderkey"))
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 1440) * 60_000_000
    return load(spark, d, "orders").select("o_orderkey", F.timestamp_micros(start).alias("pickup"), F.timestamp_micros(start + (F.col("o_custkey") % 90 + 1) * 60_000_000).alias("dropoff"), a.alias("lon"), b.alias("lat"), c.alias("lon2"), e.alias("lat2"))


@add(with_(_TRIPS) + f"SELECT o_orderkey, epoch(dropoff) - epoch(pickup) AS seconds, hour(pickup) AS hour, isodow(pickup) - 1 AS weekday, round({_hav('lon', 'lat', 'lon2', 'lat2')}, 5) AS km FROM trips")
def f4_trip_features(spark, d):
    """Duration, pickup hour and weekday, and distance of each trip."""
    return _trips(spark, d).select(
        "o_orderkey", X.duration_s(F.col("pickup"), F.col("dropoff")).alias("seconds"), F.hour("pickup").alias("hour"), F.weekday("pickup").alias("weekday"), F.round(X.haversine(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 5).alias("km")
    )


@add(with_(_TRIPS) + "SELECT CAST(floor(lon / 0.02) AS BIGINT) AS zone_x, CAST(floor(lat / 0.02) AS BIGINT) AS zone_y, hour(pickup) AS hour, count(*) AS trips FROM trips GROUP BY 1, 2, 3")
def a44_zone_demand(spark, d):
    return P.zone_demand(_trips(spark, d))


#: Dense cells, and the least cell that each can reach over cells that touch.
_ZONES = """cells AS (SELECT CAST(floor(lon / 0.02) AS BIGINT) AS zone_x, CAST(floor(lat / 0.02) AS BIGINT) AS zone_y, count(*) AS n FROM trips GROUP BY 1, 2),
dense AS (SELECT *, row_number() OVER (ORDER BY zone_x, zone_y) AS id FROM cells WHERE n >= (SELECT 1.15 * avg(n) FROM cells)),
touch AS (SELECT a.id AS a, b.id AS b FROM dense a JOIN dense b ON abs(a.zone_x - b.zone_x) <= 1 AND abs(a.zone_y - b.zone_y) <= 1),
reach AS (SELECT a, b FROM touch UNION SELECT r.a, t.b FROM reach r JOIN touch t ON r.b = t.a),
rooted AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
sized AS (SELECT root, row_number() OVER (ORDER BY sum(n) DESC, root) AS zone FROM rooted JOIN dense USING (id) GROUP BY root),
zones AS (SELECT zone, zone_x, zone_y, n FROM dense JOIN rooted USING (id) JOIN sized USING (root))"""


def _dense(spark, d):
    """Dense cells have 15 % more trips than the mean cell."""
    t = _trips(spark, d)
    mean = t.groupBy(F.floor(F.col("lon") / 0.02), F.floor(F.col("lat") / 0.02)).count().agg(F.avg("count")).first()[0]
    return t, P.zones(t, 0.02, 1.15 * (mean or 0))


@add(with_(_TRIPS, _ZONES).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT zone, zone_x, zone_y, n FROM zones")
def a44_density_zones(spark, d):
    return _dense(spark, d)[1]


@add(with_(_TRIPS, _ZONES).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT coalesce(zone, 0) AS zone, hour(pickup) AS hour, count(*) AS trips FROM trips LEFT JOIN zones ON zone_x = floor(lon / 0.02) AND zone_y = floor(lat / 0.02) GROUP BY 1, 2")
def a44_demand_by_zone(spark, d):
    return P.demand_by_zone(*_dense(spark, d))


_SITES = "sites AS (SELECT p_partkey AS site_id, CAST(p_size % 13 AS DOUBLE) AS building_density, CAST(p_size % 7 AS DOUBLE) / 10 AS building_coverage, p_retailprice / 100 AS avg_building_height, 20 + p_size % 15 + 0.5 AS temp_mean, 35.0 + p_size % 5 AS temp_max, 12.0 + p_size % 4 AS temp_min, 1.5 + (p_partkey % 9) / 10.0 AS temp_std, 25.0 + p_partkey % 20 AS lst, CAST(p_partkey % 360 AS DOUBLE) AS wind_direction_mean, CAST(p_partkey % 11 AS DOUBLE) AS wind_speed_mean, 200.0 + p_partkey % 300 AS solar_flux_mean, 40.0 + p_size AS humidity_mean, 60.0 + p_size AS humidity_max, 20.0 + p_size % 9 AS humidity_min FROM part)"
_MADE = ("building_coverage_ratio", "height_to_coverage_ratio", "temp_variation_coefficient", "temp_range", *P.PRODUCTS)


def _sites(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    return load(spark, d, "part").select(
        k.alias("site_id"), (s % 13).cast("double").alias("building_density"), ((s % 7) / 10).alias("building_coverage"), (F.col("p_retailprice") / 100).alias("avg_building_height"), (20 + s % 15 + F.lit(0.5)).alias("temp_mean"), (35.0 + s % 5).alias("temp_max"), (12.0 + s % 4).alias("temp_min"),
        (1.5 + (k % 9) / 10.0).alias("temp_std"), (25.0 + k % 20).alias("lst"), (k % 360).cast("double").alias("wind_direction_mean"), (k % 11).cast("double").alias("wind_speed_mean"), (200.0 + k % 300).alias("solar_flux_mean"), (40.0 + s).alias("humidity_mean"), (60.0 + s).alias("humidity_max"), (20.0 + s % 9).alias("humidity_min"),
    )


def _interaction_sql() -> str:
    """Each feature spelt out from the columns of a site."""
    ratio = "(building_coverage / nullif(building_density, 0))"
    plain = {"building_coverage_ratio": ratio, "height_to_coverage_ratio": "avg_building_height / nullif(building_coverage, 0)", "temp_variation_coefficient": "temp_std / temp_mean", "temp_range": "temp_max - temp_min"}
    spelt = {"building_coverage_ratio": ratio, "temp_range": "(temp_max - temp_min)", "humidity_range": "(humidity_max - humidity_min)"}
    plain |= {n: " * ".join(spelt.get(x, x) for x in c) for n, c in P.PRODUCTS.items()}
    return ", ".join(f"round({plain[n]} + 1.3e-6, 4) AS {n}" for n in _MADE)


@add(with_(_SITES) + f"SELECT site_id, {_interaction_sql()} FROM sites")
def f23_site_interactions(spark, d):
    return P.interactions(_sites(spark, d)).select("site_id", *(F.round(F.col(c) + 1.3e-6, 4).alias(c) for c in _MADE))


_BANDS = "bands AS (SELECT o_orderkey, (o_orderkey % 97 + 3) / 1e3 AS nir, (o_orderkey % 89 + 5) / 1e3 AS green, (o_orderkey % 83) / 1e3 AS swir16, (o_orderkey % 79) / 1e3 AS swir22, CAST(o_orderkey % 53 AS DOUBLE) AS pet, CAST(o_orderdate AS DATE) AS sample_date FROM orders)"
_WATER_OF = {
    "ndwi": "(green - nir) / (green + nir)", "ndmi": "(nir - swir16) / (nir + swir16)", "mndwi": "(green - swir16) / (green + swir16)", "nir_swir16": "nir / nullif(swir16, 0)", "green_swir22": "green / nullif(swir22, 0)",
    "pet_ndmi": "pet * (nir - swir16) / (nir + swir16)", "pet_mndwi": "pet * (green - swir16) / (green + swir16)", "ndmi_squared": "pow((nir - swir16) / (nir + swir16), 2)", "mndwi_squared": "pow((green - swir16) / (green + swir16), 2)",
    "log_nir": "ln(1 + nir)", "log_green": "ln(1 + green)", "log_pet": "ln(1 + pet)", "day_sin": "sin(2 * pi() * dayofyear(sample_date) / 365.25)", "day_cos": "cos(2 * pi() * dayofyear(sample_date) / 365.25)",
}


@add(with_(_BANDS) + "SELECT o_orderkey, " + ", ".join(f"round({e} + 1.3e-7, 5) + 0.0 AS {n}" for n, e in _WATER_OF.items()) + " FROM bands")
def f25_water_bands(spark, d):
    k = F.col("o_orderkey")
    b = load(spark, d, "orders").select(k, ((k % 97 + 3) / 1e3).alias("nir"), ((k % 89 + 5) / 1e3).alias("green"), ((k % 83) / 1e3).alias("swir16"), ((k % 79) / 1e3).alias("swir22"), (k % 53).cast("double").alias("pet"), F.col("o_orderdate").cast("date").alias("sample_date"))
    return P.water_features(b).select("o_orderkey", *((F.round(F.col(c) + 1.3e-7, 5) + 0.0).alias(c) for c in _WATER_OF))


_KEYED = "-74.02 + (o_custkey * 7919 % 2000) / 10000.0 AS lon, 40.70 + (o_custkey * 6007 % 2000) / 10000.0 AS lat, strftime(o_orderdate, '%d-%m-%Y') AS sample_date"


def _keyed(spark, d):
    k = F.col("o_custkey")
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.lit(-74.02) + (k * 7919 % 2000) / 10000.0).alias("lon"), (F.lit(40.70) + (k * 6007 % 2000) / 10000.0).alias("lat"), F.date_format("o_orderdate", "dd-MM-yyyy").alias("sample_date"))


_WQ = f"k AS (SELECT o_orderkey, o_totalprice, {_KEYED} FROM orders), wq AS (SELECT lon, lat, sample_date, avg(o_totalprice) / 1e3 AS alkalinity FROM k GROUP BY ALL), ls AS (SELECT lon, lat, sample_date, avg(o_orderkey % 97) AS nir FROM k WHERE o_orderkey % 11 <> 0 GROUP BY ALL), tc AS (SELECT lon, lat, sample_date, avg(o_orderkey % 53) AS pet FROM k WHERE o_orderkey % 13 <> 0 GROUP BY ALL)"


@add(with_(_WQ) + "SELECT round(w.lon, 4) AS lon, round(w.lat, 4) AS lat, w.sample_date, round(alkalinity, 5) AS alkalinity, round(nir, 5) AS nir, round(pet, 5) AS pet FROM wq w LEFT JOIN ls ON w.lon = ls.lon AND w.lat = ls.lat AND w.sample_date = ls.sample_date LEFT JOIN tc ON w.lon = tc.lon AND w.lat = tc.lat AND w.sample_date = tc.sample_date")
def j17_combine_sources(spark, d):
    k, keys = _keyed(spark, d), ["lon", "lat", "sample_date"]
    wq = k.groupBy(*keys).agg((F.avg("o_totalprice") / 1e3).alias("alkalinity"))
    ls = k.where("o_orderkey % 11 <> 0").groupBy(*keys).agg(F.avg(F.col("o_orderkey") % 97).alias("nir"))
    tc = k.where("o_orderkey % 13 <> 0").groupBy(*keys).agg(F.avg(F.col("o_orderkey") % 53).alias("pet"))
    o = P.combine_sources(wq, ls, tc, keys=keys)
    return o.select(F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"), "sample_date", *(F.round(c, 5).alias(c) for c in ("alkalinity", "nir", "pet")))


@add("SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS log_price, round(pow(o_totalprice / 1e4, 2), 6) AS square, round((o_orderkey % 97) / nullif(CAST(o_orderkey % 53 AS DOUBLE), 0), 6) AS band_ratio, round(sin(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_cos, dayofyear(o_orderdate) AS day_of_year FROM orders")
def f25_water_features(spark, d):
    k, m = F.col("o_orderkey"), F.lit(2 * math.pi) * F.month("o_orderdate") / 12
    return load(spark, d, "orders").select(
        "o_orderkey", r6(F.log1p("o_totalprice")).alias("log_price"), r6(F.pow(F.col("o_totalprice") / 1e4, F.lit(2))).alias("square"), r6(X.ratio(k % 97, k % 53)).alias("band_ratio"), (r6(F.sin(m)) + 0.0).alias("month_sin"), (r6(F.cos(m)) + 0.0).alias("month_cos"), F.dayofyear("o_orderdate").alias("day_of_year")
    )


@add(with_(_WEATHER) + "SELECT location, round(avg(temp * humidity), 4) AS temp_humidity, round(avg(temp / (wind + 1)), 5) AS temp_wind, round(avg(humidity / m), 6) AS humidity_rel FROM weather, (SELECT max(humidity) AS m FROM weather) GROUP BY location")
def f23_interactions(spark, d):
    w = _weather(spark, d)
    top = w.agg(F.max("humidity").alias("m"))
    j = w.crossJoin(F.broadcast(top))  # one row
    return j.groupBy("location").agg(F.round(F.avg(F.col("temp") * F.col("humidity")), 4).alias("temp_humidity"), F.round(F.avg(F.col("temp") / (F.col("wind") + 1)), 5).alias("temp_wind"), r6(F.avg(F.col("humidity") / F.col("m"))).alias("humidity_rel"))


@add("SELECT vec_id, neighbour, round(distance, 5) AS distance, rank FROM (SELECT a.vec_id, b.vec_id AS neighbour, d AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) AS rank FROM (SELECT a.vec_id, b.vec_id AS nb, sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: pow(z[1] - z[2], 2)))) AS d FROM (SELECT vec_id, CAST(embedding[1:4] AS DOUBLE[]) AS e FROM embeddings) a, (SELECT vec_id, CAST(embedding[1:4] AS DOUBLE[]) AS e FROM embeddings) b) x JOIN embeddings a ON a.vec_id = x.vec_id JOIN embeddings b ON b.vec_id = x.nb) WHERE rank <= 5")
def j21_knn_features(spark, d):
    from .fixtures import features

    o = P.knn_features(features(spark, d), "vec_id", ["x1", "x2", "x3", "x4"], 5)
    return o.select(F.col("id").alias("vec_id"), "neighbour", F.round("distance", 5).alias("distance"), "rank")
