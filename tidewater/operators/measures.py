"""Statistics of numeric columns and predictions: imputation, scaling,
metrics, curves, histograms, feature scores, sampling and validation."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..session import settle

# -- order statistics and running sums of whole tables

#: Rows of which one task takes a percentile.
EXACT_ROWS = 1_000_000


def quantiles(df: DataFrame, wanted: Sequence[tuple[str, float]], most: int = EXACT_ROWS) -> list[float | None]:
    """The exact quantile q of a column, between two values in proportion, for
    each (column, q); nulls and NaN do not count, None without any value.

    Approximate quantiles, whose error of rank is bounded, bracket each; the
    rows below and inside are counted, and again, until a bracket has ``most``
    rows. Only its values meet in a task, and only numbers come to the driver.
    """
    v = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c, _ in wanted]
    inside = list(df.agg(*(F.count(x).alias(f"n{i}") for i, x in enumerate(v))).first())
    at = [q * (n - 1) for (_, q), n in zip(wanted, inside)]
    ends, below = [(float("-inf"), float("inf"))] * len(v), [0] * len(v)
    within = lambda i: F.when(v[i].between(*ends[i]), v[i])
    wide, whole = [i for i, n in enumerate(inside) if n > most], list(inside)
    while wide:
        part = {i: (at[i] - below[i]) / (inside[i] - 1) for i in wide}
        some = df.agg(*(F.percentile_approx(within(i), [max(0.0, part[i] - 3e-4), min(1.0, part[i] + 3e-4)], 10_000).alias(f"e{i}") for i in wide)).first()
        for i in wide:
            a, b = some[f"e{i}"]
            ends[i] = (a if part[i] > 3e-4 else ends[i][0], b if part[i] < 1 - 3e-4 else ends[i][1])
        n = df.agg(*(F.count_if(v[i] < ends[i][0]).alias(f"b{i}") for i in wide), *(F.count(within(i)).alias(f"n{i}") for i in wide)).first()
        # where one value repeats, a bracket may keep most rows: these are few values then
        again = [i for i in wide if most < n[f"n{i}"] < inside[i] / 2]
        for i in wide:
            below[i], inside[i] = n[f"b{i}"], n[f"n{i}"]
        wide = again
    share = lambda i: wanted[i][1] if inside[i] == whole[i] else min(1.0, max(0.0, (at[i] - below[i]) / max(1, inside[i] - 1)))
    return list(df.agg(*(F.percentile(within(i), F.lit(share(i))).alias(f"q{i}") for i in range(len(v)))).first())


def running_sums(df: DataFrame, by: str, sums: Mapping[str, str], descending: bool = False, cuts: int | None = None) -> DataFrame:
    """``df``, a row a value of ``by``, with sums (new name: column) over all
    rows up to each in that order. ``df`` is made once and written in ranges of
    ``by`` (``cuts`` of them, else as many as adaptive execution finds fit);
    each is summed up by itself, so no task sorts the whole table."""
    ranges = df.repartitionByRange(cuts, by) if cuts else df.repartitionByRange(by)
    ranged = settle(ranges.withColumn("_r", F.spark_partition_id()))
    down = F.desc if descending else F.asc
    ahead = Window.orderBy(down("_r")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = ranged.groupBy("_r").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    totals = totals.select("_r", *(F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(f"_t_{n}") for n in sums))
    here = Window.partitionBy("_r").orderBy(down(by)).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(totals), "_r")  # a row a range: at most spark.sql.shuffle.partitions or ``cuts``
    return out.select(*df.columns, *((F.sum(c).over(here) + F.col(f"_t_{n}")).alias(n) for n, c in sums.items()))


# -- cleaning


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    ok = F.lit(True)
    for c in columns:
        ok = ok & X.finite(F.col(c))
    return df.where(ok)


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    middle = dict(zip(columns, quantiles(df, [(c, 0.5) for c in columns])))
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(middle[c]).cast("double")) for c in columns})


def winsorize(df: DataFrame, columns: Sequence[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    ends = quantiles(df, [(c, q) for c in columns for q in (lo, hi)])
    return df.withColumns({c: F.greatest(F.lit(a).cast("double"), F.least(F.lit(b).cast("double"), F.col(c))) for c, a, b in zip(columns, ends[::2], ends[1::2])})


def calibrate(df: DataFrame, column: str, lo: float = 0.92, hi: float = 1.09) -> DataFrame:
    """To [lo, hi] by least and largest, then the tails beyond the 2nd and 98th percentile halved."""
    ends = df.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    scaled = df.crossJoin(F.broadcast(ends)).withColumn("calibrated", lo + F.try_divide(F.col(column) - F.col("_a"), F.col("_b") - F.col("_a")) * (hi - lo)).drop("_a", "_b")
    p, q = (F.lit(x).cast("double") for x in quantiles(scaled, [("calibrated", 0.02), ("calibrated", 0.98)]))
    c = F.col("calibrated")
    return scaled.withColumn("calibrated", F.when(c < p, p - (p - c) / 2).when(c > q, q + (c - q) / 2).otherwise(c))


def min_max(df: DataFrame, column: str, top: float = 10.0, digits: int = 2) -> DataFrame:
    ends = df.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    x = F.try_divide(F.col(column) - F.col("_a"), F.col("_b") - F.col("_a")) * top
    return df.crossJoin(F.broadcast(ends)).withColumn("scaled", F.round(x, digits)).drop("_a", "_b")


def zscore_anomalies(df: DataFrame, column: str, z: float = 3.0) -> DataFrame:
    m = df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    out = df.crossJoin(F.broadcast(m)).withColumn("z", F.try_divide(F.col(column) - F.col("_m"), F.col("_s"))).drop("_m", "_s")
    return out.where(F.abs("z") > z)


def standard_scale(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    m = train.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    out = test.crossJoin(F.broadcast(m)).withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)) for c in columns})
    return out.drop(*(f"_{n}_{c}" for c in columns for n in "ms"))


def robust_scale(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    m = quantiles(train, [(c, q) for c in columns for q in (0.25, 0.5, 0.75)])
    number = lambda x: F.lit(x).cast("double")
    return test.withColumns({c: F.coalesce(F.try_divide(F.col(c) - number(m[3 * i + 1]), number(m[3 * i + 2]) - number(m[3 * i])), F.lit(0.0)) for i, c in enumerate(columns)})


#: The numerators and denominators of algorithm AS 241 (Wichura, Applied Statistics 1988), by rising powers.
NORMAL_MIDDLE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
NORMAL_NEAR = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
NORMAL_FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def normal_quantile(p: Column) -> Column:
    """The inverse of the normal distribution function, for p between 0 and 1."""

    def ratio(parts: tuple, x: Column) -> Column:
        up, down = (reduce(lambda s, c: s * x + c, reversed(y[:-1]), F.lit(y[-1])) for y in parts)
        return up / down

    q = p - 0.5
    r = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1 - p)))
    tail = F.when(r <= 5, ratio(NORMAL_NEAR, r - 1.6)).otherwise(ratio(NORMAL_FAR, r - 5))
    return F.when(F.abs(q) <= 0.425, q * ratio(NORMAL_MIDDLE, 0.180625 - q * q)).otherwise(F.when(q < 0, -tail).otherwise(tail))


def landmarks(df: DataFrame, column: str, most: int = 1000) -> list[float]:
    """Up to ``most`` exact quantiles of a column at equal steps from its least
    to its largest value, between two values in proportion. Equal values are
    counted first and running sums give their ranks; what comes to the driver
    are the values at the wanted ranks."""
    v = F.col(column).cast("double")
    counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("_v")).agg(F.count("*").alias("_n"))
    n = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    m = min(most, n)
    if n < 2:
        return [r[0] for r in counts.select("_v").collect()]
    # landmark i stands at i * (n - 1) / (m - 1); of it the whole part and, if anything is left, the next rank
    low = lambda rank: F.expr(f"({rank} * {m - 1}L + {n - 2}L) div {n - 1}L")  # noqa: E731  (first i at or behind a rank)
    ranked = running_sums(counts, "_v", {"_upto": "_n"}).withColumn("_from", F.col("_upto") - F.col("_n"))
    at = ranked.withColumns({"a": low("_from"), "b": low("_upto") - 1})
    whole = at.where("a <= b").select("_v", F.explode(F.sequence("a", "b")).alias("i"), F.lit(0).alias("next"))
    part = at.withColumns({"a": F.greatest(low("(_from - 1)"), F.lit(0)), "b": low("(_upto - 1)") - 1}).where("a <= b")
    part = part.select("_v", F.explode(F.sequence("a", "b")).alias("i"), F.lit(1).alias("next"))
    found = {(r["i"], r["next"]): r["_v"] for r in whole.unionByName(part).collect()}  # 2 * ``most`` rows
    out = []
    for i in range(m):
        rest = i * (n - 1) % (m - 1) / (m - 1)
        a = found[i, 0]
        out.append(a + (found[i, 1] - a) * rest if rest else a)
    return out


def quantile_normal(train: DataFrame, test: DataFrame, columns: Sequence[str], most: int = 1000) -> DataFrame:
    """``test`` with each column mapped to a normal distribution: its place
    among the :func:`landmarks` of ``train`` (where several are equal, the
    middle of them), then the normal quantile, within those of 10^-7 and
    1 - 10^-7. Nulls stay; without values in ``train`` all become null."""
    for c in columns:
        marks = landmarks(train, c, most)
        x = F.col(c).cast("double")
        if len(marks) < 2:
            at = F.when(x.isNotNull() & ~F.isnan(x), F.when(x < marks[0], 0.0).when(x > marks[0], 1.0).otherwise(0.0)) if marks else F.lit(None).cast("double")
        else:
            test = test.crossJoin(F.broadcast(test.sparkSession.createDataFrame([(marks,)], "_marks array<double>")))  # one row
            array = F.col("_marks")

            def below(or_equal: bool) -> Column:
                """How many landmarks are below x, by halving."""
                start = F.struct(F.lit(0).alias("lo"), F.lit(len(marks)).alias("hi"))

                def halve(s: Column, _: Column) -> Column:
                    mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
                    mark = F.element_at(array, F.least(mid, F.lit(len(marks) - 1)) + 1)
                    goes = (s["lo"] < s["hi"]) & ((mark <= x) if or_equal else (mark < x))
                    return F.struct(F.when(goes, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(goes, s["hi"]).otherwise(mid).alias("hi"))

                return F.aggregate(F.sequence(F.lit(1), F.lit(len(marks).bit_length())), start, halve, lambda s: s["lo"])

            # columns of their own, so that each is worked out once
            test = test.withColumns({"_lo": below(False), "_hi": below(True)})
            lo, hi = F.col("_lo"), F.col("_hi")
            mark = lambda i: F.element_at(array, F.greatest(F.least(i, F.lit(len(marks))), F.lit(1)))
            between = lo - 1 + X.ratio(x - mark(lo), mark(lo + 1) - mark(lo))
            at = F.when(hi > lo, (lo + hi - 1) / 2).otherwise(between) / (len(marks) - 1)
            at = F.when(x.isNotNull() & ~F.isnan(x), F.when(x - 1e-7 < marks[0], 0.0).when(x + 1e-7 > marks[-1], 1.0).otherwise(at))
        test = test.withColumn("_p", F.when(at.isNotNull(), F.greatest(F.least(at, F.lit(1 - 1e-7)), F.lit(1e-7))))
        test = test.withColumn(c, normal_quantile(F.col("_p"))).drop("_lo", "_hi", "_p", "_marks")
    return test


def polynomial(df: DataFrame, columns: Sequence[str], interaction_only: bool = False) -> DataFrame:
    """Products of two columns, and squares."""
    out = {}
    for i, a in enumerate(columns):
        for b in columns[i + interaction_only :]:
            out[f"{a}_{b}"] = F.col(a) * F.col(b)
    return df.withColumns(out)


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """Rank of each value among the distinct values; only these are ordered. Null has none."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_one", F.lit(1))
    codes = running_sums(values, column, {"code": "_one"}).select(column, (F.col("code") - 1).cast("int").alias("code"))
    return df.join(codes, column, "left")


# -- summaries


def prediction_stats(df: DataFrame, column: str) -> DataFrame:
    (middle,) = quantiles(df, [(column, 0.5)])
    return df.agg(
        F.count("*").alias("n"), F.count_if(F.col(column).isNull()).alias("nulls"), F.avg(column).alias("mean"), F.lit(middle).cast("double").alias("median"), F.stddev_samp(column).alias("std"), F.min(column).alias("least"), F.max(column).alias("most")
    )


def station_averages(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    return df.groupBy(F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat")).agg(*(F.round(F.avg(c), 2).alias(c) for c in targets), F.count("*").alias("n"))


def target_stats(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    return df.agg(*(f(c).alias(f"{c}_{n}") for c in targets for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))), F.count_distinct("lon", "lat").alias("stations"))


def histogram(df: DataFrame, column: str, bins: int = 12) -> DataFrame:
    """Equal-width bins, the largest value in the last, empty bins kept: bin, n."""
    ends = df.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    at = F.floor(F.coalesce(F.try_divide((F.col(column) - F.col("_a")) * bins, F.col("_b") - F.col("_a")), F.lit(0.0)))
    counts = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.least(F.lit(bins - 1), at).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").fillna(0)  # ``bins`` rows


def class_counts(df: DataFrame, column: str) -> DataFrame:
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row a class


def best_model(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """The model of the highest score for each target; ties to the first by name."""
    long = df.unpivot("model", list(targets), "target", "score")
    return long.groupBy("target").agg(F.min(F.struct((-F.col("score")).alias("s"), "model")).alias("b")).select("target", F.col("b.model").alias("model"), (-F.col("b.s")).alias("score"))


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    mse = F.avg(e * e)
    return df.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(mse, F.var_pop(y))).alias("r2"), (100 * (1 - F.try_divide(F.sqrt(mse), F.avg(y)))).alias("accuracy"))


def _rates(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    pr, rc = X.ratio(tp, tp + fp), X.ratio(tp, tp + fn)
    return df.withColumns(
        {"precision": pr, "recall": rc, "f1": F.try_divide(2 * pr * rc, pr + rc), "accuracy": X.ratio(tp + tn, tp + fp + fn + tn), "fpr": X.ratio(fp, fp + tn), "tnr": X.ratio(tn, fp + tn)}
    )


def classification_metrics(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label) == 1, F.col(predicted) == 1
    counts = [F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")]
    return _rates(df.groupBy(*by).agg(*counts) if by else df.agg(*counts))


def threshold_sweep(df: DataFrame, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Metrics at each threshold (score above it is positive), from one pass:
    rows are counted between thresholds, the counts are summed up."""
    ts = sorted(thresholds)
    step = sum((F.when(F.col(score) > t, 1).otherwise(0) for t in ts), F.lit(0))
    parts = df.groupBy(step.alias("step")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    grid = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(ts)], "i int, threshold double")
    above = F.col("step") >= F.col("i")
    found = grid.join(F.broadcast(parts), F.lit(True), "left").groupBy("threshold").agg(  # a row a step
        *(F.coalesce(F.sum(F.when(c, v).otherwise(0)), F.lit(0)).alias(n) for n, c, v in (("tp", above, F.col("p")), ("fp", above, F.col("n")), ("fn", ~above, F.col("p")), ("tn", ~above, F.col("n"))))
    )
    return _rates(found)


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """score, p, n, tp, fp: rows of each distinct score, and at or above it."""
    counts = df.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    return running_sums(counts, "score", {"tp": "p", "fp": "n"}, descending=True)


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    parts = roc_curve(df, score, label).withColumn("area", F.col("n") * (2 * F.col("tp") - F.col("p")) / 2)
    return parts.agg(F.try_divide(F.sum("area"), (F.max("tp") * F.max("fp")).cast("double")).alias("auc"))


def dataset_summary(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("distinct_keys"))


def top_n(df: DataFrame, column: str, n: int, ties: Sequence[str]) -> DataFrame:
    return df.orderBy(F.desc(column), *ties).limit(n)


def rolling_features(df: DataFrame, key: str, order: Sequence[str], value: str, n: int = 3) -> DataFrame:
    by = Window.partitionBy(key).orderBy(*order)
    rows = by.rowsBetween(-(n - 1), 0)
    return df.withColumns({f"{value}_lag": F.lag(value).over(by), f"{value}_mean": F.avg(value).over(rows), f"{value}_var": F.var_samp(value).over(rows)})


# -- feature scores


def f_scores(df: DataFrame, columns: Sequence[str], y: str) -> DataFrame:
    """feature, score: r^2 / (1 - r^2) * (n - 2)."""
    one = df.agg(F.count("*").alias("n"), *(F.corr(c, y).alias(c) for c in columns))
    long = one.unpivot("n", list(columns), "feature", "r")
    return long.select("feature", (F.try_divide(F.col("r") * F.col("r"), 1 - F.col("r") * F.col("r")) * (F.col("n") - 2)).alias("score"))


def mi_scores(df: DataFrame, columns: Sequence[str], y: str, bins: int = 8) -> DataFrame:
    """feature, score: mutual information of quantile bins of each feature and of y."""
    every = [*columns, y]
    ends = quantiles(df, [(c, i / bins) for c in every for i in range(1, bins)])
    at = {c: sum((F.when(F.col(c) > e, 1).otherwise(0) for e in ends[(bins - 1) * i : (bins - 1) * (i + 1)]), F.lit(0)) for i, c in enumerate(every)}
    binned = df.select(at[y].alias("b"), *(at[c].alias(c) for c in columns))
    counts = binned.unpivot("b", list(columns), "feature", "a").groupBy("feature", "a", "b").count()
    n = F.sum("count").over(Window.partitionBy("feature"))
    pa, pb = F.sum("count").over(Window.partitionBy("feature", "a")), F.sum("count").over(Window.partitionBy("feature", "b"))
    part = F.col("count") / n * F.log(F.col("count") * n / (pa * pb))
    return counts.select("feature", part.alias("part")).groupBy("feature").agg(F.sum("part").alias("score"))


def select_features(scores: DataFrame, k: int, weights: dict[str, float]) -> DataFrame:
    """The ``k`` best by a weighted sum of scores, each relative to its largest."""
    whole = Window.partitionBy()  # a row a feature
    total = sum((F.coalesce(F.try_divide(F.col(c), F.max(c).over(whole)), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return scores.withColumn("combined", total).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("combined"), "feature"))).where(F.col("rank") <= k)


# -- splits and samples


def bucket(key: Column | str, seed: int, n: int) -> Column:
    """A bucket 0..n-1 that depends on key and seed only, computable anywhere:
    the first 8 hex digits of an MD5."""
    key = F.col(key) if isinstance(key, str) else key
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long") % n).cast("int")


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in (0, 1) that depends on seed and keys only, like :func:`bucket`."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    whole = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in parts))), 1, 8), 16, 10)
    return (whole.cast("double") + 0.5) / 2.0**32


def beta_variate(a: float, b: float, seed: int, *keys: Column | str, tries: int = 24) -> Column:
    """A beta(a, b) number for shapes up to 1, by Johnk's rejection: the first
    pair of powers of uniform numbers with a sum of at most 1. At shapes of 1/2
    one key in 10^16 uses all ``tries``; the last pair is then taken as it is."""
    both = F.transform(F.sequence(F.lit(1), F.lit(tries)), lambda i: F.struct(F.pow(uniform(seed, *keys, i, F.lit("a")), F.lit(1 / a)).alias("x"), F.pow(uniform(seed, *keys, i, F.lit("b")), F.lit(1 / b)).alias("y")))
    first = F.coalesce(F.try_element_at(F.filter(both, lambda p: p["x"] + p["y"] <= 1), F.lit(1)), F.element_at(both, -1))
    return first["x"] / (first["x"] + first["y"])


def normal_variate(seed: int, *keys: Column | str) -> Column:
    """A standard normal number, by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys, F.lit("a")))) * F.cos(F.lit(2 * math.pi) * uniform(seed, *keys, F.lit("b")))


def split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    return df.withColumn("is_test", bucket(key, seed, 10_000) < F.lit(int(round(test * 10_000))))


def split_stratified(df: DataFrame, key: str, by: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """The first part of each class in an order by hash. Slices of the hash are
    counted and placed by the rows before them; rows are ordered in their slice only."""
    rows = df.withColumn("_b", bucket(key, seed, 2**31 - 1)).withColumn("_s", F.shiftright("_b", 11))
    whole = Window.partitionBy(by)  # at most 2 ** 20 slices a class
    slices = rows.groupBy(by, "_s").count()
    slices = slices.select(F.col(by).alias("_c"), F.col("_s").alias("_k"), F.coalesce(F.sum("count").over(whole.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"), F.floor(F.sum("count").over(whole) * test).alias("_most"))
    here = F.row_number().over(Window.partitionBy(by, "_s").orderBy("_b", key))
    placed = rows.withColumn("_n", here).join(slices, F.col(by).eqNullSafe(F.col("_c")) & (F.col("_s") == F.col("_k")))
    return placed.select(*df.columns, (F.col("_ahead") + F.col("_n") <= F.col("_most")).alias("is_test"))


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", bucket(key, seed, k))


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    return df.orderBy(bucket(key, seed, 2**31 - 1), key).limit(n)


def sample_weights(df: DataFrame, y: str, columns: Sequence[str]) -> DataFrame:
    """Weight 4 at or beyond the 5th or 95th percentile of y; between them 2
    where the variance of a row's features is above its 75th percentile, else 0.5."""
    every = F.array(*columns)
    mean = F.aggregate(every, F.lit(0.0), lambda s, x: s + x) / len(columns)
    rows = df.withColumn("_m", mean).withColumn("_v", F.aggregate(every, F.lit(0.0), lambda s, x: s + (x - F.col("_m")) * (x - F.col("_m"))) / len(columns))
    low, high, wide = (F.lit(x).cast("double") for x in quantiles(rows, [(y, 0.05), (y, 0.95), ("_v", 0.75)]))
    w = F.when((F.col(y) <= low) | (F.col(y) >= high), 4.0).when(F.col("_v") > wide, 2.0).otherwise(0.5)
    return rows.withColumn("weight", w).drop("_m", "_v")


def weighted_sample(df: DataFrame, weight: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows drawn with replacement, each in proportion to its
    weight; a row's draws are numbered in ``copy``. ``key`` is unique.

    ``n`` points are thrown on the line of all weights, laid end to end in the
    order of the key. Points and rows meet in cells of equal length, of which
    there are as many as rows, so neither a heavy row nor a crowd of light ones
    gathers many pairs. Rows without a positive weight are never drawn.
    """
    rows = df.where(F.col(weight) > 0).withColumn("_w", F.col(weight).cast("double"))
    whole, count = rows.agg(F.sum("_w"), F.count("*")).first()
    if not count:
        return df.limit(0).withColumn("copy", F.lit(1))
    cell = float(whole) / count
    ahead = running_sums(rows, key, {"_end": "_w"}).withColumn("_start", F.col("_end") - F.col("_w"))
    held = ahead.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_start") / cell), F.floor(F.col("_end") / cell))))
    points = df.sparkSession.range(n).select(F.col("id").alias("_j"), (uniform(seed, "id") * float(whole)).alias("_at"))
    met = points.withColumn("_cell", F.floor(F.col("_at") / cell)).join(held, "_cell").where("_at > _start AND _at <= _end")
    return met.withColumn("copy", F.row_number().over(Window.partitionBy(key).orderBy("_j"))).select(*df.columns, "copy")


# -- columns and validation


def project(df: DataFrame, columns: Sequence[str], kind: str = "string") -> DataFrame:
    """The named columns in order; missing ones are null."""
    return df.select(*(c if c in df.columns else F.lit(None).cast(kind).alias(c) for c in columns))


def sanitize_columns(df: DataFrame) -> DataFrame:
    seen: set[str] = set()
    names = []
    for i, c in enumerate(df.columns):
        name = re.sub(r"[^A-Za-z0-9_]", "", c)
        name = f"{name}_{i}" if name in seen else name
        seen.add(name)
        names.append(name)
    return df.toDF(*names)


def null_counts(df: DataFrame) -> DataFrame:
    one = df.agg(F.lit(0).alias("_"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return one.unpivot("_", df.columns, "column", "nulls").drop("_")


def validate_days(profile: DataFrame) -> DataFrame:
    """account, total, ok: shares of the week sum to more than 0.9 and at most 1."""
    total = sum((F.col(d.lower()) for d in X.DAYS), F.lit(0.0))
    return profile.select("account", total.alias("total"), ((total > 0.9) & (total <= 1 + 1e-9)).alias("ok"))


def validate_hosts(freq: DataFrame) -> DataFrame:
    good = F.min(((F.col("freq") > 0) & (F.col("freq") <= 1)).cast("int")) == 1
    return freq.groupBy("account").agg(F.sum("freq").alias("total"), good.alias("_g")).select("account", "total", (F.col("_g") & (F.abs(F.col("total") - 1) <= 0.01)).alias("ok"))


def validate_hours(hours: DataFrame) -> DataFrame:
    return hours.withColumn("ok", F.col("start_hour").between(0, 23) & F.col("end_hour").between(0, 23))


def check_counts(**named: DataFrame) -> DataFrame:
    out = None
    for n, df in named.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    whole = Window.partitionBy()  # a row a table
    return out.withColumn("agree", F.min("n").over(whole) == F.max("n").over(whole))
