"""Models on Spark ML, and per-key models in grouped helpers."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.expressions import CASES
from ..session import settle
from .large_users import Blocks, runs
from .large_users import fit as large_fit
from .logs import LOCKS, UNLOCKS, assign_scenario, day_profile, hour_profile, unlock_ratio, weekday_class
from .measures import beta_variate, bucket, folds, normal_variate, quantiles, regression_metrics, split_stratified, uniform, weighted_sample
from .places import knn_features

REGRESSORS = {
    "forest": lambda seed: RandomForestRegressor(numTrees=20, maxDepth=5, seed=seed),
    "boosted": lambda seed: GBTRegressor(maxIter=20, maxDepth=3, seed=seed),
    "linear": lambda seed: LinearRegression(regParam=1e-6),
}


def assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df)


def cluster_points(df: DataFrame, columns: Sequence[str], k: int = 5, seed: int = 1) -> DataFrame:
    data = assembled(df, columns)
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(data).transform(data).drop("features")


def pca_reduce(df: DataFrame, columns: Sequence[str], keep: float = 0.99) -> DataFrame:
    """As many components as hold ``keep`` of the variance, as an array column."""
    data = assembled(df, columns)
    model = PCA(k=len(columns), inputCol="features", outputCol="_p").fit(data)
    n = int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), keep) + 1)
    return model.transform(data).withColumn("components", F.slice(vector_to_array("_p"), 1, min(n, len(columns)))).drop("_p", "features")


def fit_regressor(df: DataFrame, key: str, columns: Sequence[str], y: str, kind: str = "forest", k: int = 5, seed: int = 1) -> DataFrame:
    """Metrics of each fold, the model trained on the others."""
    data = folds(assembled(df, columns), key, k, seed).cache()
    out = None
    for i in range(k):
        model = REGRESSORS[kind](seed).setFeaturesCol("features").setLabelCol(y).setPredictionCol("p").fit(data.where(F.col("fold") != i))
        part = regression_metrics(model.transform(data.where(F.col("fold") == i)), y, "p").withColumn("fold", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def fit_churn(df: DataFrame, columns: Sequence[str], y: str = "churned_max", key: str = "user_id", test: float = 0.2, seed: int = 1) -> DataFrame:
    """Every row with its probability ``p`` and ``is_test``: the model has not
    seen the rows held out, ``test`` of each class."""
    data = split_stratified(assembled(df, columns), key, y, test, seed)
    model = GBTClassifier(featuresCol="features", labelCol=y, maxIter=10, maxDepth=3, seed=seed).fit(data.where("NOT is_test"))
    return model.transform(data).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def ridge(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    return np.linalg.solve(x.T @ x + penalty * np.eye(x.shape[1]), x.T @ y)


def moments(df: DataFrame, columns: Sequence[str], y: str, by: Sequence[str]) -> DataFrame:
    """X'X and X'y of each group by plain sums, so no group's rows meet in one task."""
    x = [*(F.col(c) for c in columns), F.lit(1.0)]
    pairs = [F.sum(a * b).alias(f"xx_{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if j >= i]
    return df.groupBy(*by).agg(*pairs, *(F.sum(a * F.col(y)).alias(f"xy_{i}") for i, a in enumerate(x)), F.count("*").alias("n"))


def regional_predict(train: DataFrame, test: DataFrame, columns: Sequence[str], y: str, region: str, least: int = 50, share: float = 0.7) -> DataFrame:
    """Ridge models of regions with more than ``least`` rows, blended with the
    global model; solved from sums, one small system a region."""
    d = len(columns) + 1

    def solve(row) -> list[float]:
        a = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                a[i, j] = a[j, i] = row[f"xx_{i}_{j}"]
        return np.linalg.solve(a + 1e-3 * np.eye(d), np.array([row[f"xy_{i}"] for i in range(d)])).tolist()

    one = solve(moments(train, columns, y, []).first())  # one row

    def solved(f: pd.DataFrame) -> pd.DataFrame:
        r = f.iloc[0]
        return pd.DataFrame({region: [r[region]], "w": [solve(r)]})

    local = moments(train, columns, y, [region]).where(F.col("n") > least).groupBy(region).applyInPandas(solved, f"{region} string, w array<double>")
    x = F.array(*(F.col(c).cast("double") for c in columns), F.lit(1.0))
    dot = lambda w: F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    everywhere = dot(F.array(*map(F.lit, one)))
    out = test.join(local, region, "left").withColumn("_g", everywhere)
    return out.withColumn("p", F.coalesce(share * dot(F.col("w")) + (1 - share) * F.col("_g"), F.col("_g"))).drop("w", "_g")


def stack_predict(train: DataFrame, test: DataFrame, key: str, columns: Sequence[str], y: str, kinds: Sequence[str] = ("forest", "linear"), k: int = 3, seed: int = 1) -> DataFrame:
    """A linear model on out-of-fold predictions of the base models."""
    data, new = folds(assembled(train, columns), key, k, seed), assembled(test, columns)
    fit = lambda kind, d, name: REGRESSORS[kind](seed).setFeaturesCol("features").setLabelCol(y).setPredictionCol(name).fit(d)
    out = None
    for i in range(k):
        part = data.where(F.col("fold") == i)
        for kind in kinds:
            part = fit(kind, data.where(F.col("fold") != i), f"p_{kind}").transform(part)
        out = part if out is None else out.unionByName(part)
    for kind in kinds:
        new = fit(kind, data, f"p_{kind}").transform(new)
    names = [f"p_{x}" for x in kinds]
    meta = LinearRegression(labelCol=y, featuresCol="features", predictionCol="p").fit(assembled(out.drop("features"), names))
    return meta.transform(assembled(new.drop("features"), names)).drop("features")


def fit_per_user(df: DataFrame, key: str, user: str, columns: Sequence[str], label: str, most: int = 20_000, seed: int = 1) -> DataFrame:
    """A logistic model a user: user, weights, bias, n.

    A hash sample bounds what one user brings to a task; it is drawn before
    the grouping.
    """
    share = df.groupBy(user).count().select(user, (F.lit(most) / F.greatest("count", F.lit(most))).alias("_s"))
    some = df.join(share, user).where(bucket(key, seed, 1_000_000) < F.col("_s") * 1_000_000)

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        x, y = f[list(columns)].to_numpy(float), f[label].to_numpy(float)
        m, s = x.mean(axis=0), x.std(axis=0)
        s[s == 0] = 1
        z, w = np.c_[(x - m) / s, np.ones(len(x))], np.zeros(x.shape[1] + 1)
        for _ in range(15):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 0.1 * np.eye(len(w))
            w = w + np.linalg.solve(h, z.T @ (y - p) - 0.1 * w)
        weights = w[:-1] / s
        return pd.DataFrame({user: [f[user].iloc[0]], "weights": [weights.tolist()], "bias": [float(w[-1] - (weights * m).sum())], "n": [len(f)]})

    return some.select(user, label, *columns).groupBy(user).applyInPandas(fit, f"{user} string, weights array<double>, bias double, n long")


#: Candidates of a user's model; ``vote`` is what at least two of them say.
CANDIDATES = ("logistic", "bayes", "stumps")
_CHOSEN = "chosen string, score double, precision double, recall double, f1 double, n long, n_unseen long, weights array<double>, bias double, squares array<double>, linear array<double>, base double, feature array<int>, edge array<double>, amount array<double>, level double"


# Users are fitted side by side: z is (users, rows, features), and t (users,
# rows) says which rows take part. What is made of one does not hang on the others.


def _logistic(z: np.ndarray, y: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = np.concatenate([z, np.ones((*y.shape, 1))], axis=2)
    across, w, on = z.transpose(0, 2, 1), np.zeros((len(z), z.shape[2])), np.arange(len(z))
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip((z[on] @ w[on, :, None])[..., 0], -30, 30)))
        h = across[on] @ (z[on] * ((p * (1 - p) + 1e-6) * t[on])[..., None]) + 0.1 * np.eye(w.shape[1])
        step = np.linalg.solve(h, across[on] @ ((y[on] - p) * t[on])[..., None] - 0.1 * w[on, :, None])[..., 0]
        w[on] += step
        on = on[np.abs(step).max(axis=1) > 1e-12]  # the others have settled
        if not len(on):
            break
    return w[:, :-1], w[:, -1]


def _bayes(z: np.ndarray, y: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of two classes of independent normal features, a quadratic in each."""
    ones = (y * t).sum(axis=1)
    squares, linear, base = np.zeros((len(z), z.shape[2])), np.zeros((len(z), z.shape[2])), np.log((ones + 1) / (t.sum(axis=1) - ones + 1))
    for sign, c in ((1, t & (y == 1)), (-1, t & (y == 0))):
        n = c.sum(axis=1)[:, None]
        m = (z * c[..., None]).sum(axis=1) / np.maximum(n, 1)
        v = np.where(n > 0, ((z - m[:, None]) ** 2 * c[..., None]).sum(axis=1) / np.maximum(n, 1) + 1e-2, 1.0)
        squares += sign * -0.5 / v
        linear += sign * m / v
        base += sign * (-0.5 * m * m / v - 0.5 * np.log(v)).sum(axis=1)
    return squares, linear, base


def _edges(z: np.ndarray, t: np.ndarray, edges: int) -> np.ndarray:
    """(users, features, edges): quantiles of the rows that take part."""
    v, n = np.sort(np.where(t[..., None], z, np.inf), axis=1), t.sum(axis=1)
    at = np.linspace(0.02, 0.98, edges) * np.maximum(n - 1, 0)[:, None]
    low = at.astype(int)
    who = np.arange(len(z))[:, None]
    a, b = v[who, low], v[who, np.minimum(low + 1, np.maximum(n - 1, 0)[:, None])]
    return np.where(a == b, a, a + (np.where(a == b, a, b) - a) * (at - low)[..., None]).transpose(0, 2, 1)


def _stumps(z: np.ndarray, y: np.ndarray, t: np.ndarray, rounds: int = 20, edges: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Boosted steps: each adds an amount where a feature is above an edge.
    feature, edge and amount of each step, a level, and whether all rows say yes."""
    who, sign, w = np.arange(len(z)), 2 * y - 1, t / np.maximum(1, t.sum(axis=1))[:, None]
    cuts = _edges(z, t, edges)
    above = (z.transpose(0, 2, 1)[:, :, None] > cuts[..., None]).reshape(len(z), -1, z.shape[1])
    cuts, weight, feature, edge, amount, level, said = cuts.reshape(len(z), -1), above.astype(float), [], [], [], np.zeros(len(z)), np.zeros(y.shape)
    for _ in range(rounds):
        right = (weight @ (w * sign)[..., None])[..., 0] * 2 - (w * sign).sum(axis=1)[:, None]  # of saying yes above and no below
        i = np.argmax(np.abs(right), axis=1)
        r = right[who, i]
        error = np.clip((1 - np.abs(r)) / 2, 1e-6, 0.5)
        a = 0.5 * np.log((1 - error) / error) * np.where(r < 0, -1.0, 1.0)
        feature.append(i // edges)
        edge.append(cuts[who, i])
        amount.append(2 * a)
        level -= a
        said += 2 * a[:, None] * above[who, i]
        w = w * np.exp(-a[:, None] * sign * np.where(above[who, i], 1, -1))
        w /= np.maximum(w.sum(axis=1), 1e-300)[:, None]
    return np.stack(feature, axis=1), np.stack(edge, axis=1), np.stack(amount, axis=1), level, said + level[:, None] > 0


def _says(z: np.ndarray, logistic: tuple, bayes: tuple, stumps: tuple) -> dict[str, np.ndarray]:
    dot = lambda x, w: (x @ w[..., None])[..., 0]
    out = {"logistic": dot(z, logistic[0]) + logistic[1][:, None] > 0, "bayes": dot(z**2, bayes[0]) + dot(z, bayes[1]) + bayes[2][:, None] > 0, "stumps": stumps[4]}
    return out | {"vote": sum(v.astype(int) for v in out.values()) >= 2}


def _metrics(y: np.ndarray, p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Precision, recall and F1, 0 where there is nothing to divide by."""
    hit = (p & (y == 1) & t).sum(axis=1).astype(float)
    precision, recall = hit / np.maximum(1, (p & t).sum(axis=1)), hit / np.maximum(1, (y * t).sum(axis=1))
    return precision, recall, np.where(hit > 0, 2 * precision * recall / np.where(hit > 0, precision + recall, 1), 0.0)


def _choose(x: np.ndarray, y: np.ndarray, real: np.ndarray, held: np.ndarray, fold: np.ndarray, k: int) -> dict[str, list]:
    """The columns of :data:`_CHOSEN` for users of like size; rows that are not ``real`` fill up."""
    held = real & np.where((held | ~real).all(axis=1)[:, None], ~held, held)
    own = real & ~held
    n = own.sum(axis=1)[:, None]
    m = (x * own[..., None]).sum(axis=1) / n
    s = np.sqrt(((x - m[:, None]) ** 2 * own[..., None]).sum(axis=1) / n)
    s[s <= 1e-12 * np.abs(m)] = 1
    z = (x - m[:, None]) / s[:, None] * real[..., None]
    models = lambda t: (_logistic(z, y, t), _bayes(z, y, t), _stumps(z, y, t))
    names, total, many = [*CANDIDATES, "vote"], np.zeros((len(x), len(CANDIDATES) + 1)), np.zeros(len(x))
    for i in range(k):
        train, test = own & (fold != i), own & (fold == i)
        ok = train.any(axis=1) & test.any(axis=1)
        said = _says(z, *models(train))
        total += np.stack([_metrics(y, said[name], test)[2] for name in names], axis=1) * ok[:, None]
        many += ok
    mean = total / np.maximum(many, 1)[:, None]
    (w, b), (sq, li, base), stumps = models(own)
    said = _says(z, (w, b), (sq, li, base), stumps)
    made = [_metrics(y, said[name], held) for name in names]
    precision, recall, f1 = (np.stack([a[i] for a in made], axis=1) for i in range(3))
    return _chosen({"mean": mean, "precision": precision, "recall": recall, "f1": f1, "n": own.sum(axis=1), "n_unseen": held.sum(axis=1), "m": m, "s": s, "logistic": (w, b), "bayes": (sq, li, base), "stumps": stumps[:4]})


def _chosen(fits: dict) -> dict[str, list]:
    """The best of the candidates and their vote by ``mean``, and the models as features come."""
    names, best, who, m, s = [*CANDIDATES, "vote"], np.argmax(np.round(fits["mean"], 9), axis=1), np.arange(len(fits["mean"])), fits["m"], fits["s"]
    (w, b), (sq, li, base), (feature, edge, amount, level) = fits["logistic"], fits["bayes"], fits["stumps"]
    flat = w / s  # back to features as they come
    return {
        "chosen": [names[i] for i in best], "score": fits["mean"][who, best], **{c: fits[c][who, best] for c in ("precision", "recall", "f1")}, "n": fits["n"], "n_unseen": fits["n_unseen"],
        "weights": list(flat), "bias": b - (flat * m).sum(axis=1),
        "squares": list(sq / s**2), "linear": list(li / s - 2 * sq * m / s**2), "base": base + (sq * m**2 / s**2 - li * m / s).sum(axis=1),
        "feature": list(feature.astype("int32")), "edge": list(edge * s[who[:, None], feature] + m[who[:, None], feature]), "amount": list(amount), "level": level,
    }


#: Rows of the users that are fitted side by side, filled up.
ROWS_AT_ONCE = 2**12


def _room(n: int) -> int:
    """Rows that a user of ``n`` gets: at most a quarter more."""
    step = max(8, 2 ** max(0, n.bit_length() - 3))
    return -(-n // step) * step


def choose_per_user(df: DataFrame, key: str, user: str, columns: Sequence[str], label: str, most: int = 20_000, k: int = 5, unseen: float = 0.05, seed: int = 1) -> DataFrame:
    """The best of several models for each user: user, ``chosen``, its mean F1
    over ``k`` folds (``score``), precision, recall and F1 on the rows held out
    (``unseen`` of the user's), row counts, and the models' numbers for
    :func:`score_chosen`.

    Candidates are a logistic model, naive Bayes, boosted stumps and the vote of
    the three, on features scaled by the training rows; on a tie the earlier
    one, the vote last. All rows take part but those with a null or NaN. Users
    of up to ``most`` rows are fitted whole in a task; the rows of larger ones
    lie in blocks of about so many, see :mod:`.large_users`.
    """
    whole = df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (*columns, label)), F.col(user).isNotNull()))
    drawn = {"_held": bucket(key, seed + 1, 10_000) < int(round(unseen * 10_000)), "_fold": bucket(key, seed + 2, k), "_key": F.col(key).cast("string")}
    some = settle(whole.select(user, label, *columns, *(c.alias(n) for n, c in drawn.items())))  # read twice
    sizes = some.groupBy(user).agg(F.count("*").alias("_n"), F.count_if("_held").alias("_unseen"))
    large = settle(sizes.where(F.col("_n") > most))
    n_large = large.count()
    if n_large:
        some, rest = some.join(large.select(user), user, "left_anti"), some

    def fit(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Whole users, their rows in one order: the same sums wherever they come from."""
        names = f[user].to_numpy()
        starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        sizes = np.diff(np.r_[starts, len(f)])
        x, y, held, fold = f[list(columns)].to_numpy(float), f[label].to_numpy(float), f["_held"].to_numpy(bool), f["_fold"].to_numpy()
        rooms = np.array([_room(int(n)) for n in sizes])
        for room in np.unique(rooms):
            alike, step = np.flatnonzero(rooms == room), max(1, ROWS_AT_ONCE // room)
            for i in range(0, len(alike), step):
                some = alike[i : i + step]
                real = np.arange(room) < sizes[some, None]
                at = np.where(real, starts[some, None] + np.arange(room), 0)
                made = _choose(x[at] * real[..., None], y[at] * real, real, held[at] & real, np.where(real, fold[at], -1), k)
                yield pd.DataFrame({user: names[starts[some]]} | made)

    def users(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in runs(frames, [user]):
            yield from fit(f)

    kind = df.schema[user].dataType.simpleString()
    # dealt by a hash of its own: rows that a join has dealt by user would be left where that join's tasks read them
    dealt = some.select("_key", "_held", "_fold", user, label, *columns).repartition(F.xxhash64(user)).sortWithinPartitions(user, "_key")
    out = dealt.mapInPandas(users, f"{user} {kind}, {_CHOSEN}")
    return out.unionByName(_choose_large(rest, large, n_large, user, columns, label, most, k)) if n_large else out


#: Large users whose models the driver holds at a time, about.
LARGE_AT_ONCE = 1000


def _choose_large(rows: DataFrame, large: DataFrame, n: int, user: str, columns: Sequence[str], label: str, most: int, k: int) -> DataFrame:
    """The rows of :func:`choose_per_user` for the ``n`` users of ``large``."""
    groups = -(-n // LARGE_AT_ONCE)
    by = Window.partitionBy("_group").orderBy(user)  # of a row a large user
    large = settle(large.withColumn("_group", F.pmod(F.xxhash64(user), F.lit(groups))).withColumn("_i", F.row_number().over(by) - 1))
    own = rows.join(large, user).select(
        "_group", "_i", F.pmod(F.xxhash64("_key"), F.ceil(F.col("_n") / most)).cast("int").alias("_block"), "_key", (F.col("_held") & (F.col("_unseen") < F.col("_n"))).alias("_held"), "_fold",
        F.col(label).cast("double").alias("_y"), *(F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)),
    )
    out = None
    for r in large.groupBy("_group").count().orderBy("_group").collect():
        here = F.col("_group") == r["_group"]
        made = _chosen(large_fit(Blocks(own.where(here), r["count"], len(columns), k), [*CANDIDATES, "vote"]))
        models = rows.sparkSession.createDataFrame(list(zip(range(r["count"]), *(np.array(v).tolist() for v in made.values()))), f"_i int, {_CHOSEN}")
        part = settle(large.where(here).select(user, "_i").join(models, "_i").drop("_i"))
        out = part if out is None else out.unionByName(part)
    return out


def score_chosen(df: DataFrame, models: DataFrame, user: str, columns: Sequence[str]) -> DataFrame:
    """``df`` with ``prediction`` (0 or 1) by each user's chosen model; rows of
    users without one, or with a null feature, have null."""
    x = F.array(*(F.col(c).cast("double") for c in columns))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    dot = lambda w, v: total(F.zip_with(w, v, lambda a, b: a * b))
    j = df.join(models.select(F.col(user).alias("_user"), *(F.col(c).alias(f"_{c}") for c in ("chosen", "weights", "bias", "squares", "linear", "base", "feature", "edge", "amount", "level"))), F.col(user) == F.col("_user"), "left").withColumn("_x", x)
    steps = F.transform(F.sequence(F.lit(1), F.size("_feature")), lambda i: F.when(F.element_at("_x", F.element_at("_feature", i) + 1) > F.element_at("_edge", i), F.element_at("_amount", i)).otherwise(0.0))
    says = {
        "logistic": dot(F.col("_weights"), F.col("_x")) + F.col("_bias") > 0,
        "bayes": dot(F.col("_squares"), F.transform("_x", lambda v: v * v)) + dot(F.col("_linear"), F.col("_x")) + F.col("_base") > 0,
        "stumps": total(steps) + F.col("_level") > 0,
    }
    j = j.withColumns({f"_says_{n}": c.cast("int") for n, c in says.items()})
    votes = sum((F.col(f"_says_{n}") for n in says), F.lit(0)) >= 2
    prediction = F.when(F.col("_chosen") == "vote", votes.cast("int"))
    for n in says:
        prediction = prediction.when(F.col("_chosen") == n, F.col(f"_says_{n}"))
    some_null = F.exists("_x", lambda v: v.isNull())
    return j.withColumn("prediction", F.when(~some_null, prediction)).select(*df.columns, "prediction")


#: Of each scenario: whether the day and the hour are normal, and the host known.
SCENARIOS = {int(name[-1]): pattern for pattern, name in CASES.items()}


def _week(df: DataFrame, hours: DataFrame, classes: DataFrame) -> DataFrame:
    """Of an account and scenario, the days that its rows can be drawn from:
    first date, number of dates, and hours. At most seven a row."""
    span = df.groupBy("account").agg(F.to_date(F.min("ts")).alias("_a"), F.to_date(F.max("ts")).alias("_b"))
    long = classes.unpivot("account", [d.lower() for d in X.DAYS], "_day", "_class")
    week = hours.withColumn("_day", F.lower("day")).join(long, ["account", "_day"]).join(span, "account")
    number = F.array_position(F.array(*(F.lit(d.lower()) for d in X.DAYS)), F.col("_day")).cast("int") - 1
    first = F.date_add("_a", F.pmod(number - F.weekday("_a"), F.lit(7)).cast("int"))
    dates = F.when(first <= F.col("_b"), F.floor(F.datediff("_b", first) / 7).cast("int") + 1).otherwise(0)
    start, end, every = F.col("start_hour"), F.col("end_hour"), F.sequence(F.lit(0), F.lit(23))
    profiled = ~((start == 0) & (end == 23))
    well_out, out = (F.filter(every, lambda h: (h < start - d) | (h > end + d)) for d in (1, 0))
    usual = F.when(profiled, F.filter(every, lambda h: (h >= start) & (h <= end))).otherwise(F.array().cast("array<int>"))
    unusual = F.when(profiled, F.when(F.size(well_out) > 0, well_out).otherwise(out)).otherwise(every)
    day = F.struct(number.alias("i"), (F.col("_class") == "normal").alias("normal"), first.alias("first"), dates.alias("dates"), usual.alias("usual"), unusual.alias("unusual"))
    return week.where(dates > 0).groupBy("account").agg(F.sort_array(F.collect_list(day)).alias("week"))


def synthesize_anomalies(df: DataFrame, hours: DataFrame, classes: DataFrame, seed: int = 1) -> DataFrame:
    """One anomalous row for each row with an account and a time: event_id,
    account, host, ts, unlocks, locks, scenario, realised, target 1.

    The scenario comes from the row's place among its account's rows. It says
    whether the weekday is one of the account's normal or abnormal ones
    (:func:`logs.weekday_class`), the hour inside that day's hours or, if there
    is one, more than an hour outside (:func:`logs.hour_profile`), and the host
    one of the account's (each in proportion to its rows) or a new one. The date
    lies between the account's first and last; locks follow its unlock ratio.
    ``realised`` is false where an account has no such day or hour: any day and
    hour is drawn then. Draws depend on event_id and seed only.
    """
    rows = df.where("account is not null and ts is not null")
    draw = lambda tag, n: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}{tag}"), F.col("event_id").cast("string"))), 1, 8), 16, 10).cast("long") % n).cast("int")
    planned = assign_scenario(rows, [F.col("ts"), F.col("event_id")]).join(_week(rows, hours, classes), "account").join(unlock_ratio(rows), "account", "left")
    want = lambda i: F.element_at(F.create_map(*(F.lit(x) for n, p in SCENARIOS.items() for x in (n, p[i]))), F.col("scenario"))
    of = lambda d: F.when(want(1), d["usual"]).otherwise(d["unusual"])
    fit = F.filter("week", lambda d: (d["normal"] == want(0)) & (F.size(of(d)) > 0))
    planned = planned.withColumn("_fit", fit).withColumn("realised", F.size("_fit") > 0)
    any_day = F.transform("week", lambda d: F.struct(d["first"].alias("first"), d["dates"].alias("dates"), F.sequence(F.lit(0), F.lit(23)).alias("hours")))
    own_days = F.transform("_fit", lambda d: F.struct(d["first"].alias("first"), d["dates"].alias("dates"), of(d).alias("hours")))
    days = F.when(F.col("realised"), own_days).otherwise(any_day)
    planned = planned.withColumn("_days", days).withColumn("_d", F.element_at("_days", draw("day", F.size("_days")) + 1))
    date = F.date_add(F.col("_d")["first"], 7 * draw("date", F.col("_d")["dates"]))
    hour = F.element_at(F.col("_d")["hours"], draw("hour", F.size(F.col("_d")["hours"])) + 1)
    ts = F.timestamp_seconds(F.unix_timestamp(date.cast("timestamp")) + hour * 3600 + draw("second", F.lit(3600)))
    # a known host is that of another row of the account, found by its number
    hosts = rows.where("host is not null").withColumn("_j", F.row_number().over(Window.partitionBy("account").orderBy("ts", "event_id")) - 1).select("account", "_j", F.col("host").alias("_host"))
    many = rows.where("host is not null").groupBy("account").agg(F.count("*").alias("_m"))
    planned = planned.join(many, "account", "left").withColumn("_j", F.when(want(2), draw("host", F.col("_m"))))
    new = F.concat(F.lit("NEW"), F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}new"), F.col("event_id").cast("string"))), 1, 12))
    unlocks = (draw("lock", F.lit(1_000_000)) < F.coalesce("unlock_ratio", F.lit(0.5)) * 1_000_000).cast("int")
    made = planned.join(hosts, ["account", "_j"], "left").withColumn("_new", ~want(2) | F.col("_host").isNull())
    return made.select(
        "event_id", "account", F.when(F.col("_new"), new).otherwise(F.col("_host")).alias("host"), ts.alias("ts"), unlocks.alias("unlocks"), (1 - unlocks).alias("locks"), "scenario", (F.col("realised") & (F.col("_new") == ~want(2))).alias("realised"), F.lit(1).alias("target"),
    )


def with_anomalies(df: DataFrame, seed: int = 1) -> DataFrame:
    """The rows (target 0) and as many anomalous ones (target 1): event_id,
    account, host, ts, unlocks, locks, scenario (0: as it was), target. The
    profiles are those of the rows themselves."""
    own = df.where("account is not null and ts is not null")
    new = synthesize_anomalies(own, hour_profile(own), weekday_class(day_profile(own)), seed)
    flag = lambda some: F.coalesce(F.col("activity").isin(*some), F.lit(False)).cast("int")
    old = own.select("event_id", "account", "host", "ts", flag(UNLOCKS).alias("unlocks"), flag(LOCKS).alias("locks"), F.lit(0).alias("scenario"), F.lit(0).alias("target"))
    return old.unionByName(new.drop("realised"))


def augment(df: DataFrame, key: str, columns: Sequence[str], y: str, strategy: str = "noise", n: int = 1, seed: int = 1, scale: float = 0.05, nearest: int = 4, shape: float | None = None, jitter: float = 0.0005, tails: tuple[float, float] = (0.1, 0.9)) -> DataFrame:
    """``n`` new rows for each row, numbered in ``copy``.

    ``noise``: gaussian noise of ``scale`` standard deviations. ``mixup``: a
    point between the row and one of its ``nearest`` neighbours in feature
    space, at a beta(0.5, 0.5) share of the row; features and y alike.
    ``extremes``: the same among the rows whose y lies at or beyond the
    quantiles ``tails``, with neighbours among these, beta(0.4, 0.4) shares and
    gaussian noise of ``jitter`` on the features. Rows with a null feature have
    no neighbours and give no new row; draws depend on key, copy and seed.
    """
    if strategy not in ("noise", "mixup", "extremes"):
        raise ValueError(f"no strategy {strategy}")
    if strategy == "extremes":
        low, high = (F.lit(x).cast("double") for x in quantiles(df, [(y, tails[0]), (y, tails[1])]))
        df = df.where((F.col(y) <= low) | (F.col(y) >= high))
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    gauss = lambda c: normal_variate(seed, key, "copy", F.lit(c))
    if strategy == "noise":
        spread = df.agg(*(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
        out = copies.crossJoin(F.broadcast(spread))  # one row
        return out.withColumns({c: F.col(c) + gauss(c) * F.col(f"_s_{c}") * scale for c in columns}).drop(*(f"_s_{c}" for c in columns))
    shape = shape or (0.5 if strategy == "mixup" else 0.4)
    near = knn_features(df, key, columns, nearest + 1).where("id <> neighbour")
    place = F.row_number().over(Window.partitionBy("id").orderBy("rank"))
    near = near.withColumn("_p", place).where(F.col("_p") <= nearest).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_p", "neighbour"))).alias("_near"))
    every = [*columns, y]
    other = df.select(F.col(key).alias("_o"), *(F.col(c).alias(f"_n_{c}") for c in every))
    out = copies.join(near.withColumnRenamed("id", key), key)
    pick = F.least(F.floor(uniform(seed, key, "copy", F.lit("near")) * F.size("_near")).cast("int"), F.size("_near") - 1) + 1
    out = out.withColumn("_o", F.element_at("_near", pick)["neighbour"]).join(other, "_o").withColumn("_w", beta_variate(shape, shape, seed, key, "copy"))
    mixed = {c: F.col("_w") * F.col(c) + (1 - F.col("_w")) * F.col(f"_n_{c}") for c in every}
    if strategy == "extremes":
        mixed |= {c: mixed[c] + gauss(c) * jitter for c in columns}
    return out.withColumns(mixed).withColumnsRenamed({"_o": "neighbour", "_w": "share"}).drop("_near", *(f"_n_{c}" for c in every))


__all__ = ["assembled", "augment", "choose_per_user", "cluster_points", "fit_churn", "fit_per_user", "fit_regressor", "moments", "pca_reduce", "regional_predict", "ridge", "score_chosen", "stack_predict", "synthesize_anomalies", "weighted_sample", "with_anomalies"]
