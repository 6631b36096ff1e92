"""Models of users with more rows than one task should hold, from all their rows.

A user's rows lie in blocks over many tasks. What the fits of
:mod:`.models` need of them are sums (counts, moments, gradients, weights above
an edge) and exact quantiles, so each step is one pass over the blocks; the
driver holds the numbers of some users' models, never their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

#: Boosted steps, and edges of a feature that they choose from.
ROUNDS, EDGES = 20, 16


def runs(frames: Iterator[pd.DataFrame], by: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Sorted rows again, in frames that hold all rows of each of their keys."""
    rest: list[pd.DataFrame] = []
    for f in frames:
        if not len(f):
            continue
        last = [f[c].iloc[-1] for c in by]
        own = np.logical_and.reduce([(f[c] == x).to_numpy() for c, x in zip(by, last)])
        if own.all() and (not rest or [rest[0][c].iloc[0] for c in by] == last):
            rest.append(f)
            continue
        yield pd.concat([*rest, f[~own]])
        rest = [f[own]]
    if rest:
        yield pd.concat(rest)


class Blocks:
    """Rows (_i, _block, _held, _fold, x0, x1, ..., _y) of users numbered by _i."""

    def __init__(self, rows: DataFrame, users: int, features: int, k: int):
        self.users, self.features, self.k = users, features, k
        self.rows = settle(rows.repartitionByRange("_i", "_block").sortWithinPartitions("_i", "_block", "_key"))

    def added(self, part: Callable[[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """A row a user: the sum over its blocks of ``part(user, x, y, held, fold)``. A task adds up its own."""
        names = [f"x{j}" for j in range(self.features)]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, total = -1, None
            for f in runs(frames, ["_i", "_block"]):
                for (i, _), g in f.groupby(["_i", "_block"], sort=True):
                    own = part(int(i), g[names].to_numpy(float), g["_y"].to_numpy(float), g["_held"].to_numpy(bool), g["_fold"].to_numpy())
                    if i != at and total is not None:
                        yield pd.DataFrame({"i": [at], "v": [total.tolist()]})
                    at, total = i, own if i != at else total + own
            if total is not None:
                yield pd.DataFrame({"i": [at], "v": [total.tolist()]})

        out: list[np.ndarray | None] = [None] * self.users
        for r in self.rows.mapInPandas(run, "i int, v array<double>").collect():  # a row a task, and a row a user
            out[r.i] = np.array(r.v) if out[r.i] is None else out[r.i] + np.array(r.v)
        return np.stack(out)

    def ordered(self, ranks: np.ndarray) -> np.ndarray:
        """(users, models, features, ranks): for ``ranks`` (users, models, ranks)
        the values at these places among the training rows of each model, in
        order. Values are counted, then dealt by range, so no task sorts a user."""
        k, names = self.k, [f"x{j}" for j in range(self.features)]
        pairs = F.explode(F.array(*(F.struct(F.lit(j).alias("f"), F.col(c).alias("x")) for j, c in enumerate(names))))
        long = self.rows.where("not _held").select("_i", "_fold", pairs.alias("p")).select("_i", "_fold", "p.f", "p.x")
        counts = long.groupBy("_i", "f", "x").agg(*(F.count_if(F.col("_fold") == c).alias(f"n{c}") for c in range(k)))
        values = settle(counts.repartitionByRange("_i", "f", "x").sortWithinPartitions("_i", "f", "x").withColumn("_r", F.spark_partition_id()))
        ahead, before = {}, {}  # of a range: the counts of the ranges before it
        for r in values.groupBy("_i", "f", "_r").agg(*(F.sum(f"n{c}").alias(f"n{c}") for c in range(k))).orderBy("_i", "f", "_r").collect():
            ahead[r._i, r.f, r._r] = before.get((r._i, r.f), np.zeros(k, int))
            before[r._i, r.f] = ahead[r._i, r.f, r._r] + np.array([r[f"n{c}"] for c in range(k)])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            so_far: dict = {}
            for f in frames:
                for at, g in f.groupby(["_i", "f", "_r"], sort=True):
                    n = g[[f"n{c}" for c in range(k)]].to_numpy()
                    upto = so_far.get(at, ahead[at]) + n.cumsum(axis=0)
                    so_far = {at: upto[-1]}
                    x = g["x"].to_numpy(float)
                    for j in range(k + 1):
                        without = upto.sum(axis=1) - (upto[:, j] if j < k else 0)
                        own = np.searchsorted(without, ranks[at[0], j], side="right")
                        first = without[0] - n[0].sum() + (n[0, j] if j < k else 0)
                        here = np.flatnonzero((own < len(x)) & (ranks[at[0], j] >= first))
                        if len(here):
                            yield pd.DataFrame({"i": at[0], "j": j, "f": at[1], "rank": here, "x": x[own[here]]})

        out = np.zeros((*ranks.shape[:2], self.features, ranks.shape[2]))
        found = values.mapInPandas(run, "i int, j int, f int, rank int, x double").toPandas()
        out[found["i"], found["j"], found["f"], found["rank"]] = found["x"]
        return out


def fit(blocks: Blocks, names: Sequence[str]) -> dict[str, np.ndarray]:
    """What :func:`.models._choose` fits and counts, of users in blocks. Models 0
    to k - 1 leave a fold out, model k takes all training rows."""
    users, d, k = blocks.users, blocks.features, blocks.k
    models = k + 1

    def trained(held: np.ndarray, fold: np.ndarray) -> np.ndarray:  # (models, rows)
        return ~held & np.concatenate([fold != np.arange(k)[:, None], np.ones((1, len(fold)), bool)])

    first = blocks.added(lambda i, x, y, held, fold: np.r_[held.sum(), trained(held, fold).sum(axis=1), x[~held].sum(axis=0)])
    unseen, n, m = first[:, 0], first[:, 1 : models + 1], first[:, models + 1 :] / first[:, [models]]
    s = np.sqrt(blocks.added(lambda i, x, y, held, fold: ((x[~held] - m[i]) ** 2).sum(axis=0)) / n[:, [k]])
    s[s <= 1e-12 * np.abs(m)] = 1
    scaled = lambda i, x: (x - m[i]) / s[i]

    at = np.linspace(0.02, 0.98, EDGES) * np.maximum(n - 1, 0)[..., None]
    low = at.astype(int)
    top = np.maximum(n - 1, 0)[..., None].astype(int)
    # places in order; a model without rows has none
    v = blocks.ordered(np.concatenate([low, np.minimum(low + 1, top)], axis=2))
    v = (v - m[:, None, :, None]) / s[:, None, :, None]
    a, b = v[..., :EDGES], v[..., EDGES:]
    cuts = a + (b - a) * (at - low)[:, :, None]  # (users, models, features, edges)

    def classes(i, x, y, held, fold):
        z, t = scaled(i, x), trained(held, fold)
        return np.concatenate([np.c_[(t & (y == c)).sum(axis=1), (t & (y == c)) @ z] for c in (1, 0)]).ravel()

    by_class = blocks.added(classes).reshape(users, 2, models, 1 + d)
    many, mean = by_class[..., :1], by_class[..., 1:] / np.maximum(by_class[..., :1], 1)

    def spread(i, x, y, held, fold):
        z, t = scaled(i, x), trained(held, fold)
        return np.array([((z - mean[i, c, j]) ** 2)[t[j] & (y == 1 - c)].sum(axis=0) for c in range(2) for j in range(models)]).ravel()

    v = np.where(many > 0, blocks.added(spread).reshape(users, 2, models, d) / np.maximum(many, 1) + 1e-2, 1.0)
    squares, linear = (-0.5 / v[:, 0] + 0.5 / v[:, 1]), mean[:, 0] / v[:, 0] - mean[:, 1] / v[:, 1]
    constant = (-0.5 * mean**2 / v - 0.5 * np.log(v)).sum(axis=3)
    base = np.log((many[:, 0, :, 0] + 1) / (many[:, 1, :, 0] + 1)) + constant[:, 0] - constant[:, 1]

    w = np.zeros((users, models, d + 1))
    settled = np.zeros((users, models), bool)
    feature, edge, amount, level = np.zeros((users, models, 0), int), np.zeros((users, models, 0)), np.zeros((users, models, 0)), np.zeros((users, models))

    def said(i, j, z):  # of the steps so far
        out = np.zeros(len(z))
        for f, e, c in zip(feature[i, j], edge[i, j], amount[i, j]):
            out += c * (z[:, f] > e)
        return out + level[i, j]

    def step(i, x, y, held, fold):
        """Of each model: weights, signed weights, those above each edge; gradient and curvature."""
        z, t, sign = scaled(i, x), trained(held, fold), 2 * y - 1
        one, out = np.c_[z, np.ones(len(z))], []
        for j in range(models):
            u = np.exp(-sign * said(i, j, z)) * t[j]
            above = [np.bincount(np.searchsorted(cuts[i, j, f], z[:, f]), u * sign, EDGES + 1)[:0:-1].cumsum()[::-1] for f in range(d)]
            out += [[u.sum(), (u * sign).sum()], *above]
            if not settled[i, j]:
                p = 1 / (1 + np.exp(-np.clip(one @ w[i, j], -30, 30)))
                out += [one.T @ ((y - p) * t[j]), (one.T @ (one * ((p * (1 - p) + 1e-6) * t[j])[:, None])).ravel()]
            else:
                out.append(np.zeros((d + 1) * (d + 2)))
        return np.concatenate(out)

    who, which = np.arange(users)[:, None], np.arange(models)
    for r in range(ROUNDS):
        got = blocks.added(step).reshape(users, models, -1)
        total, signed, above = got[..., 0], got[..., 1], got[..., 2 : 2 + d * EDGES]
        total = np.maximum(total, 1e-300)
        right = (2 * above - signed[..., None]) / total[..., None]
        i = np.argmax(np.abs(right), axis=2)
        x = right[who, which, i]
        error = np.clip((1 - np.abs(x)) / 2, 1e-6, 0.5)
        c = 0.5 * np.log((1 - error) / error) * np.where(x < 0, -1.0, 1.0)
        feature = np.concatenate([feature, (i // EDGES)[..., None]], axis=2)
        edge = np.concatenate([edge, cuts.reshape(users, models, -1)[who, which, i][..., None]], axis=2)
        amount = np.concatenate([amount, 2 * c[..., None]], axis=2)
        level = level - c
        if r < 15:
            gradient, curved = got[..., 2 + d * EDGES : 3 + d * EDGES + d], got[..., 3 + d * EDGES + d :].reshape(users, models, d + 1, d + 1)
            move = np.linalg.solve(curved + 0.1 * np.eye(d + 1), (gradient - 0.1 * w)[..., None])[..., 0] * ~settled[..., None]
            w = w + move
            settled = settled | (np.abs(move).max(axis=2) <= 1e-12)
        if r == 14:
            settled[:] = True

    def tested(i, x, y, held, fold):
        """Of each model, on the rows that it has not seen: ones, and of each candidate and their vote what it says and what of it is right."""
        z, out = scaled(i, x), []
        for j in range(models):
            t = (~held & (fold == j)) if j < k else held
            says = [z @ w[i, j, :-1] + w[i, j, -1] > 0, z**2 @ squares[i, j] + z @ linear[i, j] + base[i, j] > 0, said(i, j, z) > 0]
            says.append(sum(a.astype(int) for a in says) >= 2)
            out += [t.sum(), (y * t).sum(), *(x for a in says for x in ((a & t).sum(), (a & t & (y == 1)).sum()))]
        return np.array(out, float)

    got = blocks.added(tested).reshape(users, models, 2 + 2 * len(names))
    rows, ones, yes, hit = got[..., 0], got[..., 1, None], got[..., 2::2], got[..., 3::2]
    precision, recall = hit / np.maximum(1, yes), hit / np.maximum(1, ones)
    f1 = np.where(hit > 0, 2 * precision * recall / np.where(hit > 0, precision + recall, 1), 0.0)
    ok = (n[:, :k] > 0) & (rows[:, :k] > 0)
    mean_f1 = (f1[:, :k] * ok[..., None]).sum(axis=1) / np.maximum(ok.sum(axis=1), 1)[:, None]
    return {
        "mean": mean_f1, "precision": precision[:, k], "recall": recall[:, k], "f1": f1[:, k], "n": n[:, k].astype(int), "n_unseen": unseen.astype(int), "m": m, "s": s,
        "logistic": (w[:, k, :-1], w[:, k, -1]), "bayes": (squares[:, k], linear[:, k], base[:, k]), "stumps": (feature[:, k], edge[:, k], amount[:, k], level[:, k]),
    }
