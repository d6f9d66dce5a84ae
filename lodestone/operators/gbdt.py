"""Gradient-boosted trees on histograms: quantile, Huber and squared loss, with monotone constraints.

Trees grow leaf by leaf. A node sends a value to the left when it is at most the threshold;
a missing value fails that test and goes right. A tree of one leaf is its value.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    loss: str = "squared"  # quantile, huber, squared
    alpha: float = 0.85
    trees: int = 100
    rate: float = 0.1
    leaves: int = 15
    min_rows: int = 8
    min_gain: float = 1e-3
    l2: float = 2.5
    bins: int = 255
    rows_share: float = 0.9
    feature_share: float = 0.9
    seed: int = 42
    log_target: bool = True


@dataclass
class Tree:
    """Inner nodes by number; a child below 0 is leaf -1 - child."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.feature:
            return np.full(len(x), self.value[0] if self.value else 0.0)
        feature, threshold, left, right = map(np.array, (self.feature, self.threshold, self.left, self.right))
        node = np.zeros(len(x), np.int64)
        while (inner := node >= 0).any():
            at, rows = node[inner], np.flatnonzero(inner)
            column = feature[at]
            values = np.where(column < x.shape[1], x[rows, np.minimum(column, x.shape[1] - 1)], 0.0)
            node[rows] = np.where(values <= threshold[at], left[at], right[at])
        return np.array(self.value)[-1 - node]

    def expression(self, features: list[Column]) -> Column:
        """The tree as nested conditions, for models small enough to be compiled."""

        def build(node: int) -> Column:
            if node < 0:
                return F.lit(float(self.value[-1 - node]))
            x = features[self.feature[node]] if self.feature[node] < len(features) else F.lit(0.0)
            # a missing value isn't at most the threshold (Spark would count NaN as largest, and null as unknown)
            return F.when(x <= F.lit(float(self.threshold[node])), build(self.left[node])).otherwise(build(self.right[node]))

        return build(0) if self.feature else F.lit(float(self.value[0] if self.value else 0.0))


@dataclass
class Ensemble:
    features: list[str]
    trees: list[Tree]
    log_target: bool = False

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(np.asarray(x, float))
        return np.expm1(z) if self.log_target else z

    def importance(self) -> list[tuple[str, float]]:
        """Gain by feature, highest first."""
        gain = dict.fromkeys(self.features, 0.0)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                gain[self.features[f]] += g
        return sorted(gain.items(), key=lambda x: (-x[1], x[0]))

    def expression(self) -> Column:
        """The raw sum as one expression; a missing column counts as 0."""
        columns = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.features]
        total = F.lit(0.0)
        for t in self.trees:
            total = total + t.expression(columns)
        return total


def score(df: DataFrame, model: Ensemble, into: str) -> DataFrame:
    """df with the model's prediction; batches are scored by numpy, for models too large to compile."""

    @F.pandas_udf("double")
    def predict(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.predict(np.stack([c.fillna(0.0).to_numpy(float) for c in columns], axis=1)))

    present = [F.col(f).cast("double") if f in df.columns else F.lit(0.0) for f in model.features]
    return df.withColumn(into, predict(*present))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    out = []
    for c in x.T:
        values = np.unique(c[~np.isnan(c)])
        out.append((values[:-1] + values[1:]) / 2 if len(values) <= bins else np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])))
    return out


def _gradients(y: np.ndarray, z: np.ndarray, s: Settings, scale: float) -> np.ndarray:
    r = y - z
    if s.loss == "quantile":
        return np.where(r > 0, -s.alpha, 1 - s.alpha)
    return -np.clip(r, -scale, scale) if s.loss == "huber" else -r


def _leaf(y: np.ndarray, z: np.ndarray, s: Settings, g: np.ndarray) -> float:
    if s.loss == "quantile":
        return float(np.quantile(y - z, s.alpha)) * len(y) / (len(y) + s.l2)
    return float(-g.sum() / (len(g) + s.l2))


def _grow(binned: np.ndarray, edges: list[np.ndarray], y: np.ndarray, z: np.ndarray, s: Settings, signs: np.ndarray, rng: np.random.Generator, scale: float) -> Tree:
    n, width = binned.shape
    rows = np.flatnonzero(rng.random(n) < s.rows_share) if s.rows_share < 1 else np.arange(n)
    rows = rows if len(rows) >= 2 * s.min_rows else np.arange(n)
    columns = np.flatnonzero(rng.random(width) < s.feature_share)
    columns = columns if len(columns) else np.arange(width)
    g = _gradients(y, z, s, scale)
    total = lambda a, m: a * a / (m + s.l2)

    def split(idx: np.ndarray, low: float, high: float) -> tuple | None:
        best = None
        whole, m = g[idx].sum(), len(idx)
        for c in columns:
            if not len(edges[c]):
                continue
            width_ = len(edges[c]) + 2  # the last bin holds missing values, which go right
            sums = np.bincount(binned[idx, c], g[idx], width_).cumsum()[:-2]
            counts = np.bincount(binned[idx, c], minlength=width_).cumsum()[:-2]
            fine = (counts >= s.min_rows) & (m - counts >= s.min_rows)
            if signs[c]:
                left, right = np.clip(-sums / (counts + s.l2), low, high), np.clip(-(whole - sums) / (m - counts + s.l2), low, high)
                fine &= (right - left) * signs[c] >= 0
            if fine.any():
                gain = np.where(fine, total(sums, counts) + total(whole - sums, m - counts) - total(whole, m), -np.inf)
                i = int(gain.argmax())
                if gain[i] > s.min_gain and (best is None or gain[i] > best[0]):
                    best = (float(gain[i]), int(c), i)
        return best

    tree = Tree()
    leaves = [(rows, -np.inf, np.inf, None)]  # rows, bounds, and the child to be set
    found = [split(rows, -np.inf, np.inf)]
    while len(leaves) < s.leaves and any(found):
        at = max((i for i, f in enumerate(found) if f), key=lambda i: (found[i][0], -i))
        gain, c, cut = found[at]
        idx, low, high, parent = leaves[at]
        goes = binned[idx, c] <= cut
        node = len(tree.feature)
        tree.feature.append(c)
        tree.threshold.append(float(edges[c][cut]))
        tree.left.append(0)
        tree.right.append(0)
        tree.gain.append(gain)
        if parent:
            getattr(tree, parent[1])[parent[0]] = node
        a, b = idx[goes], idx[~goes]
        bounds = [(low, high), (low, high)]
        if signs[c]:
            mid = np.clip((_leaf(y[a], z[a], s, g[a]) + _leaf(y[b], z[b], s, g[b])) / 2, low, high)
            bounds = [(low, mid), (mid, high)] if signs[c] > 0 else [(mid, high), (low, mid)]
        leaves[at : at + 1] = [(a, *bounds[0], (node, "left")), (b, *bounds[1], (node, "right"))]
        found[at : at + 1] = [split(a, *bounds[0]), split(b, *bounds[1])]
    for i, (idx, low, high, parent) in enumerate(leaves):
        tree.value.append(s.rate * float(np.clip(_leaf(y[idx], z[idx], s, g[idx]), low, high)))
        if parent:
            getattr(tree, parent[1])[parent[0]] = -1 - i
    return tree


def fit(x: np.ndarray, y: np.ndarray, features: list[str], s: Settings = Settings(), signs: list[int] | None = None) -> Ensemble:
    """Boosting; signs: 1 where predictions may only rise with a feature, -1 where they may only fall."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    y = np.log1p(y) if s.log_target else y
    rng = np.random.default_rng(s.seed)
    edges = _edges(x, s.bins)
    binned = np.stack([np.where(np.isnan(c), len(e) + 1, np.searchsorted(e, c, side="left")) for c, e in zip(x.T, edges)], axis=1)
    # from the quantile itself all residuals may have one sign, and no split would gain anything
    start = float(np.median(y)) if s.loss == "quantile" else float(y.mean())
    trees, z = [Tree(value=[start])], np.full(len(y), start)
    for _ in range(s.trees):
        scale = float(np.quantile(np.abs(y - z), 0.9)) or 1e-9
        tree = _grow(binned, edges, y, z, s, np.array(signs or [0] * x.shape[1]), rng, scale)
        if not tree.feature:
            break
        trees.append(tree)
        z = z + tree.predict(x)
    return Ensemble(list(features), trees, s.log_target)


def fit_heads(table: DataFrame, heads: dict[str, tuple[list[str], str, Settings, list[int] | None]]) -> dict[str, Ensemble]:
    """Several models on one prepared table, each fitted in a task of its own.

    heads: name to (features, target, settings, signs). A training table has one row for each
    cluster and grid cell, so a head's columns fit one task.
    """
    import pickle

    names = sorted(heads)
    pieces = None
    for name in names:
        features, target, _, _ = heads[name]
        # a fixed order, for a sum of floats doesn't commute
        part = table.select(F.lit(name).alias("head"), F.array(*(F.col(f).cast("double") for f in features)).alias("x"), F.col(target).cast("double").alias("y")).where("y is not null")
        pieces = part if pieces is None else pieces.unionByName(part)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["head"].iloc[0]
        features, _, settings, signs = heads[name]
        x = np.array([[np.nan if v is None else v for v in r] for r in pdf["x"]], float)
        order = np.lexsort([*x.T[::-1], pdf["y"].to_numpy()])
        model = fit(x[order], pdf["y"].to_numpy()[order], features, settings, signs)
        return pd.DataFrame({"head": [name], "model": [pickle.dumps(model)]})

    rows = pieces.groupBy("head").applyInPandas(train, "head string, model binary").collect()
    return {r["head"]: pickle.loads(r["model"]) for r in rows}
