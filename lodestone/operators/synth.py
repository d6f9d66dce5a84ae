"""Synthetic clustered queries on the unit sphere.

Parameters of each cluster are a small table; every cluster is drawn in a task of its own,
from a generator seeded by the run's seed and the cluster's number, so that results don't
depend on how clusters are dealt out.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering

MODELS = ("halfnormal", "tangent_gauss", "tangent_t", "tangent_laplace", "tangent_mix", "tangent_subspace", "ring", "tangent_corr")


@dataclass(frozen=True)
class Settings:
    clusters: int = 10
    per_cluster: int = 100
    sigma_deg: float = 2.0
    theta_min_deg: float = 0.0
    min_sep_deg: float = 15.0
    outlier_share: float = 0.0
    outlier_deg: tuple[float, float] = (25.0, 60.0)
    shuffle: bool = False
    seed: int = 42
    per_cluster_range: tuple[int, int] = (0, 0)  # in force when both are above 0 and in order, like the next two
    per_cluster_lognormal: tuple[float, float] | None = None  # mean and deviation of the logarithm, instead of uniform
    sigma_range: tuple[float, float] = (0.0, 0.0)
    theta_min_range: tuple[float, float] = (0.0, 0.0)
    model: str = "halfnormal"
    jitter: float = 0.0  # deviation of the logarithm of each query's sigma
    heavy_share: float = 0.0
    heavy_times: float = 3.0
    anisotropy: float = 1.0
    center_jitter_deg: float = 0.0
    t_df: float = 5.0
    mix_weights: tuple[float, ...] = ()
    mix_sigma: tuple[float, ...] = ()
    mix_anisotropy: tuple[float, ...] = ()
    rank: int = 0
    same_subspace: bool = True
    ring_deg: float = 0.0
    ring_width_deg: float = 0.0
    shared_share: float = 0.0

    def __post_init__(self) -> None:
        if self.model not in MODELS:
            raise ValueError(f"unknown noise model {self.model}")


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-15, np.linalg.norm(x, axis=-1, keepdims=True))


def tangents(rng: np.random.Generator, center: np.ndarray, n: int) -> np.ndarray:
    """n random unit vectors orthogonal to the center; along its smallest axis where a draw has no such part."""
    z = rng.standard_normal((n, len(center)))
    z -= np.outer(z @ center, center)
    flat = np.linalg.norm(z, axis=1) < 1e-12
    if flat.any():
        axis = np.eye(len(center))[np.abs(center).argmin()]
        z[flat] = axis - (axis @ center) * center
    return unit(z)


def at_angle(center: np.ndarray, direction: np.ndarray, theta: np.ndarray) -> np.ndarray:
    return unit(np.cos(theta)[:, None] * center + np.sin(theta)[:, None] * direction)


def push_out(rng: np.random.Generator, center: np.ndarray, q: np.ndarray, theta: float) -> np.ndarray:
    """Queries nearer to the center than theta are moved out along their own direction."""
    near = np.arccos(np.clip(q @ center, -1, 1)) < theta
    if near.any():
        side = q[near] - np.outer(q[near] @ center, center)
        lost = np.linalg.norm(side, axis=1) < 1e-12
        side[lost] = tangents(rng, center, int(lost.sum()))
        q = q.copy()
        q[near] = at_angle(center, unit(side), np.full(int(near.sum()), theta))
    return q


def _stretch(rng: np.random.Generator, z: np.ndarray, center: np.ndarray, by: float | np.ndarray) -> np.ndarray:
    """More spread along one random tangent, by the root of `by`."""
    if np.all(np.asarray(by) == 1.0):
        return z
    w = tangents(rng, center, 1)[0]
    return z + ((np.sqrt(np.maximum(by, 0.0)) - 1) * (z @ w))[:, None] * w


def draw(center: np.ndarray, n: int, sigma_deg: float, theta_min_deg: float, s: Settings, rng: np.random.Generator) -> np.ndarray:
    """n unit vectors around a unit center by the settings' noise model."""
    d = len(center)
    sigma, least = np.radians(sigma_deg), np.radians(theta_min_deg)
    if s.center_jitter_deg > 0:
        z = rng.standard_normal(d) * np.radians(s.center_jitter_deg) / np.sqrt(max(1, d - 1))
        center = unit(center + z - (z @ center) * center)
    if s.model == "halfnormal":
        theta = np.abs(rng.normal(0, sigma, n))
        while (far := theta > 3 * sigma).any():
            theta[far] = np.abs(rng.normal(0, sigma, int(far.sum())))
        return at_angle(center, tangents(rng, center, n), np.clip(theta, least, np.pi))
    if s.model == "ring":
        middle, width = np.radians(s.ring_deg), np.radians(s.ring_width_deg)
        if least > np.pi or (width <= 0 and np.clip(middle, 0, np.pi) < least) or (width > 0 and least > middle + 8 * width):
            raise ValueError("theta_min is out of the ring's reach")
        theta = np.clip(rng.normal(middle, width, n), 0, np.pi)
        while (near := theta < least).any():
            theta[near] = np.clip(rng.normal(middle, width, int(near.sum())), 0, np.pi)
        return at_angle(center, tangents(rng, center, n), theta)
    spread = np.full(n, sigma)
    if s.model == "tangent_gauss":
        if s.jitter > 0:
            spread = spread * rng.lognormal(0, s.jitter, n)
        if s.heavy_share > 0:
            spread = np.where(rng.random(n) < s.heavy_share, spread * max(1.0, s.heavy_times), spread)
    p = max(1, d - 1)
    flat = lambda z: z - np.outer(z @ center, center)
    if s.model == "tangent_t":
        df = max(2.1, s.t_df)
        z = rng.standard_normal((n, d)) / np.sqrt(rng.chisquare(df, n) / df)[:, None]
        z = flat(z) * (sigma / np.sqrt(p * df / (df - 2)))
    elif s.model == "tangent_laplace":
        z = flat(rng.laplace(0, 1, (n, d))) * (sigma / np.sqrt(2 * p))
    elif s.model == "tangent_subspace":
        k = int(np.clip(s.rank or 1, 1, p))

        def basis() -> np.ndarray:
            return np.linalg.qr(np.column_stack([center, rng.standard_normal((d, k))]))[0][:, 1:].T

        scale = np.ones(k)
        scale[0] = np.sqrt(max(0.0, s.anisotropy))
        if s.same_subspace:
            z = (rng.standard_normal((n, k)) * scale) @ basis() * (sigma / np.sqrt(k))
        else:
            z = np.stack([(rng.standard_normal(k) * scale) @ basis() * (sigma / np.sqrt(k)) for _ in range(n)])
    elif s.model == "tangent_corr":
        share = float(np.clip(s.shared_share, 0, 1))
        shared = flat(rng.standard_normal((1, d))) * np.sqrt(share) * sigma / np.sqrt(p)
        own = _stretch(rng, flat(rng.standard_normal((n, d))), center, s.anisotropy)
        z = shared + own * (np.sqrt(1 - share) * sigma / np.sqrt(p))
    else:
        by: float | np.ndarray = s.anisotropy
        if s.model == "tangent_mix" and (m := len(s.mix_weights)) > 1 and len(s.mix_sigma) == m and len(s.mix_anisotropy) == m:
            weights = np.maximum(0, s.mix_weights)
            part = rng.choice(m, n, p=weights / weights.sum())
            spread, by = spread * np.array(s.mix_sigma)[part], np.array(s.mix_anisotropy)[part]
        z = _stretch(rng, flat(rng.standard_normal((n, d))), center, by) * (spread / np.sqrt(p))[:, None]
    return push_out(rng, center, unit(center + z), least)


def parameters(s: Settings, given: list[tuple[int, float, float]] | None = None) -> list[tuple[int, int, float, float]]:
    """(cluster_id, per_cluster, sigma_deg, theta_min_deg): defaults, then the given lines, then the ranges, which bind all."""
    rng = np.random.default_rng([s.seed, 1])
    out = []
    for c in range(s.clusters):
        n, sigma, least = (given or [])[c] if given and c < len(given) else (s.per_cluster, s.sigma_deg, s.theta_min_deg)
        low, high = s.per_cluster_range
        if 0 < low <= high:
            n = int(np.clip(round(rng.lognormal(*s.per_cluster_lognormal)), low, high)) if s.per_cluster_lognormal else int(rng.integers(low, high + 1))
        if 0 < s.sigma_range[0] <= s.sigma_range[1]:
            sigma = float(rng.uniform(*s.sigma_range))
        if 0 < s.theta_min_range[0] <= s.theta_min_range[1]:
            least = float(rng.uniform(*s.theta_min_range))
        out.append((c, max(1, int(n)), max(1e-6, float(sigma)), max(0.0, float(least))))
    return out


def generate(spark: SparkSession, seeds: DataFrame, s: Settings, given: list[tuple[int, float, float]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries (qid, cluster_id, vec), outliers with cluster -1, and clusters (cluster_id, center_id, per_cluster, sigma_deg, theta_min_deg).

    seeds: (qid, vec), of which the centers are picked, farthest first.
    """
    order = clustering.farthest_first(seeds, s.clusters, float(np.radians(s.min_sep_deg)))
    centers = order.join(seeds.select("qid", F.col("vec").cast("array<double>").alias("vec")), "qid")
    table = spark.createDataFrame(parameters(s, given), "cluster_id int, per_cluster int, sigma_deg double, theta_min_deg double")
    clusters = centers.withColumnsRenamed({"place": "cluster_id", "qid": "center_id", "vec": "center"}).join(table, "cluster_id")
    settings = asdict(s)

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        row, how = pdf.iloc[0], Settings(**settings)
        rng = np.random.default_rng([how.seed, 2, int(row.cluster_id)])
        x = draw(unit(np.array(row.center, float)), int(row.per_cluster), float(row.sigma_deg), float(row.theta_min_deg), how, rng)
        return pd.DataFrame({"cluster_id": np.int32(row.cluster_id), "number": np.arange(len(x)), "vec": list(x)})

    schema = "cluster_id int, number long, vec array<double>"
    rows = clusters.groupBy("cluster_id").applyInPandas(make, schema)
    outliers = round(s.outlier_share * sum(p[1] for p in parameters(s, given)))
    if outliers:
        held = [np.array(r.center, float) for r in clusters.orderBy("cluster_id").collect()]  # one row a cluster
        low, high = np.radians(s.outlier_deg)
        seed = s.seed

        def stray(frames):  # noqa: ANN001, ANN202
            for frame in frames:
                out = []
                for i in frame["id"]:
                    rng = np.random.default_rng([seed, 3, int(i)])
                    center = unit(held[rng.integers(len(held))])
                    out.append(at_angle(center, tangents(rng, center, 1), np.array([rng.uniform(low, high)]))[0])
                yield pd.DataFrame({"cluster_id": np.int32(-1), "number": frame["id"], "vec": out})

        rows = rows.unionByName(spark.range(outliers).mapInPandas(stray, schema))
    placed = clustering.place_in_order(rows, s.seed if s.shuffle else None)
    return placed.select("qid", "cluster_id", "vec"), clusters.select("cluster_id", "center_id", "per_cluster", "sigma_deg", "theta_min_deg")
