"""Descriptors of query clusters. Where training and serving compute a feature differently, both are here.

members: (qid, cluster_id, vec); probes: (cluster_id, rank, base_id, d2), the neighbours of a
cluster's centroid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector
from . import knn, quantiles


def sizes(members: DataFrame) -> DataFrame:
    """cluster_id, n, log1p_n (training) and ln_n (serving)."""
    n = F.count("*")
    return members.where("cluster_id >= 0").groupBy("cluster_id").agg(n.alias("n"), F.log1p(n.cast("double")).alias("log1p_n"), F.when(n > 0, F.ln(n.cast("double"))).otherwise(0.0).alias("ln_n"))


def centroids(members: DataFrame) -> DataFrame:
    """(cluster_id, center): mean vectors, not normalised. One hash aggregation with a sum for each component."""
    rows = members.where("cluster_id >= 0").select("cluster_id", F.col("vec").cast("array<double>").alias("vec"))
    first = rows.select(F.size("vec").alias("d")).first()
    dim = first.d if first else 0
    return rows.groupBy("cluster_id").agg(F.array(*(F.avg(F.col("vec")[i]) for i in range(dim))).alias("center"))


def radii(members: DataFrame, centers: DataFrame) -> DataFrame:
    """(cluster_id, qid, radius)."""
    return members.where("cluster_id >= 0").join(centers, "cluster_id").select("cluster_id", "qid", F.sqrt(vector.l2sq(F.col("vec"), F.col("center"))).alias("radius"))


def shape(radius: DataFrame) -> DataFrame:
    """Per cluster the radius percentiles of training (interpolated) and of serving (by place), skews and mean density."""
    rows = radius.select(F.col("cluster_id").alias("g"), F.col("radius").alias("x"))
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    half, high = F.lit(0.5) * (F.col("n") - 1), F.lit(0.9) * (F.col("n") - 1)
    # the ranks of both kinds of percentiles, from 0
    ranks = {"a": F.floor(half), "b": F.ceil(half), "c": F.floor(high), "d": F.ceil(high), "upper": F.floor(F.col("n") / 2)}
    wanted = sizes.select("g", F.explode(F.array_distinct(F.array(*(r.cast("long") for r in ranks.values())))).alias("rank"))
    found = quantiles.values_at(rows, wanted).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))  # five a cluster
    out = sizes.join(found, "g").select("g", "n", "mean", *(F.element_at("at", r.cast("long")).alias(name) for name, r in ranks.items()), (half - F.floor(half)).alias("s"), (high - F.floor(high)).alias("t"))
    between = lambda x, y, part: F.col(x) + (F.col(y) - F.col(x)) * F.col(part)
    out = out.select(F.col("g").alias("cluster_id"), "n", between("a", "b", "s").alias("p50"), between("c", "d", "t").alias("p90"), F.col("upper").alias("p50_upper"), F.col("c").alias("p90_floor"), (F.lit(1.0) / (F.col("mean") + 1e-6)).alias("density_mean"))
    skew = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumns({"skew": skew("p90", "p50"), "skew_serve": skew("p90_floor", "p50_upper")})


def tenth_distances(members: DataFrame, place: int = 10) -> DataFrame:
    """(g, x): the distance of each member to its `place`-th nearest fellow.

    Fellows are compared inside their cluster only, block by block.
    """
    rows = members.where("cluster_id >= 0").select(F.col("cluster_id").alias("group"), "qid", "vec")
    found = knn.grouped_knn(rows, rows.select("group", F.col("qid").alias("base_id"), "vec"), place + 1).where("qid <> base_id")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    far = found.withColumn("place", rank).where(F.col("place") == place)
    return far.join(rows.select("qid", "group"), "qid").select(F.col("group").alias("g"), F.sqrt("d2").alias("x"))


def density(members: DataFrame, place: int = 10, values: DataFrame | None = None) -> DataFrame:
    """(cluster_id, density): 1 / median distance of a member to its 10th nearest fellow; 0 with too few members or at distance 0.

    values: tenth_distances of the members, where they are written already.
    """
    values = tenth_distances(members, place) if values is None else values
    value = quantiles.group_percentiles(values, {"m": 0.5}).select(F.col("g").alias("cluster_id"), "m")
    out = members.where("cluster_id >= 0").select("cluster_id").distinct().join(value, "cluster_id", "left")
    return out.select("cluster_id", F.when(F.col("m") > 0, F.lit(1.0) / F.col("m")).otherwise(0.0).alias("density"))


def probe(centers: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(cluster_id, rank, base_id, d2): the k nearest of each centroid."""
    found = knn.exact_knn(centers.select(F.col("cluster_id").alias("qid"), F.col("center").alias("vec")), base, k)
    return found.select(F.col("qid").cast("int").alias("cluster_id"), "rank", "base_id", "d2")


def entry_points(centers: DataFrame, base: DataFrame, every: int = 32) -> DataFrame:
    """(cluster_id, entry_id, entry_dist): where a search starts, the nearest of a fixed sample of pivots."""
    pivots = base.where(F.col("base_id") % every == 0)
    return probe(centers, pivots, 1).select("cluster_id", F.col("base_id").alias("entry_id"), F.sqrt("d2").alias("entry_dist"))


def _at(rank: Column | int, r: Column) -> Column:
    return F.max(F.when(F.col("rank") == rank, r))


def local_shape(probes: DataFrame, k: int = 10, width: int = 256, whole: int = 100) -> DataFrame:
    """(cluster_id, lid, rc, expansion, lid_serve, rc_serve, expansion_serve) of the distances of each probe list.

    lid: -1 over the mean log of distance over k-th distance; rc: mean distance over k-th;
    expansion: 2k-th over k-th distance. Training looks at the first `whole` of the list and
    has null where it is too short; serving looks at all `width`, shortens k to the list and
    bounds each ratio.
    """
    rows = probes.where(F.col("rank") <= width).withColumn("r", F.sqrt("d2"))
    n = F.count("*").over(Window.partitionBy("cluster_id"))
    rows = rows.withColumn("n", n)
    rows = rows.withColumns({"kk": F.least(F.lit(k), F.col("n")), "k2": F.least(F.lit(2 * k), F.col("n"))})
    r, place = F.col("r"), F.col("rank")
    ends = rows.groupBy("cluster_id").agg(_at(k, r).alias("rk"), _at(2 * k, r).alias("r2k"), F.max(F.when(place == F.col("kk"), r)).alias("sk"), F.max(F.when(place == F.col("k2"), r)).alias("s2k"))
    rows = rows.join(ends, "cluster_id")
    train = F.ln(F.greatest(r, F.lit(1e-12)) / (F.col("rk") + 1e-12))
    serve = F.ln(F.when(F.col("sk") <= 1e-12, 1.0).otherwise(F.greatest(r / (F.col("sk") + 1e-12), F.lit(1e-12))))
    out = rows.groupBy("cluster_id").agg(
        F.avg(F.when(place <= k, train)).alias("t"),
        F.avg(F.when(place <= F.col("kk"), serve)).alias("s"),
        F.avg(F.when(place <= whole, r)).alias("mean"),
        F.avg(r).alias("mean_all"),
        *(F.max(c).alias(c) for c in ("rk", "r2k", "sk", "s2k")),
    )
    over = lambda a, b, other: F.when(F.col(b) > 1e-12, F.col(a) / F.col(b)).otherwise(other)
    return out.select(
        "cluster_id",
        F.when(F.col("rk").isNotNull() & (F.abs("t") > 1e-18), F.lit(-1.0) / F.col("t")).alias("lid"),
        F.when(F.col("rk").isNotNull(), F.col("mean") / (F.col("rk") + 1e-12)).alias("rc"),
        F.when(F.col("r2k").isNotNull(), F.col("r2k") / (F.col("rk") + 1e-12)).alias("expansion"),
        F.when(F.abs("s") > 1e-12, F.lit(-1.0) / F.col("s")).otherwise(0.0).alias("lid_serve"),
        over("mean_all", "sk", 1.0).alias("rc_serve"),
        over("s2k", "sk", 1.0).alias("expansion_serve"),
    )


def derived(rows: DataFrame) -> DataFrame:
    """log_efc, log_efw and efw_over_efc beside efc and ef_warm."""
    log = lambda c: F.log1p(F.greatest(F.lit(0.0), F.col(c).cast("double")))
    return rows.withColumns({"log_efc": log("efc"), "log_efw": log("ef_warm"), "efw_over_efc": F.col("ef_warm") / F.greatest(F.lit(1.0), F.col("efc").cast("double"))})
