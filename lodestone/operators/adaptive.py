"""From predictions to search parameters, and the adaptive search itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbdt

# The features of the three heads, in the order that models without names expect.
SHAPE = [
    "cluster_size", "cluster_size_log", "log1p_cluster_size",
    "cluster_density", "cluster_radius_p50", "cluster_radius_p90", "radius_skew",
    "dist_centroid_to_entryL0", "entry_dist_norm",
    "dist_centroid_top1_smallEF",
    "overlap128_vs_256", "jaccard128_vs_256",
]
PROBE = ["lid_probe256_k10", "rc_probe256_k10", "expansion2k_over_k_probe256_k10"]
ANCHOR = ["lid_k_efc", "rc_k_efc", "expand2k_over_k_efc"]
HEAD_A = [*SHAPE, *PROBE, "recall_at_k"]
HEAD_B = [*SHAPE, *ANCHOR, "efc", "log_efc", "recall_at_k"]
HEAD_M = [*SHAPE, *ANCHOR, "efc", "ef_warm", "log_efc", "log_efw", "efw_over_efc", "recall_at_k"]

# Features that predictions may only rise with, and only fall with; no rule for others.
RISING = ["cluster_radius_p50", "cluster_radius_p90", "radius_skew", "overlap128_vs_256", "jaccard128_vs_256", "recall_at_k", *PROBE, *ANCHOR]
FALLING = ["cluster_density", "efc", "log_efc"]


def decode_ef(z: Column) -> Column:
    """max(1, round(e^z - 1)), halves away from zero."""
    return F.greatest(F.lit(1), F.round(F.expm1(z)).cast("int"))


def decode_m(z: Column) -> Column:
    m = F.expm1(z)
    return F.when(F.isnan(m) | m.isNull() | (F.abs(m) == F.lit(float("inf"))), 0.0).otherwise(m)


def predicted_share(m: Column, ef_warm: Column, efc: Column, floor: float = 1.0, step: float = 0.05, safety: float = 0.0) -> Column:
    """m over ef_warm, at least floor, plus safety, at most efc over ef_warm (1 at least), then up to the next step. Only a diagnostic."""
    share = F.greatest(m / ef_warm, F.lit(floor)) + F.lit(safety)
    share = F.least(share, F.greatest(F.lit(1.0), efc / ef_warm))
    return F.ceil(share / F.lit(step) - F.lit(1e-9)).cast("double") * F.lit(step) if step > 0 else share


def choose(clusters: DataFrame, anchors, models: dict[str, gbdt.Ensemble], targets: list[float]) -> DataFrame:  # noqa: ANN001
    """(target, cluster_id, efc, ef_warm, m, share): each head's prediction feeds the next.

    clusters: features of each cluster, computed once for all targets. anchors(rows): adds the
    features of the anchor list for the efc chosen.
    """
    spark = clusters.sparkSession
    grid = spark.createDataFrame([(t,) for t in targets], "recall_at_k double")  # a few targets
    rows = clusters.crossJoin(grid)
    rows = gbdt.score(rows, models["A"], "a")
    rows = rows.withColumn("efc", F.greatest(F.lit(1), F.round("a").cast("int"))).withColumn("log_efc", F.log1p(F.col("efc").cast("double")))
    rows = anchors(rows)
    rows = gbdt.score(rows, models["B"], "b")
    rows = rows.withColumn("ef_warm", F.greatest(F.lit(1), F.round("b").cast("int"))).withColumns({"log_efw": F.log1p(F.col("ef_warm").cast("double")), "efw_over_efc": F.col("ef_warm") / F.greatest(F.lit(1), F.col("efc"))})
    rows = gbdt.score(rows, models["M"], "m")
    m = F.when(F.isnan("m") | F.col("m").isNull(), 0.0).otherwise(F.col("m"))
    rows = rows.withColumn("m", m)
    share = predicted_share(F.col("m"), F.col("ef_warm").cast("double"), F.col("efc").cast("double"))
    return rows.select(F.col("recall_at_k").alias("target"), "cluster_id", "efc", "ef_warm", "m", share.alias("share"))
