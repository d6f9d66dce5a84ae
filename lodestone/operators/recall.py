"""Recall of search results against exact neighbours.

truth and results are (qid, rank, base_id). What is expected of a query doesn't shrink where
its truth is padded with missing ids, nor where the query was never searched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hits(queries: DataFrame, truth: DataFrame, results: DataFrame, k: int, width: int | None = None) -> DataFrame:
    """(qid, hits, expected) for every query; truth counts up to its first missing id."""
    expected = min(k, width or k)
    real = truth.where((F.col("rank") <= k) & (F.col("base_id") >= 0))
    broken = truth.where(F.col("base_id") < 0).groupBy("qid").agg(F.min("rank").alias("stop"))
    real = real.join(broken, "qid", "left").where(F.col("stop").isNull() | (F.col("rank") < F.col("stop"))).select("qid", "base_id")
    got = results.where(F.col("rank") <= k).select("qid", "base_id").distinct()
    found = real.join(got, ["qid", "base_id"]).groupBy("qid").agg(F.count("*").alias("hits"))
    return queries.select("qid").distinct().join(found, "qid", "left").select("qid", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.lit(expected).cast("long").alias("expected"))


def per_query(counted: DataFrame) -> DataFrame:
    return counted.select("qid", F.when(F.col("expected") > 0, F.col("hits") / F.col("expected")).otherwise(0.0).alias("recall"))


def overall(counted: DataFrame) -> DataFrame:
    value = F.when(F.sum("expected") > 0, F.sum("hits") / F.sum("expected")).otherwise(0.0)
    return counted.agg(F.sum("hits").alias("hits"), F.sum("expected").alias("expected"), value.alias("recall"))


def by_cluster(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """labels: (qid, cluster_id); outliers, cluster -1, are left out."""
    value = F.when(F.sum("expected") > 0, F.sum("hits") / F.sum("expected")).otherwise(0.0)
    rows = counted.join(labels.where("cluster_id >= 0").select("qid", "cluster_id"), "qid")
    return rows.groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum("hits").alias("hits"), value.alias("recall"))


def at_several(labels: DataFrame, truth: DataFrame, results: DataFrame, ks: tuple[int, ...] = (1, 10, 100), width: int = 100) -> DataFrame:
    """(cluster_id, recall_at_k...): in one pass, an id counts at k when both lists hold it in their first k."""
    most = max(ks)
    real = truth.where((F.col("rank") <= most) & (F.col("base_id") >= 0)).select("qid", "base_id", F.col("rank").alias("t"))
    got = results.where(F.col("rank") <= most).select("qid", "base_id", F.col("rank").alias("r"))
    both = real.join(got, ["qid", "base_id"]).groupBy("qid").agg(*(F.count_if((F.col("t") <= k) & (F.col("r") <= k)).alias(f"h{k}") for k in ks))
    rows = labels.where("cluster_id >= 0").select("qid", "cluster_id").join(both, "qid", "left")
    out = [F.when(F.lit(min(k, width)) > 0, F.sum(F.coalesce(f"h{k}", F.lit(0))) / (F.count("*") * min(k, width))).otherwise(0.0).alias(f"recall_at_{k}") for k in ks]
    return rows.groupBy("cluster_id").agg(*out)
