"""Anchor reuse as joins: the queries of a cluster share the neighbourhood of its centroid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import knn


def anchor_candidates(anchors: DataFrame, edges: DataFrame, seeds: int, hops: int = 1) -> DataFrame:
    """(cluster_id, base_id): the first seeds of each anchor list and what is at most `hops` edges away. No seeds, no candidates."""
    found = anchors.where(F.col("rank") <= seeds).select("cluster_id", "base_id")
    for _ in range(hops):
        step = found.join(edges, found.base_id == edges.src).select("cluster_id", F.col("dst").alias("base_id"))
        found = found.unionByName(step).distinct()
    return found


def anchor_reuse_knn(members: DataFrame, base: DataFrame, anchors: DataFrame, edges: DataFrame, k: int, seeds: int, hops: int = 1) -> DataFrame:
    """(qid, rank, base_id, d2): every query's k nearest among its cluster's candidates.

    Candidates are found once a cluster, not once a query; blocks of queries and of candidates
    meet by cluster.
    """
    candidates = anchor_candidates(anchors, edges, seeds, hops)
    vectors = candidates.join(base.select("base_id", "vec"), "base_id").select(F.col("cluster_id").alias("group"), "base_id", "vec")
    return knn.grouped_knn(members.where("cluster_id >= 0").select(F.col("cluster_id").alias("group"), "qid", "vec"), vectors, k)
