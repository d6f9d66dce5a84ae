"""Farthest-first centers and Lloyd's k-means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector
from . import knn


def farthest_first(rows: DataFrame, k: int, min_sep: float = 0.0, first: int | None = None) -> DataFrame:
    """(place, qid): centers, each the row farthest by angle from those before; ties go to the lesser id.

    Rows nearer than min_sep to a center are left out; when none is left, min_sep shrinks by
    a fifth. k rounds, each one pass that keeps the least angle so far.
    """
    spark = rows.sparkSession
    rows = rows.select("qid", F.col("vec").cast("array<double>").alias("vec")).withColumn("near", F.lit(10.0)).cache()
    start = rows.agg(F.min("qid")).first()[0] if first is None else first
    chosen, last = [start], rows.where(F.col("qid") == start).first().vec
    while len(chosen) < k:
        if last is not None:
            after = rows.withColumn("near", F.least("near", vector.angle(F.col("vec"), F.array(*map(F.lit, last))))).cache()
        # -d as second key: the least id among the farthest
        best = after.where(~F.col("qid").isin(chosen)).select("near", (-F.col("qid")).alias("d"), "vec").where(F.col("near") >= min_sep).agg(F.max(F.struct("near", "d", "vec"))).first()[0]
        if after is not rows:
            rows.unpersist()
            rows = after
        last = None
        if best is None:
            if min_sep < 1e-9:
                break
            min_sep *= 0.8
            continue
        chosen.append(-best.d)
        last = best.vec
    rows.unpersist()
    return spark.createDataFrame([(i, q) for i, q in enumerate(chosen)], "place int, qid long")


def assign(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """(qid, cluster_id, d2): the nearest center of each row, the lesser number on a tie."""
    found = knn.exact_knn(rows, centers.select(F.col("cluster_id").cast("long").alias("base_id"), F.col("center").alias("vec")), 1)
    return found.select("qid", F.col("base_id").cast("int").alias("cluster_id"), "d2")


def kmeans(rows: DataFrame, k: int, rounds: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Lloyd's rounds from k random rows, until labels stay: (assignment, centers). An empty cluster keeps its center."""
    spark = rows.sparkSession
    rows = rows.select("qid", F.col("vec").cast("array<double>").alias("vec")).cache()
    seeds = rows.orderBy(F.xxhash64(F.lit(seed), "qid"), "qid").limit(k).collect()
    centers = {i: list(r.vec) for i, r in enumerate(seeds)}
    before = None
    for _ in range(rounds + 1):
        table = spark.createDataFrame(list(centers.items()), "cluster_id int, center array<double>")
        found = assign(rows, table)
        mark = tuple(found.agg(F.bit_xor(F.xxhash64("qid", "cluster_id")), F.count("*")).first())
        if mark == before:
            break
        before = mark
        dim = len(next(iter(centers.values())))
        means = found.join(rows, "qid").groupBy("cluster_id").agg(F.array(*(F.avg(F.col("vec")[i]) for i in range(dim))).alias("c")).collect()
        centers |= {r.cluster_id: list(r.c) for r in means}
    return found, table


def place_in_order(rows: DataFrame, seed: int | None = None) -> DataFrame:
    """rows (cluster_id, number, ...) with qid, their place from 0: shuffled by a seed, or by cluster with outliers last.

    Places within parts of the order, plus the counts of the parts before: no task sorts all rows.
    """
    if seed is not None:
        mixed = F.xxhash64(F.lit(seed), "cluster_id", "number")
        rows, inside = rows.withColumns({"_part": F.shiftright(mixed, 52).cast("long"), "_order": mixed}), ["_order", "cluster_id", "number"]
    else:
        rows, inside = rows.withColumns({"_part": F.when(F.col("cluster_id") < 0, F.lit(1 << 40)).otherwise(F.col("cluster_id").cast("long")), "_order": F.lit(0)}), ["number"]
    counts = rows.groupBy("_part").agg(F.count("*").alias("n"))
    ahead = counts.select("_part", F.expr("coalesce(sum(n) over (order by _part rows between unbounded preceding and 1 preceding), 0L)").alias("ahead"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*inside)) - 1
    return rows.withColumn("_place", place).join(ahead, "_part").withColumn("qid", (F.col("ahead") + F.col("_place")).cast("long")).drop("_part", "_order", "_place", "ahead")
