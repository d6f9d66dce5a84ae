"""The workload over the embeddings table: base rows, held-out queries, and what is derived of both."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, graph_search, grid, knn, recall, reuse
from ..sources.scratch import kept

K = 10
DEGREE = 16
SEEDS = 16
PROBES = 256
SMALL, LARGE = 128, 256
GRID = ([64, 128, 256], [64, 128, 256], [0.5, 1.0, 1.5])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class Workload:
    """Every fifth vector is a query and not in the base; a query's cluster is its label."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def vectors(self) -> DataFrame:
        return table(self.spark, self.sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")

    @cached_property
    def base(self) -> DataFrame:
        return self.vectors.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("base_id"), "vec")

    @cached_property
    def queries(self) -> DataFrame:
        return self.vectors.where("vec_id % 5 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("cluster_id"), "vec")

    @cached_property
    def truth(self) -> DataFrame:
        return knn.exact_knn(self.queries, self.base, K)

    @cached_property
    def centers(self) -> DataFrame:
        return features.centroids(self.queries)

    @cached_property
    def probes(self) -> DataFrame:
        return features.probe(self.centers, self.base, PROBES)

    @cached_property
    def graph(self) -> DataFrame:
        return knn.knn_graph(self.base, DEGREE)

    @cached_property
    def index(self) -> graph_search.Graph:
        """The graph as a file that all searches of the workload share."""
        return graph_search.collect_graph(self.base, self.graph)

    @cached_property
    def nearest(self) -> DataFrame:
        return knn.nearest_query(self.queries)

    def hold(self) -> Workload:
        """Write what plans of several actions read again and again."""
        for name in ("centers", "probes", "graph", "truth"):
            self.__dict__[name] = kept(getattr(self, name), name)
        return self

    def reuse(self, seeds: int = SEEDS, k: int = K) -> DataFrame:
        return reuse.anchor_reuse_knn(self.queries, self.base, self.probes, self.graph, k, seeds)

    def counted(self, k: int = K) -> DataFrame:
        return recall.hits(self.queries, self.truth, self.reuse(), k)

    def grid(self) -> DataFrame:
        return grid.param_grid(self.spark, *GRID)
