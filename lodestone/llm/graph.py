"""Connected components of an edge table, with DataFrame operations only.

Alternating large and small stars: each round, every vertex hands its larger neighbours, then
its smaller ones, over to the least vertex it knows. A round is a pre-aggregated minimum and
a join; edges are kept once; the table of edges never grows and at the end is a star at the
least vertex of each component. Each round is written to the shared folder, so a lost
executor costs one round. Edges that are stars already need none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

MAX_ROUNDS = 60


def _settled(links: DataFrame) -> bool:
    """Whether the edges are stars: no vertex has two lower ends, or is a lower end and has one."""
    ends = links.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(v, component): every vertex of edges (a, b), of any ordered type, and the least vertex of its component.

    Loops, repeated edges, either direction and null ends are allowed; an edge with a null end is no edge.
    """
    lower = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a") == F.col("b")).alias("loop"))
    lower = lower.where("loop is not null").select("a", "b")
    links = materialize(lower.where("a <> b").distinct(), "edges")
    alone = lower.where("a = b").select("a").distinct()
    for _ in range(MAX_ROUNDS):
        if _settled(links):
            break
        # large star: larger neighbours go to the least of the neighbours and the vertex itself
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the vertex and its smaller neighbours go to the least of them
        large = materialize(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = materialize(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small")
        discard(links)
        discard(large)
        links = after
    else:
        raise RuntimeError("the components did not settle")
    stars = links.select(F.col("a").alias("v"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("v"), F.col("b").alias("component")).unionByName(alone.select(F.col("a").alias("v"), F.col("a").alias("component")))
    return stars.unionByName(roots).groupBy("v").agg(F.min("component").alias("component"))
