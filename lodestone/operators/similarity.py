"""Similarity of ranked neighbour lists, as expressions over arrays of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lists(neighbours: DataFrame, key: str = "qid") -> DataFrame:
    """(key, ids): the base ids of each key in order of rank."""
    one = F.array_sort(F.collect_list(F.struct("rank", "base_id")))
    return neighbours.groupBy(key).agg(F.transform(one, lambda x: x["base_id"]).alias("ids"))


def _prefixes(a: Column, b: Column, k: int) -> tuple[Column, Column, Column]:
    size = F.least(F.lit(k), F.size(a), F.size(b))
    return size, F.slice(a, 1, size), F.slice(b, 1, size)


def overlap(a: Column, b: Column, k: int) -> Column:
    """Share of ids that the first k of both lists have in common; prefixes end with the shorter list; 0 without any."""
    size, x, y = _prefixes(a, b, k)
    return F.when(size > 0, F.size(F.array_intersect(x, y)) / size).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column, k: int) -> Column:
    """Intersection over union of the same prefixes, 0 without any."""
    size, x, y = _prefixes(a, b, k)
    return F.when(size > 0, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


def truth_jaccard(a: Column, b: Column, k: int) -> Column:
    """Intersection over union of the first k without missing ids (negative); 1 where both are empty."""
    real = lambda c: F.array_distinct(F.filter(F.slice(c, 1, k), lambda x: x >= 0))
    x, y = real(a), real(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(1.0))


def paired(nearest: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(qid, other, cosine, ids, other_ids): each query and its nearest other with their lists."""
    some = lists(neighbours)
    other = some.select(F.col("qid").alias("other"), F.col("ids").alias("other_ids"))
    return nearest.join(some, "qid").join(other, "other", "left")


def nearest_jaccard(nearest: DataFrame, neighbours: DataFrame, k: int) -> DataFrame:
    """(qid, other, cosine, jaccard); 0 without another query."""
    value = F.when(F.col("other_ids").isNull(), F.lit(0.0)).otherwise(truth_jaccard(F.col("ids"), F.col("other_ids"), k))
    return paired(nearest, neighbours).select("qid", "other", "cosine", value.alias("jaccard"))


def summary(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, median, 10th and 90th percentile, least and most."""
    p = F.percentile(column, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), p.alias("p"), F.min(column).alias("least"), F.max(column).alias("most"))
    return out.select("n", "mean", F.col("p")[0].alias("p10"), F.col("p")[1].alias("median"), F.col("p")[2].alias("p90"), "least", "most")
