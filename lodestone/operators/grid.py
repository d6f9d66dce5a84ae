"""Parameter grids of the search, and their predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def param_grid(spark: SparkSession, efc: list[int], ef_warm: list[int], shares: list[float]) -> DataFrame:
    """(efc, ef_warm, share): all triples whose ef_warm and share * ef_warm stay within efc."""
    make = lambda values, name, kind: spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    # three lists of parameters, a few rows each
    rows = make(efc, "efc", "int").crossJoin(make(ef_warm, "ef_warm", "int")).crossJoin(make(shares, "share", "double"))
    return rows.where((F.col("ef_warm") <= F.col("efc")) & (F.col("share") * F.col("ef_warm") <= F.col("efc") + 1e-5))
