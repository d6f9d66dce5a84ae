"""Preparation of training tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import column_percentiles


def coerce_numeric(df: DataFrame, *columns: str) -> DataFrame:
    """Columns as doubles, null where a value can't be read."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def finite(column: str):  # noqa: ANN201
    x = F.col(column)
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def median_impute(df: DataFrame, *columns: str) -> DataFrame:
    """Nulls, NaN and infinities become the column's median, 0 in a column without any number."""
    out = df.withColumns({c: finite(c) for c in columns})
    fill = column_percentiles(out, list(columns), [0.5])
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(float(fill[c][0] or 0.0))) for c in columns})


def winsorize(df: DataFrame, *columns: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values brought into the range between two percentiles, where that range isn't empty."""
    new = {}
    for c, (a, b) in column_percentiles(df, list(columns), [low, high]).items():
        if a is not None and a < b:
            new[c] = F.when(F.col(c).isNotNull(), F.greatest(F.lit(a), F.least(F.lit(b), F.col(c))))
    return df.withColumns(new) if new else df


def mean_absolute_error(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(truth) - F.col(guess))).alias("mae"))


def select_features(default: list[str], keep: list[str] | None = None, drop: list[str] | None = None) -> list[str]:
    """The default list, in its order, cut down to keep and without drop; nothing left is an error."""
    out = [f for f in default if (not keep or f in keep) and f not in (drop or [])]
    if not out:
        raise ValueError("no features are left")
    return out


def monotone_signs(features: list[str], rising: list[str], falling: list[str]) -> list[int]:
    """1, -1 or 0 for each feature: whether predictions may only rise or fall with it."""
    return [1 if f in rising else -1 if f in falling else 0 for f in features]


def with_recall(df: DataFrame, k: int) -> DataFrame:
    """The column recall_at_k that training needs, from the collected recall_at_1, 10 or 100."""
    return df.withColumn("recall_at_k", F.col(f"recall_at_{k}"))
