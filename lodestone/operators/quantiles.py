"""Exact percentiles of a column of any size, with linear interpolation.

Spark's own function holds every distinct value of a group in one task; here counts of BINS
equal intervals narrow down where a rank lies, pass by pass, until few enough values are left
to be read off: for a whole table on the driver, for many groups by joins. Infinite values
are counted apart.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 2048
FEW = 20_000


def _value_at(df: DataFrame, rank: int, low: float, high: float, before: int, held: int) -> float:
    """The value of a rank (from 0) that lies in [low, high]; `before` values lie below low and `held` inside."""
    x = F.col("x")
    while held > FEW and high > low:
        width = high / BINS - low / BINS  # the difference of two finite numbers may not be finite
        if low + width == low or width <= 0:
            break
        slot = F.least(F.floor(x / F.lit(width) - F.lit(low / width)), F.lit(BINS - 1))
        rows = df.where(x.between(low, high)).groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
        for r in sorted(rows.collect(), key=lambda r: r.slot):
            if rank < before + r.n:
                low, high, held = r.a, r.b, r.n
                break
            before += r.n
    if low == high:
        return low
    rows = df.where(x.between(low, high)).groupBy("x").agg(F.count("*").alias("n")).orderBy("x").collect()
    for r in rows:
        if rank < before + r.n:
            return r.x
        before += r.n
    return high


def column_percentiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Percentiles of each column's values that are neither null nor NaN; None without any."""
    values = df.select(*(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)))
    ends = values.agg(*(f(f"c{i}") for i in range(len(columns)) for f in (F.count, F.min, F.max))).first()
    few = [i for i in range(len(columns)) if 0 < ends[3 * i] <= FEW]
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    if few:
        read = values.agg(*(F.percentile(f"c{i}", F.array(*map(F.lit, shares))) for i in few)).first()
        out |= {columns[i]: list(x) for i, x in zip(few, read)}
    for i, c in enumerate(columns):
        n, low, high = ends[3 * i : 3 * i + 3]
        if n > FEW:
            out[c] = _large(values.select(F.col(f"c{i}").alias("x")).where("x is not null"), n, low, high, shares)
    return out


def _large(values: DataFrame, n: int, low: float, high: float, shares: list[float]) -> list[float]:
    lowest, highest = 0, 0
    if math.isinf(low) or math.isinf(high):
        inf = F.lit(math.inf)
        finite = F.when(F.abs("x") != inf, F.col("x"))
        lowest, highest, low, high = values.agg(F.count_if(F.col("x") == -inf), F.count_if(F.col("x") == inf), F.min(finite), F.max(finite)).first()
        values = values.where(F.abs("x") != inf)
    known: dict[int, float] = {}

    def at(rank: int) -> float:
        if rank < lowest:
            return -math.inf
        if rank >= n - highest:
            return math.inf
        if rank not in known:
            known[rank] = _value_at(values, rank - lowest, low, high, 0, n - lowest - highest)
        return known[rank]

    out = []
    for p in shares:
        place = p * (n - 1)
        a, b = math.floor(place), math.ceil(place)
        out.append(at(a) if at(a) == at(b) else at(a) + (at(b) - at(a)) * (place - a))
    return out


def values_at(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, rank, x): the value of each wanted (g, rank from 0) among the finite x of rows (g, x).

    Two rounds of interval counts, each over at most BINS rows a range, leave about one value in
    BINS * BINS to be ranked, or ranges of one value, however large a group is.
    """
    span = ["g", "low", "high"]
    left = wanted.join(rows.groupBy("g").agg(F.min("x").alias("low"), F.max("x").alias("high")), "g").withColumn("skip", F.col("rank"))
    for _ in range(2):
        ranges = left.select(*span).distinct()
        width = F.col("high") / BINS - F.col("low") / BINS
        slot = F.when(width > 0, F.least(F.floor(F.col("x") / width - F.col("low") / width), F.lit(BINS - 1))).otherwise(F.lit(0))
        held = rows.join(ranges, "g").where(F.col("x").between(F.col("low"), F.col("high"))).groupBy(*span, slot.alias("slot")).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
        upto = F.sum("n").over(Window.partitionBy(*span).orderBy("slot"))
        held = held.withColumn("ahead", upto - F.col("n"))
        left = left.join(held, span).where((F.col("skip") >= F.col("ahead")) & (F.col("skip") < F.col("ahead") + F.col("n")))
        left = left.select("g", "rank", F.col("a").alias("low"), F.col("b").alias("high"), (F.col("skip") - F.col("ahead")).alias("skip"))
    one = left.where("low = high").select("g", "rank", F.col("low").alias("x"))
    many = left.where("low < high")
    inside = rows.join(many.select(*span).distinct(), "g").where(F.col("x").between(F.col("low"), F.col("high")))
    inside = inside.withColumn("skip", F.row_number().over(Window.partitionBy(*span).orderBy("x")) - 1)
    return one.unionByName(many.join(inside, [*span, "skip"]).select("g", "rank", "x"))


def group_percentiles(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(g, n, one column for each name): percentiles of the finite x of rows (g, x), interpolated."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    place = {name: F.lit(p) * (F.col("n") - 1) for name, p in shares.items()}
    ranks = F.array(*(f(x).cast("long") for x in place.values() for f in (F.floor, F.ceil)))
    found = values_at(rows, sizes.select("g", F.explode(F.array_distinct(ranks)).alias("rank")))
    both = sizes.join(found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at")), "g")  # two a share
    value = lambda x: F.element_at("at", F.floor(x).cast("long")) + (F.element_at("at", F.ceil(x).cast("long")) - F.element_at("at", F.floor(x).cast("long"))) * (x - F.floor(x))
    return both.select("g", "n", *(value(x).alias(name) for name, x in place.items()))


def exact_percentiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    return column_percentiles(df, [column], shares)[column]
