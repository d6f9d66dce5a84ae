"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words. Sources in code point order, null last, weigh
1, 2, 3, repeating, and share all words by weight; a target stops at `most` times its
source's size and the excess goes to the others by weight until none is above. A source is
taken whole as often as its target holds it. For the rest, its documents are counted by
exact size: every size gives its share, rounded down, and what that leaves is fitted by a
bounded knapsack over the sizes' remaining counts. Of each size, the documents to take are
the first by a seeded hash.

Only (source, size, count) rows are brought together, one source at a time, and their number
is that of distinct sizes. The knapsack's width is bounded by FIT whatever the corpus holds.
Documents are picked without sorting a size's whole group: counts of BINS hash ranges tell
which ranges are taken whole, and only the one range at the edge is ranked. Rows that are
equal in doc_id, source and text have one hash and are ranked as one; where some of them are
taken, they are numbered by counts of SALTS random parts, so that no task gets all of them.

Defined results: a null text or one without words has size 0 and nothing is taken of it; the
null source is a source; repeated rows are documents of their own and equally likely; a
source of no words has target 0; an empty table gives no rows; extra columns pass through
mixed() whatever their names and are ignored by plan().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, packed, unpacked

#: Words that the knapsack fits exactly, after the shares and larger documents have been taken.
FIT = 8192
BINS = 4096
SALTS = 1024
#: One row a source comes to the driver; more sources than this are refused.
MAX_SOURCES = 1_000_000


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    seed: int = 17


def targets(sizes: list[int], weights: list[int], most: int) -> list[float]:
    """Share sum(sizes) by weight, no target above most * size, the excess reshared by weight."""
    caps = [float(most * s) for s in sizes]
    out = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s]
    left = float(sum(sizes))
    while free:
        whole = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / whole > caps[i]]
        if not above:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in above:
            out[i] = caps[i]
        left -= sum(caps[i] for i in above)
        free = [i for i in free if i not in set(above)]
    return out


def knapsack(sizes: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many of each size, within counts, come nearest to the budget, from below on a tie.

    The reachable sums up to twice the budget are the bits of an integer; each size is added
    in powers of two of its count, and the integers before each step lead back.
    """
    if budget <= 0:
        return {}
    limit = 2 * budget
    mask, reach = (1 << (limit + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for size, count in sorted(zip(sizes, counts), reverse=True):
        if not 0 < size <= limit:
            continue
        left, k = min(count, limit // size), 1
        while left and not reach >> budget & 1:
            k = min(k, left)
            steps.append((size, k, reach))
            reach |= reach << size * k & mask
            left, k = left - k, 2 * k
    below = reach & ((1 << (budget + 1)) - 1)
    at = below.bit_length() - 1
    above = reach >> budget + 1
    if above and (over := (above & -above).bit_length()) < budget - at:
        at = budget + over
    took: dict[int, int] = {}
    for size, k, before in reversed(steps):
        if not before >> at & 1:
            at -= size * k
            took[size] = took.get(size, 0) + k
    return took


def fit(sizes: np.ndarray, counts: np.ndarray, target: float, most: int, window: int = FIT) -> tuple[int, np.ndarray]:
    """Whole passes over a source, and how many more documents of each size."""
    order = np.argsort(-sizes, kind="stable")
    s, c = [int(x) for x in sizes[order]], [int(x) for x in counts[order]]
    whole = sum(a * b for a, b in zip(s, c))
    if not whole:
        return 0, np.zeros(len(sizes), np.int64)
    passes = min(most, int(target // whole))
    rest = 0 if passes == most else max(0, round(target) - passes * whole)
    took = [b * rest // whole if a else 0 for a, b in zip(s, c)]
    rest -= sum(a * b for a, b in zip(s, took))
    for i, a in enumerate(s):  # larger documents first, until the rest is small enough to fit exactly
        if a and rest > window:
            more = min(c[i] - took[i], (rest - window // 2) // a)
            took[i], rest = took[i] + max(0, more), rest - a * max(0, more)
    if rest > window:  # only documents larger than that are left
        fits = [i for i, a in enumerate(s) if a and took[i] < c[i]]
        i = min(fits, key=lambda i: abs(s[i] - rest), default=None)
        if i is not None and abs(s[i] - rest) < rest:
            took[i] += 1
    else:
        extra = knapsack(s, [b - t for b, t in zip(c, took)], rest)
        took = [t + extra.get(a, 0) for a, t in zip(s, took)]
    out = np.zeros(len(sizes), np.int64)
    out[order] = took
    return passes, out


KEYS = ["source_key", "size", "hash"]


def sized(docs: DataFrame, mix: Mix) -> DataFrame:
    """_row (all columns of docs), doc_id, size, source_key (never null) and hash, which tells doc_id and text."""
    rows = packed(docs).select("_row", F.col("_row.doc_id").cast("long").alias("doc_id"), F.col("_row.text").cast("string").alias("text"), F.col("_row.source").cast("string").alias("source"))
    return rows.select(
        "_row",
        "doc_id",
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source"))).alias("source_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(mix.seed), "doc_id", "text").alias("hash"),
    )


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `place`, 0, 1, ... within each key; rows are read from files and told apart by `at`."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)))
    held = rows.groupBy(*keys, "salt").agg(F.count("*").alias("held"))
    ahead = F.sum("held").over(Window.partitionBy(*keys).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select(*keys, "salt", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy(*keys, "salt").orderBy("at"))
    return rows.withColumn("rank", rank).join(held, [*keys, "salt"]).withColumn("place", F.col("ahead") + F.col("rank") - 1).drop("salt", "rank", "ahead")


def room(whole: str, ahead: str, mine: str) -> Column:
    """How much of `whole` is left for what holds `mine` behind `ahead` others."""
    return F.greatest(F.lit(0), F.least(F.col(mine), F.col(whole) - F.coalesce(F.col(ahead), F.lit(0)))).cast("long")


def plan(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken, source_key and hash."""
    spark = docs.sparkSession
    rows = materialize(sized(docs, mix).select("doc_id", *KEYS, F.monotonically_increasing_id().alias("at")), "sizes")
    counts = rows.groupBy("source_key", "size").agg(F.count("*").alias("n"))
    totals = counts.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("whole")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r.source_key == "n", r.source_key))
    weights = [mix.weights[i % len(mix.weights)] for i in range(len(totals))]
    goal = targets([r.whole for r in totals], weights, mix.most)
    goals = spark.createDataFrame([(r.source_key, r.whole, g) for r, g in zip(totals, goal)], "source_key string, source_size long, target double")
    most = mix.most

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        passes, took = fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), float(pdf["target"].iloc[0]), most)
        return pd.DataFrame({"source_key": pdf["source_key"], "size": pdf["size"], "n": pdf["n"], "passes": np.int64(passes), "took": took})

    chosen = counts.join(goals.select("source_key", "target"), "source_key").groupBy("source_key").applyInPandas(choose, "source_key string, size long, n long, passes long, took long")
    chosen = materialize(chosen, "mix")
    # equal rows count as one thing of `held` rows; ranges of the hash before the edge are taken whole
    partly = chosen.where("took > 0 and took < n").select("source_key", "size", "took")
    things = rows.groupBy(*KEYS).agg(F.count("*").alias("held")).join(partly, ["source_key", "size"]).withColumn("bin", F.pmod("hash", F.lit(BINS)))
    things = materialize(things, "things")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    bins = things.groupBy("source_key", "size", "bin").agg(F.sum("held").alias("in_bin"), F.first("took").alias("took"))
    bins = bins.withColumn("ahead", F.sum("in_bin").over(before.partitionBy("source_key", "size").orderBy("bin")))
    bins = bins.select("source_key", "size", "bin", "in_bin", room("took", "ahead", "in_bin").alias("of_bin"))
    inside = things.select(*KEYS, "held", "bin").join(bins, ["source_key", "size", "bin"])
    edge = (F.col("of_bin") > 0) & (F.col("of_bin") < F.col("in_bin"))
    ranked = inside.where(edge).withColumn("ahead", F.sum("held").over(before.partitionBy("source_key", "size", "bin").orderBy("hash")))
    ranked = ranked.select(*KEYS, "held", room("of_bin", "ahead", "held").alias("more"))
    sure = inside.where(~edge).select(*KEYS, "held", F.when(F.col("of_bin") > 0, F.col("held")).otherwise(F.lit(0)).cast("long").alias("more"))
    extra = materialize(sure.unionByName(ranked), "extra")
    one = rows.join(chosen.select("source_key", "size", "passes", (F.col("took") == F.col("n")).cast("long").alias("all")), ["source_key", "size"])
    one = one.join(extra, KEYS, "left")
    some = F.coalesce((F.col("more") > 0) & (F.col("more") < F.col("held")), F.lit(False))
    few = numbered(one.where(some), KEYS).withColumn("plus", (F.col("place") < F.col("more")).cast("long")).drop("place")
    one = one.where(~some).withColumn("plus", F.coalesce((F.col("more") > 0).cast("long"), F.col("all"))).unionByName(few)
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("passes") + F.col("plus")).cast("long")
    one = one.join(goals, "source_key").withColumn("copies", copies)
    source = F.when(F.col("source_key") != "n", F.substring("source_key", 2, 1 << 30))
    return one.select("doc_id", source.alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "source_key", "hash")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken.

    Rows that are equal in doc_id, source and text share the copies taken of them.
    """
    taken = plan(docs, mix).groupBy(*KEYS).agg(F.sum("copies").alias("copies"), F.count("*").alias("equal")).where("copies > 0")
    taken = materialize(taken, "taken")
    rest = F.col("copies") % F.col("equal")
    rows = sized(docs, mix).drop("doc_id").join(taken.hint("shuffle_hash"), KEYS).withColumn("share", F.floor(F.col("copies") / F.col("equal")))
    out = rows.where(rest == 0).select("_row", "share")
    if not taken.where(rest > 0).isEmpty():
        uneven = materialize(rows.where(rest > 0).withColumns({"rest": rest, "at": F.monotonically_increasing_id()}), "uneven")
        placed = numbered(uneven, KEYS)
        out = out.unionByName(placed.select("_row", (F.col("share") + (F.col("place") < F.col("rest")).cast("long")).alias("share")))
    out = out.where("share > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("share"))))
    return unpacked(out, docs)
