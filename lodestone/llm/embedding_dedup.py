"""Near-duplicate embeddings by random-hyperplane signs, exact cosines and connected components.

Vectors of one label and the same components form a class. Each class is hashed into several
tables by the signs of its products with random hyperplanes. Classes that meet in a bucket
are compared by their cosine in double precision; a pair is counted in the first table in
which it meets, so that links are counted once and never listed: a bucket gives each class
its number of links, and a forest that connects what is linked. Tables in which the same
classes meet count as one, their first: ids only are dealt out until that is known, and what
lies close together, and so meets in most tables, travels once. Buckets too large for a task
are dealt out as pairs of blocks. Components travel in single precision where that holds them
exactly, and are compared in double precision.

The number of tables follows from the signs' agreement at the threshold and `miss`, the
chance that a pair at the threshold meets in none; the width of a sign from the number of
classes, so that unrelated vectors seldom meet.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components,
and vectors without a label, link with nothing and are kept; vectors of different length
never link; repeated rows are vectors of their own that link with each other; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph
from .common import map_arrow, materialize, perhaps_in
from .signature_trees import UnionFind


@dataclass(frozen=True)
class Dedup:
    cosine: float = 0.98
    miss: float = 1e-7
    seed: int = 23
    block: int = 1024

    def tables(self, bits: int) -> int:
        meet = (1 - math.acos(self.cosine) / math.pi) ** bits
        return math.ceil(math.log(self.miss) / math.log1p(-meet))


def planes(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def sign_codes(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """(n, tables) codes of `bits` signs each."""
    signs = (vectors @ planes(vectors.shape[1], bits * tables, seed) >= 0).reshape(len(vectors), tables, bits)
    return (signs << np.arange(bits, dtype=np.int64)).sum(axis=2)


def pack(v: np.ndarray) -> bytes:
    """A letter for the width of the numbers, and the numbers."""
    with np.errstate(over="ignore"):
        single = v.astype("<f4")
    return b"f" + single.tobytes() if (single == v).all() else b"d" + v.astype("<f8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f4" if data[:1] == b"f" else "<f8", offset=1).astype(np.float64)


def classified(vectors: DataFrame) -> DataFrame:
    """vec_id, label, print (16 bytes that stand for the components) and vec (packed components); print is null where nothing links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, out = [], []
            for label, x in zip(batch.column("label").to_pylist(), batch.column("embedding").to_pylist()):
                v = None if x is None or label is None or None in x else np.array(x, np.float64) + 0.0  # no -0.0
                fine = v is not None and len(v) and np.isfinite(v).all() and v.any()
                prints.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest() if fine else None)
                out.append(pack(v) if fine else None)
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(prints, pa.binary()), pa.array(out, pa.binary())], names=["vec_id", "label", "print", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return map_arrow(rows, run, "vec_id long, label string, print binary, vec binary")


def compare(one: np.ndarray, two: np.ndarray | None, codes_one: np.ndarray, codes_two: np.ndarray | None, table: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs that link and meet in no table before this one. Rows are unit vectors."""
    hits = one @ (one if two is None else two).T >= cosine
    if two is None:
        hits = np.triu(hits, 1)
    x, y = np.nonzero(hits)
    other = codes_one if codes_two is None else codes_two
    new = ~(codes_one[x, :table] == other[y, :table]).any(axis=1)
    return x[new], y[new]


def links(classes: DataFrame, how: Dedup) -> DataFrame:
    """(a, b, w): w vectors are linked with class a; where b is set, an edge between classes.

    classes: cid, label, vec, copies.
    """
    total = classes.count()
    bits = min(40, max(12, math.ceil(math.log2(total + 1))))
    tables, seed, cosine, block = how.tables(bits), how.seed, how.cosine, how.block

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [unpack(v.as_py()) for v in batch.column("vec")]
            sizes = np.array([len(v) for v in vectors])
            codes = np.zeros((len(vectors), tables), np.int64)
            for dim in np.unique(sizes):
                mine = np.flatnonzero(sizes == dim)
                x = np.stack([vectors[i] for i in mine])
                codes[mine] = sign_codes(x / np.linalg.norm(x, axis=1, keepdims=True), bits, tables, seed)
            width = "<i4" if bits < 32 else "<i8"
            packed = [np.ascontiguousarray(row, width).tobytes() for row in codes]
            yield pa.record_batch([batch.column(c) for c in ("cid", "label", "vec", "copies")] + [pa.array(sizes), pa.array(packed, pa.binary())], names=["cid", "label", "vec", "copies", "dim", "codes"])

    signed = materialize(map_arrow(classes.select("cid", "label", "vec", "copies"), hashed, "cid long, label string, vec binary, copies long, dim long, codes binary"), "signs")
    piece = 4 if bits < 32 else 8
    code = F.substring("codes", F.col("table") * piece + 1, F.lit(piece))
    spots = signed.select("cid", "label", "dim", "codes", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("table"))
    spots = spots.select("cid", "table", F.xxhash64("label", "dim", "table", code).alias("unit"))
    marks = [F.count("*").alias("m"), F.bit_xor("cid").alias("x"), F.bit_xor(F.xxhash64("cid")).alias("y"), F.first("table").alias("table")]
    full = spots.groupBy("unit").agg(*marks).where("m > 1")
    # units of the same members count once, in their first table
    full = full.groupBy("m", "x", "y").agg(F.min(F.struct("table", "unit")).alias("at")).select("m", "at.table", "at.unit")
    full = materialize(full, "buckets")
    blocks = F.ceil(F.col("m") / F.lit(block)).cast("int")
    spots = perhaps_in(spots.select("cid", "unit"), F.col("unit"), full, "unit").join(full, "unit")
    spots = spots.select("unit", "table", "cid", F.pmod(F.xxhash64("cid", "unit"), blocks).cast("int").alias("part"), blocks.alias("parts"))
    spots = spots.withColumn("other", F.expr("explode(sequence(0, parts - 1))"))
    spots = spots.select("unit", "table", "cid", "part", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"))
    spots = materialize(spots, "spots")
    rows = spots.join(perhaps_in(signed, F.col("cid"), spots, "cid"), "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in common.units(batches, "unit", "one", "two"):
            # a unit is a hash of label, length, table and code: go by the values themselves
            labels = np.array(unit.column("label").to_pylist(), object)
            at, dims = unit.column("table").to_numpy(), unit.column("dim").to_numpy()
            for label, table, dim in {*zip(labels, at, dims)}:
                some = unit.filter(pa.array((labels == label) & (at == table) & (dims == dim)))
                if some.num_rows < 2:
                    continue
                codes = np.stack([np.frombuffer(c.as_py(), "<i4" if piece == 4 else "<i8") for c in some.column("codes")])
                x = np.stack([unpack(v.as_py()) for v in some.column("vec")])
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                cid, copies, part = (some.column(c).to_numpy() for c in ("cid", "copies", "part"))
                if unit.column("one")[0].as_py() == unit.column("two")[0].as_py():
                    i, j = compare(x, None, codes, None, table, cosine)
                else:
                    left, right = np.flatnonzero(part == unit.column("one")[0].as_py()), np.flatnonzero(part == unit.column("two")[0].as_py())
                    i, j = compare(x[left], x[right], codes[left], codes[right], table, cosine)
                    i, j = left[i], right[j]
                if not len(i):
                    continue
                weight = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
                near = np.flatnonzero(weight)
                sets = UnionFind(len(x))
                tree = [(a, b) for a, b in zip(i.tolist(), j.tolist()) if sets.join(a, b)]
                a, b = np.array(tree).T
                null = pa.nulls(len(near), pa.int64())
                yield pa.record_batch([pa.array(cid[near]), null, pa.array(weight[near].astype(np.int64))], names=["a", "b", "w"])
                yield pa.record_batch([pa.array(cid[a]), pa.array(cid[b]), pa.array(np.zeros(len(a), np.int64))], names=["a", "b", "w"])

    rows = rows.repartition("unit", "one", "two").sortWithinPartitions("unit", "one", "two")
    return map_arrow(rows.select("unit", "one", "two", "part", "table", "cid", "label", "dim", "copies", "codes", "vec"), run, "a long, b long, w long")


def component_table(vectors: DataFrame, how: Dedup = Dedup()) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    rows = materialize(classified(vectors), "vectors")
    # a class is named by its least vec_id; without one, by a number below all
    classes = rows.where("print is not null").groupBy("label", "print").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    classes = classes.withColumn("cid", F.xxhash64("label", "print"))
    classes = materialize(classes, "classes")
    found = materialize(links(classes, how), "links")
    weight = found.where("b is null").groupBy("a").agg(F.sum("w").alias("near")).withColumnRenamed("a", "cid")
    groups = graph.components(found.where("b is not null").select("a", "b")).withColumnRenamed("v", "cid")
    named = classes.select("cid", "label", "print", "least", "copies").join(groups, "cid", "left").join(weight, "cid", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "cid")), "named")
    name = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(name, "component").select("label", "print", "component_id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "label", "print").join(named, ["label", "print"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
