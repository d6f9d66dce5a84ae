"""Best-first search over a neighbour graph, one task for each block of a cluster's queries.

The search chases pointers, which no relational operator does well; so the queries of a
cluster go together, and their anchor search is done once and handed to all of them. The graph and its
vectors are one file of flat arrays, which the driver writes piece by piece and Spark brings to
each machine; workers map it, so the operating system keeps the pages that are in use, once for all of them.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import tempfile
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import lossless, matrix, tasks

#: Of a graph's file, which every machine gets.
FILE_BYTES = 16 << 30
#: Bytes that the driver takes at a time while it writes the file, and rows packed together.
PART_BYTES = 8 << 20
PACKED = 1024
#: Pivots compared at a time.
PIVOTS = 4096


@dataclass
class Layout:
    """What a graph's file holds, one after the other: ids, starts, vectors, neighbours."""

    rows: int
    edges: int
    dim: int
    single: bool
    pivot_every: int
    name: str = ""

    def sections(self) -> list[tuple[str, int]]:
        return [("<i8", self.rows), ("<i8", self.rows + 1), ("<f4" if self.single else "<f8", self.rows * self.dim), ("<i4" if self.rows < 1 << 31 else "<i8", self.edges)]

    def bytes(self) -> int:
        return sum(np.dtype(kind).itemsize * n for kind, n in self.sections())

    def map(self, path: str, mode: str = "r") -> list[np.ndarray]:
        out, at = [], 0
        for kind, n in self.sections():
            out.append(np.asarray(np.memmap(path, kind, mode, at, n)) if n else np.zeros(0, kind))
            at += np.dtype(kind).itemsize * n
        return out

    def graph(self, path: str) -> Graph:
        ids, start, vectors, to = self.map(path)
        pivots = np.flatnonzero(ids % self.pivot_every == 0)
        return Graph(ids, vectors.reshape(self.rows, -1) if self.rows else np.zeros((0, self.dim)), start, to, pivots if len(pivots) else np.arange(min(1, self.rows)), self)


@dataclass
class Graph:
    """Rows in order of id: vectors, and neighbours of row i at to[start[i]:start[i + 1]]."""

    ids: np.ndarray
    vectors: np.ndarray
    start: np.ndarray
    to: np.ndarray
    pivots: np.ndarray
    layout: Layout | None = None  # of the file that all machines have

    def entry(self, q: np.ndarray) -> int:
        """The pivot nearest to q, -1 in an empty graph."""
        near = []
        for at in range(0, len(self.pivots), PIVOTS):
            some = self.pivots[at : at + PIVOTS]
            d2 = self.distance(some, q)
            near.append((d2.min(), int(some[np.argmin(d2)])))
        return min(near)[1] if near else -1

    def distance(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        gap = self.vectors[rows] - q
        return (gap * gap).sum(axis=1)


_open: dict[str, Graph] = {}
_sent: set[tuple[str, str]] = set()


def _mapped(layout: Layout) -> Graph:
    """The graph in a worker; the file is there before the task."""
    if layout.name not in _open:
        _open[layout.name] = layout.graph(SparkFiles.get(layout.name))
    return _open[layout.name]


def shared(df: DataFrame, g: Graph) -> Callable[[], Graph]:
    """What gives the workers the graph: its file, or a broadcast where it has none."""
    if g.layout is None:
        held = df.sparkSession.sparkContext.broadcast(g)
        return lambda: held.value
    layout = g.layout
    return lambda: _mapped(layout)


def _pieces(rows: DataFrame, columns: list[str], size: int) -> Iterator[dict[str, bytes]]:
    """The columns as bytes, in the order of the first ones that aren't lists, a bounded part at a time."""
    order = [c for c in columns if c != "vec"]
    parts = rows.select(*columns).repartitionByRange(max(1, -(-size // PART_BYTES)), *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACKED):
                some = batch.slice(at, PACKED)
                yield pa.record_batch([pa.array([(matrix(some.column(c)) if c == "vec" else some.column(c).to_numpy().astype("<i8")).tobytes()], pa.binary()) for c in columns], names=columns)

    for row in parts.mapInArrow(pack, ", ".join(f"{c} binary" for c in columns)).toLocalIterator():
        yield row.asDict()


def collect_graph(base: DataFrame, edges: DataFrame, pivot_every: int = 32, most: int = FILE_BYTES) -> Graph:
    """The graph as a file on the driver and, as soon as a task needs it, on every machine; refused when it is larger than `most` bytes."""
    spark = base.sparkSession
    base = base.select(F.col("base_id").cast("long").alias("base_id"), F.col("vec").cast("array<double>").alias("vec")).where("vec is not null")
    edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    n, dim, single = base.agg(F.count("*"), F.max(F.size("vec")), lossless()).first()
    layout = Layout(n, edges.count(), dim or 0, bool(single), pivot_every)
    if layout.bytes() > most:
        raise ValueError("the graph is too large to be sent to every machine; search parts of it, or use anchor_reuse_knn")
    folder = tempfile.mkdtemp(prefix="lodestone-graph-")
    path = f"{folder}/graph"
    with open(path, "wb") as f:
        f.truncate(max(1, layout.bytes()))
    ids, start, vectors, to = layout.map(path, "r+")
    at = 0
    for piece in _pieces(base, ["base_id", "vec"], n * (layout.dim * 8 + 16)):
        some = np.frombuffer(piece["base_id"], "<i8")
        ids[at : at + len(some)] = some
        vectors[at * layout.dim : (at + len(some)) * layout.dim] = np.frombuffer(piece["vec"])
        at += len(some)
    at = 0
    for piece in _pieces(edges, ["src", "dst"], layout.edges * 32):
        src, dst = (np.searchsorted(ids, np.frombuffer(piece[c], "<i8")) for c in ("src", "dst"))
        to[at : at + len(dst)] = dst
        np.add.at(start, src + 1, 1)
        at += len(dst)
    np.cumsum(start, out=start)
    digest = hashlib.blake2b(repr(layout).encode(), digest_size=12)
    with open(path, "rb") as f:
        while data := f.read(1 << 20):
            digest.update(data)
    layout.name = f"graph-{digest.hexdigest()}"
    named = f"{folder}/{layout.name}"
    os.rename(path, named)
    mark = (spark.sparkContext.applicationId, layout.name)
    if mark not in _sent:  # the same graph goes out once
        spark.sparkContext.addFile(named)
        _sent.add(mark)
    return layout.graph(named)


def search(g: Graph, q: np.ndarray, ef: int, seeds: np.ndarray) -> tuple[list[tuple[float, int]], int]:
    """Best-first search from the seeds with a list of ef: [(squared distance, row)] ascending, and the rows visited.

    The order of equal distances is by row. It stops once the nearest open row is farther
    than the worst of a full list.
    """
    found, visited, _ = walk(g, q, ef, seeds)
    return found, visited


def walk(g: Graph, q: np.ndarray, ef: int, seeds: np.ndarray) -> tuple[list[tuple[float, int]], int, int]:
    """What search() gives, and the number of rows whose neighbours were looked at."""
    seeds = np.unique(seeds[seeds >= 0])
    if not len(seeds) or ef < 1:
        return [], 0, 0
    seen = np.zeros(len(g.ids), bool)
    seen[seeds] = True
    open_ = [(float(d), int(r)) for d, r in zip(g.distance(seeds, q), seeds)]
    top = [(-d, -r) for d, r in open_]
    heapq.heapify(open_)
    heapq.heapify(top)
    while len(top) > ef:
        heapq.heappop(top)
    visited, steps = len(seeds), 0
    while open_:
        d, r = heapq.heappop(open_)
        if len(top) >= ef and d > -top[0][0]:
            break
        steps += 1
        near = g.to[g.start[r] : g.start[r + 1]]
        near = near[~seen[near]]
        if not len(near):
            continue
        seen[near] = True
        visited += len(near)
        for x, n in zip(g.distance(near, q).tolist(), near.tolist()):
            if len(top) < ef or x < -top[0][0]:
                heapq.heappush(open_, (x, n))
                heapq.heappush(top, (-x, -n))
                if len(top) > ef:
                    heapq.heappop(top)
    return sorted((-d, -r) for d, r in top), visited, steps


def reuse(g: Graph, q: np.ndarray, anchor: np.ndarray, m: float, ef: int, k: int) -> tuple[list[tuple[float, int]], int]:
    """A query's search from the first int(m) rows of its cluster's anchor list; m < 1 finds nothing."""
    found, visited = search(g, q, ef, anchor[: max(0, int(m))])
    return found[:k], visited


PROBE = "cluster_id int, ef int, rank long, base_id long, d2 double"


def probe(centers: DataFrame, g: Graph, efforts: tuple[int, ...]) -> DataFrame:
    """(cluster_id, ef, rank, base_id, d2): the list that a search from the entry of each center finds with each effort."""
    graph_of = shared(centers, g)
    rows = centers.select(F.col("cluster_id").cast("int").alias("cluster_id"), F.col("center").cast("array<double>").alias("center"))

    def run(frames):  # noqa: ANN001, ANN202
        graph = graph_of()
        for frame in frames:
            out = []
            for row in frame.itertuples():
                center = np.array(row.center, float)
                entry = np.array([graph.entry(center)])
                for ef in efforts:
                    found, _ = search(graph, center, ef, entry)
                    out += [(row.cluster_id, ef, i + 1, int(graph.ids[r]), d) for i, (d, r) in enumerate(found)]
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in PROBE.split(", ")])

    return rows.mapInPandas(run, PROBE)


RESULT = "cluster_id int, efc int, ef_warm int, m double, qid long, rank long, base_id long, d2 double, visited long, steps long, seconds double"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


#: Queries of a cluster that one task searches for together.
QUERIES = 32


def search_clusters(members: DataFrame, centers: DataFrame, settings: DataFrame, g: Graph, k: int) -> DataFrame:
    """Results of every query under every setting (cluster_id, efc, ef_warm, m) of its cluster.

    One anchor search serves all settings that share efc of a block of a cluster's queries; a
    large cluster makes many blocks. steps are those of the anchor search, seconds the time of
    the query's own.
    """
    graph_of = shared(members, g)
    rows = members.where("cluster_id >= 0").select(F.col("cluster_id").cast("int").alias("cluster_id"), "qid", F.col("vec").cast("array<double>").alias("vec"))
    parts = rows.groupBy("cluster_id").agg(F.ceil(F.count("*") / F.lit(QUERIES)).alias("parts"))
    rows = rows.join(parts, "cluster_id").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")))
    queries = rows.groupBy("cluster_id", "part").agg(F.collect_list(F.struct("qid", "vec")).alias("queries"))
    grouped = settings.groupBy("cluster_id", "efc").agg(F.collect_set(F.struct("ef_warm", "m")).alias("cells"))
    work = grouped.join(queries, "cluster_id").join(centers, "cluster_id")
    # a given number, for few bytes make many searches
    work = work.repartition(tasks(work), "cluster_id", "efc", "part").select("cluster_id", "efc", "cells", "queries", "center")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, schema = graph_of(), _schema(RESULT)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}  # one block at a time
                center = np.array(row["center"], float)
                near, _, steps = walk(graph, center, row["efc"], np.array([graph.entry(center)]))
                anchor = np.array([r for _, r in near], np.int64)
                queries = [(x["qid"], np.array(x["vec"], float)) for x in sorted(row["queries"], key=lambda x: x["qid"])]
                for cell in sorted(row["cells"], key=lambda c: (c["ef_warm"], c["m"])):
                    out = []
                    for qid, q in queries:
                        began = time.perf_counter()
                        found, visited = reuse(graph, q, anchor, cell["m"], cell["ef_warm"], k)
                        took = time.perf_counter() - began
                        out += [(row["cluster_id"], row["efc"], cell["ef_warm"], cell["m"], qid, i + 1, int(graph.ids[r]), d, visited, steps, took) for i, (d, r) in enumerate(found)]
                    if out:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return work.mapInArrow(run, RESULT)
