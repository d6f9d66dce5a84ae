"""Exact nearest neighbours: tiles of distances and bounded top-k.

Queries go to every task that scans the base while they fit in BROADCAST_BYTES, which is
checked; larger query sets and groups are dealt out as cells, a part of the queries against a
part of the base. A task holds the queries of one cell and the k best of each so far, while the
base rows pass by batch by batch; so its memory depends on neither table's size. What is shuffled
on is k rows a query and part of the base. Order is total: by squared distance, then id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 8 << 20
#: Of a cell's queries: bytes of their vectors, and of their lists so far.
CELL_BYTES = 16 << 20
#: Pairs of rows that one cell compares, once there are cells enough for all cores.
CELL_PAIRS = 1 << 31
#: Rows of a tile of distances: of the base, and of the queries.
BASE_ROWS = 2048
QUERY_ROWS = 512
#: Pairs whose exact distances are computed at a time, and rows sent on at a time.
EXACT = 1 << 15
SENT = 1 << 16

PAIRS = "qid long, base_id long, d2 double"


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A column of equally long lists as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, dim or 0))
    ends = pc.min_max(pc.list_value_length(column)).as_py()
    for n in ends.values():
        if n != (ends["min"] if dim is None else dim):
            raise ValueError(f"vectors of {n} and of {ends['min'] if dim is None else dim} components can't be compared")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def lossless(name: str = "vec") -> Column:
    """An aggregate: whether single precision holds all vectors."""
    return F.bool_and(F.col(name) == F.col(name).cast("array<float>").cast("array<double>"))


def tasks(df: DataFrame) -> int:
    """For steps whose work is larger than their bytes say, by which Spark would join their parts."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(1e-30, (x * x).sum(axis=1, keepdims=True)))


class Best:
    """The k nearest of each of some queries, in order of (distance, id), over base rows that come piece by piece."""

    def __init__(self, q: np.ndarray, k: int) -> None:
        self.q, self.k, self.norms = q, k, (q * q).sum(axis=1)
        self.held = np.zeros(len(q), np.int64)
        self.d2, self.ids = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)

    def add(self, v: np.ndarray, ids: np.ndarray) -> None:
        if not len(v) or not len(self.q):
            return
        if self.q.shape[1] != v.shape[1]:
            raise ValueError(f"vectors of {v.shape[1]} and of {self.q.shape[1]} components can't be compared")
        for at in range(0, len(v), BASE_ROWS):
            some = v[at : at + BASE_ROWS]
            v2 = np.column_stack([-2 * some, (some * some).sum(axis=1)])
            for start in range(0, len(self.q), QUERY_ROWS):
                self._tile(start, min(start + QUERY_ROWS, len(self.q)), some, v2, ids[at : at + BASE_ROWS])

    def _tile(self, start: int, stop: int, v: np.ndarray, v2: np.ndarray, ids: np.ndarray) -> None:
        q, mine = self.q[start:stop], self.norms[start:stop]
        # squared distances less the query's norm, by one product
        rough = np.column_stack([q, np.ones(len(q))]) @ v2.T
        # bound of what rounding makes of rough, and of the exact distance
        slack = 8e-16 * (q.shape[1] + 9) * (mine + np.fmax.reduce(v2[:, -1]))
        most = np.where(self.held[start:stop] < self.k, np.inf, self.d2[start:stop, -1]) - mine + slack
        near = rough > most[:, None]
        np.logical_not(near, out=near)  # what is no number stays, and comes last
        if rough.shape[1] > self.k and np.count_nonzero(near) > 2 * self.k * len(q):
            near &= ~(rough > (np.partition(rough, self.k - 1, axis=1)[:, self.k - 1] + 2 * slack)[:, None])
        row, col = np.divmod(np.flatnonzero(near), near.shape[1])
        del rough, near
        for at in range(0, len(row), EXACT):
            self._merge(start, row[at : at + EXACT], v, col[at : at + EXACT], ids)

    def _merge(self, start: int, row: np.ndarray, v: np.ndarray, col: np.ndarray, ids: np.ndarray) -> None:
        gap = self.q[start + row] - v[col]
        d2, row, ids = np.square(gap, out=gap).sum(axis=1), start + row, ids[col]
        last, full = self.d2[row, -1], self.held[row] == self.k
        better = ~full | ~((d2 > last) | ((d2 == last) & (ids > self.ids[row, -1])))
        row, d2, ids = row[better], d2[better], ids[better]
        if not len(row):
            return
        rows = np.unique(row)
        was = np.arange(self.k) < self.held[rows][:, None]
        row, d2, ids = np.concatenate([np.repeat(rows, self.held[rows]), row]), np.concatenate([self.d2[rows][was], d2]), np.concatenate([self.ids[rows][was], ids])
        order = np.lexsort((ids, d2, row))
        row, d2, ids = row[order], d2[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        row, place = row[keep], place[keep]
        self.d2[row, place], self.ids[row, place] = d2[keep], ids[keep]
        self.held[rows] = np.searchsorted(row, rows, "right") - np.searchsorted(row, rows)

    def found(self, qid: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, SENT // self.k)
        for at in range(0, len(qid), step):
            was = np.arange(self.k) < self.held[at : at + step, None]
            if was.any():
                yield pa.record_batch([pa.array(np.repeat(qid[at : at + step], self.held[at : at + step])), pa.array(self.ids[at : at + step][was]), pa.array(self.d2[at : at + step][was])], names=["qid", "base_id", "d2"])


def top(pairs: DataFrame, k: int, key: str = "qid") -> DataFrame:
    """The k nearest of each key, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("d2", "base_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def _in_cells(rows: DataFrame, k: int, normalize_base: bool = False) -> DataFrame:
    """(qid, base_id, d2): the k best of each query and cell. rows (group, a, b, side, id, vec) come cell by cell, its queries (side 0) before its base."""
    prepare = unit_rows if normalize_base else lambda x: x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, qids, parts, best = None, [], [], None
        small: list[pa.RecordBatch] = []
        for batch in batches:
            key = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "a", "b", "side")]
            cuts = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in key])) + 1
            for at, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if end == at:
                    continue
                now, some = tuple(x[at] for x in key), batch.slice(at, end - at)
                if now[:3] != cell:
                    if best is not None:
                        small += best.found(np.concatenate(qids))
                    cell, qids, parts, best = now[:3], [], [], None
                ids, x = some.column("id").to_numpy(), matrix(some.column("vec"))
                if now[3] == 0:
                    if parts and parts[0].shape[1] != x.shape[1]:
                        raise ValueError("the queries differ in length")
                    qids.append(ids)
                    parts.append(x)
                elif qids:
                    if best is None:
                        best, parts = Best(np.concatenate(parts), k), []
                    best.add(prepare(x), ids)
                if sum(b.num_rows for b in small) >= SENT:
                    yield from small
                    small = []
        if best is not None:
            small += best.found(np.concatenate(qids))
        yield from small

    return rows.sortWithinPartitions("group", "a", "b", "side").select("group", "a", "b", "side", "id", "vec").mapInArrow(run, PAIRS)


def _dealt(queries: DataFrame, base: DataFrame, over: Column | int, across: Column | int) -> DataFrame:
    """The rows of all cells: queries (group, id, vec) in `over` parts by a hash, each for every one of the `across` parts of the base."""
    over, across = (F.lit(x) if isinstance(x, int) else x for x in (over, across))
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    left = queries.select("group", part(over).alias("a"), every(across).alias("b"), F.lit(0).alias("side"), "id", "vec")
    return left.unionByName(base.select("group", every(over).alias("a"), part(across).alias("b"), F.lit(1).alias("side"), "id", "vec"))


def exact_knn(queries: DataFrame, base: DataFrame, k: int, normalize_base: bool = False, first_rows: int = 0) -> DataFrame:
    """(qid, rank, base_id, d2) for queries (qid, vec) and base (base_id, vec).

    first_rows: only base ids below it take part (0: all), a filter that the scan gets.
    """
    queries = queries.select(F.col("qid").cast("long").alias("qid"), F.col("vec").cast("array<double>").alias("vec")).where("vec is not null")
    base = base.select(F.col("base_id").cast("long").alias("base_id"), F.col("vec").cast("array<double>").alias("vec")).where("vec is not null")
    if first_rows:
        base = base.where(F.col("base_id") < first_rows)
    n, dim, least, single = queries.agg(F.count("*"), F.max(F.size("vec")), F.min(F.size("vec")), lossless()).first()
    if not n or k < 1:
        return queries.sparkSession.createDataFrame([], "qid long, rank long, base_id long, d2 double")
    if dim != least:
        raise ValueError("the queries differ in length")
    if n * max(dim * 8, k * 8) <= BROADCAST_BYTES:
        prepare = unit_rows if normalize_base else lambda x: x
        table = queries.toArrow()
        held = queries.sparkSession.sparkContext.broadcast((table.column("qid").to_numpy(), matrix(table.column("vec"))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q = held.value
            best = Best(q, k)
            for batch in batches:
                best.add(prepare(matrix(batch.column("vec"), dim)), batch.column("base_id").to_numpy())
            yield from best.found(qid)

        return top(base.mapInArrow(scan, PAIRS), k).select("qid", "rank", "base_id", "d2")
    rows, base_single = base.agg(F.count("*"), lossless()).first()
    kind = "array<float>" if single and base_single else "array<double>"
    least = -(-n // max(1, CELL_BYTES // max(dim * 8, k * 16)))
    cells = max(2 * queries.sparkSession.sparkContext.defaultParallelism, n * rows // CELL_PAIRS)
    # each query is sent `across` times and each base row `over` times
    over = max(least, min(round((cells * rows / n) ** 0.5), -(-n // QUERY_ROWS)))
    across = max(1, min(-(-cells // over), -(-rows // BASE_ROWS)))
    named = lambda df, name: df.select(F.lit(0).alias("group"), F.col(name).alias("id"), F.col("vec").cast(kind).alias("vec"))
    dealt = _dealt(named(queries, "qid"), named(base, "base_id"), over, across)
    return top(_in_cells(dealt.repartitionById(over * across, F.col("a") * across + F.col("b")), k, normalize_base), k).select("qid", "rank", "base_id", "d2")


def _sized(rows: DataFrame, size: int, each: int, name: str) -> DataFrame:
    """(group, name): the number of parts of a group, of at most `size` rows on average and CELL_BYTES; `each` bytes of a row come beside its vector."""
    fit = F.lit(CELL_BYTES) / F.greatest(8 * F.max(F.size("vec")), F.lit(each), F.lit(1))
    return rows.groupBy("group").agg(F.ceil(F.count("*") / F.greatest(F.lit(1), F.least(F.lit(size), F.floor(fit)))).cast("int").alias(name))


def grouped_knn(queries: DataFrame, base: DataFrame, k: int, size: int = 16384) -> DataFrame:
    """(qid, rank, base_id, d2): each query's k nearest of its own group. queries: (group, qid, vec), base: (group, base_id, vec).

    Parts of a group meet in cells, and each cell keeps the k best of each query; so a group of
    any size is spread over tasks.
    """
    named = lambda df, name: df.select("group", F.col(name).cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).where("vec is not null")
    left, right = named(queries, "qid"), named(base, "base_id")
    parts = _sized(left, size, 16 * k, "over").join(_sized(right, size, 0, "across"), "group")
    dealt = _dealt(*(rows.join(parts, "group").select("group", "id", "vec", "over", "across") for rows in (left, right)), F.col("over"), F.col("across"))
    return top(_in_cells(dealt.repartition(tasks(queries), "group", "a", "b"), k), k).select("qid", "rank", "base_id", "d2")


def nearest_query(queries: DataFrame) -> DataFrame:
    """(qid, other, cosine): the other query with the highest cosine, the least id on a tie. For unit vectors."""
    found = exact_knn(queries, queries.select(F.col("qid").alias("base_id"), "vec"), 2).where("qid <> base_id")
    # the query itself is the nearest, unless others equal it and have lesser ids
    first = found.groupBy("qid").agg(F.min(F.struct("d2", "base_id")).alias("x"))
    return first.select("qid", F.col("x.base_id").alias("other"), (F.lit(1.0) - F.col("x.d2") / 2).alias("cosine"))


def trim(truth: DataFrame, k: int) -> DataFrame:
    return truth.where(F.col("rank") <= k)


def knn_graph(base: DataFrame, degree: int) -> DataFrame:
    """(src, dst): each row's nearest others, and the same edges backwards."""
    found = exact_knn(base.select(F.col("base_id").alias("qid"), "vec"), base, degree + 1).where("qid <> base_id")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    kept = found.withColumn("place", rank).where(F.col("place") <= degree).select(F.col("qid").alias("src"), F.col("base_id").alias("dst"))
    return kept.unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
