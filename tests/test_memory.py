"""What a task of the searches holds doesn't grow with the tables, and parts give what the whole gives."""

import tracemalloc

import numpy as np
import pytest

from lodestone.operators import knn


def peak_of(q, v, k):
    tracemalloc.start()
    best = knn.Best(q, k)
    for at in range(0, len(v), 5000):
        best.add(v[at : at + 5000], np.arange(at, min(at + 5000, len(v))))
    out = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out


def test_memory_of_a_task_does_not_grow_with_the_base():
    rng = np.random.default_rng(8)
    q, v = rng.standard_normal((4096, 16)), rng.standard_normal((40000, 16))
    small, large = peak_of(q, v[:10000], 10), peak_of(q, v, 10)
    assert large < 1.1 * small and large < 64 << 20
    v[:] = q[:] = 1.0  # all equal: every row is a candidate of every query
    assert peak_of(q[:600], v[:10000], 10) < 128 << 20


@pytest.mark.parametrize("k", [1, 7, 40])
def test_cells_give_what_brute_force_gives(spark, monkeypatch, k):
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(knn, "CELL_BYTES", 2000)
    monkeypatch.setattr(knn, "BASE_ROWS", 16)
    rng = np.random.default_rng(9)
    x = np.round(rng.standard_normal((240, 4)) * 1e6, -6)  # many copies and equal distances
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "qid long, vec array<double>").repartition(3)
    got = {(r.qid, r["rank"]): (r.base_id, r.d2) for r in knn.exact_knn(rows, rows.withColumnRenamed("qid", "base_id"), k).collect()}
    assert len(got) == 240 * k
    for i in range(240):
        d = ((x - x[i]) ** 2).sum(axis=1)
        want = np.lexsort((np.arange(240), d))[:k]
        assert [got[i, j + 1] for j in range(k)] == [(w, d[w]) for w in want]


def test_parts_of_a_group_follow_the_width_of_its_rows(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL_BYTES", 800)
    rows = spark.createDataFrame([(g, i, [float(i)] * 10) for g in (1, 2) for i in range(30 * g)], "group int, id long, vec array<double>")
    assert {r.group: r.n for r in knn._sized(rows, 1000, 0, "n").collect()} == {1: 3, 2: 6}


def test_searches_read_the_graph_from_a_file(spark, monkeypatch):
    """The driver neither collects nor broadcasts the graph; the file holds what the tables say, in the order of ids."""
    from pyspark.sql import functions as F

    from lodestone.operators import features, graph_search

    rng = np.random.default_rng(10)
    x = rng.standard_normal((300, 6))
    base = spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(x)], "base_id long, vec array<double>").repartition(5)
    edges = knn.knn_graph(base, 4).localCheckpoint()
    monkeypatch.setattr(graph_search, "PART_BYTES", 2000)
    monkeypatch.setattr(graph_search, "PIVOTS", 3)

    def refused(*_):
        raise AssertionError("whole on the driver")

    members = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x[:20])], "qid long, cluster_id int, vec array<double>")
    centers = features.centroids(members).localCheckpoint()
    pairs = [tuple(r) for r in edges.collect()]
    with monkeypatch.context() as m:
        for name in ("toPandas", "toArrow"):
            m.setattr(type(base), name, refused)
        m.setattr(type(spark.sparkContext), "broadcast", refused)
        g = graph_search.collect_graph(base, edges)
        settings = centers.select("cluster_id", F.lit(300).alias("efc"), F.lit(300).alias("ef_warm"), F.lit(300.0).alias("m"))
        found = graph_search.search_clusters(members, centers, settings, g, 1).collect()
    assert g.ids.tolist() == list(range(0, 900, 3)) and np.array_equal(g.vectors, x)
    links = {(int(g.ids[i]), int(g.ids[j])) for i in range(300) for j in g.to[g.start[i] : g.start[i + 1]]}
    assert links == set(pairs) and len(g.to) == len(pairs)
    assert {r.qid: r.base_id for r in found} == {i: 3 * i for i in range(20)}
    q = rng.standard_normal(6)
    assert g.entry(q) == min(g.pivots, key=lambda i: ((x[i] - q) ** 2).sum())
    single = graph_search.collect_graph(base.withColumn("vec", F.col("vec").cast("array<float>")), edges)
    assert single.vectors.dtype == np.float32 and np.array_equal(single.vectors, x.astype(np.float32))
