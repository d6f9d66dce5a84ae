import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars, vector
from lodestone.operators import adaptive, clustering, features, gbdt, graph_search, grid, knn, prep, quantiles, recall, reuse, similarity, synth


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def ids(*values):
    return F.array(*(F.lit(v) for v in values)) if values else F.expr("cast(array() as array<int>)")


def test_list_similarity(spark):
    a, b = ids(1, 2, 3, 9), ids(2, 3, 4)
    assert one(spark, similarity.overlap(a, b, 3)) == pytest.approx(2 / 3)
    assert one(spark, similarity.jaccard(a, b, 3)) == 0.5
    assert one(spark, similarity.truth_jaccard(ids(-1, -1), ids(-1, -1), 2)) == 1.0
    assert one(spark, similarity.overlap(ids(), ids(1), 3)) == 0 and one(spark, similarity.jaccard(ids(), ids(1), 3)) == 0


def test_percentiles(spark, monkeypatch):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "x double")
    assert quantiles.exact_percentiles(df, "x", [0.5, 0.9]) == [2.5, pytest.approx(3.7)]
    assert quantiles.exact_percentiles(df.where("x > 9"), "x", [0.5]) == [None]
    monkeypatch.setattr(quantiles, "FEW", 20)
    monkeypatch.setattr(quantiles, "BINS", 16)
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(0, 3, 500), np.full(300, 2.0), [1e12, -1e12]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    shares = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    assert quantiles.exact_percentiles(df, "x", shares) == pytest.approx(list(np.quantile(values, shares)))


def square(spark):
    base = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (3, [0.0, -1.0])], "base_id long, vec array<double>")
    return spark.createDataFrame([(7, [1.0, 0.0])], "qid long, vec array<double>"), base


def test_exact_knn_ties_go_to_the_lesser_id(spark, monkeypatch):
    queries, base = square(spark)
    want = [(0, 0.0), (1, 2.0), (3, 2.0)]
    got = knn.exact_knn(queries, base.repartition(3), 3).orderBy("rank").collect()
    assert [(r.base_id, r.d2) for r in got] == want
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 0)  # the way for large query sets
    got = knn.exact_knn(queries, base.repartition(3), 3).orderBy("rank").collect()
    assert [(r.base_id, r.d2) for r in got] == want
    assert knn.exact_knn(queries, base, 3, first_rows=1).count() == 1
    assert knn.exact_knn(queries.limit(0), base, 3).count() == 0
    with pytest.raises(Exception, match="components"):
        knn.exact_knn(spark.createDataFrame([(1, [1.0])], "qid long, vec array<double>"), base, 1).collect()


def test_recall(spark):
    queries = spark.createDataFrame([(1,), (2,)], "qid long")
    truth = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (1, 3, -1)], "qid long, rank long, base_id long")
    results = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (1, 3, 5)], "qid long, rank long, base_id long")
    counted = recall.hits(queries, truth, results, 3)
    assert {r.qid: round(r.recall, 6) for r in recall.per_query(counted).collect()} == {1: 0.666667, 2: 0.0}
    assert recall.overall(counted).first().recall == pytest.approx(2 / 6)


def test_local_shape(spark):
    probes = spark.createDataFrame([(0, i + 1, i, float((i + 1) ** 2)) for i in range(4)], "cluster_id int, rank long, base_id long, d2 double")
    r = features.local_shape(probes, k=2).first()
    assert (r.lid, r.rc, r.expansion) == (pytest.approx(2.885390, abs=1e-5), pytest.approx(1.25), pytest.approx(2.0))
    r = features.local_shape(probes, k=3).first()
    assert r.expansion is None and r.expansion_serve == pytest.approx(4 / 3)


def test_cluster_shape_variants(spark):
    radius = spark.createDataFrame([(0, float(v)) for v in (1, 2, 3, 4)], "cluster_id int, radius double")
    r = features.shape(radius).first()
    assert (r.p50, r.p50_upper, r.p90, r.p90_floor) == (2.5, 3.0, pytest.approx(3.7), 3.0)


def test_grids():
    assert scalars.target_grid("0.85:0.05:0.95") == pytest.approx([0.85, 0.90, 0.95])
    assert scalars.target_grid("0.95:0.05:0.85") == pytest.approx([0.85, 0.90, 0.95])
    assert scalars.target_grid("0.7") == [0.7] and scalars.target_grid("x") == [0.9] and scalars.target_grid("0.8:0:0.9") == [0.8]
    assert scalars.name_list("a, b a\tc") == ["a", "b", "c"] and scalars.parse_numbers("1|2,,3", int) == [1, 2, 3]


def test_param_grid(spark):
    assert grid.param_grid(spark, [64, 128, 256], [64, 128, 256], [0.5, 1.0, 1.5]).count() == 15


def test_scalars(spark):
    knots = [(0.0, 0.0), (1.0, 2.0), (3.0, 3.0)]
    for x in (-1.0, 0.0, 0.5, 1.0, 2.0, 9.0):
        assert one(spark, scalars.piecewise_linear(F.lit(x), knots)) == pytest.approx(scalars.piecewise_value(x, knots))
    assert one(spark, scalars.logit_clip(F.lit(0.0))) == pytest.approx(math.log(1e-5 / (1 - 1e-5)))
    assert one(spark, scalars.number_list(F.lit(" 1, 2|x,,3"))) == [1.0, 2.0, None, 3.0]
    assert one(spark, scalars.trimmed(F.lit("\t a b\r\n"))) == "a b"
    assert scalars.solve_least(0.0, 1.0, [], 0.5) == pytest.approx(0.5, abs=1e-6)
    assert scalars.solve_least(0.0, 0.0, [], 0.5) == 1.0 and scalars.solve_least(0.0, 0.1, [], 0.5) == 1.0


def test_push_out(spark):
    c, q = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(math.cos(0.1)), F.lit(math.sin(0.1)))
    assert one(spark, vector.push_out(c, F.lit(0.5), q)) == pytest.approx([math.cos(0.5), math.sin(0.5)])
    assert one(spark, vector.push_out(c, F.lit(0.05), q)) == pytest.approx([math.cos(0.1), math.sin(0.1)])
    assert one(spark, vector.push_out(c, F.lit(0.5), c)) == [1.0, 0.0]


def test_tree_routing(spark):
    tree = gbdt.Tree([0], [1.5], [-1], [-2], [10.0, 20.0], [1.0])
    assert tree.predict(np.array([[1.5], [1.6], [np.nan]])).tolist() == [10, 20, 20]
    df = spark.createDataFrame([(1.5,), (1.6,), (float("nan"),)], "x double")
    assert [r.z for r in df.select(tree.expression([F.col("x")]).alias("z")).collect()] == [10, 20, 20]
    assert gbdt.Tree(value=[0.5]).predict(np.zeros((2, 1))).tolist() == [0.5, 0.5]


def test_predicted_share_and_seeds(spark):
    assert one(spark, adaptive.predicted_share(F.lit(130.0), F.lit(64.0), F.lit(128.0))) == pytest.approx(2.0)
    g = graph_search.Graph(np.arange(3), np.eye(3), np.array([0, 1, 2, 3]), np.array([1, 2, 0]), np.array([0]))
    assert graph_search.reuse(g, np.ones(3), np.array([0, 1]), 0.9, 4, 2) == ([], 0)
    assert one(spark, adaptive.decode_ef(F.lit(math.log1p(2.5)))) == 3 and one(spark, adaptive.decode_m(F.lit(float("nan")))) == 0


def held_out(spark, n=400, d=24):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    base = spark.createDataFrame([r[:2] for r in rows if r[0] % 5], "base_id long, vec array<double>")
    return spark.createDataFrame([(i, c, v) for i, v, c in rows if i % 5 == 0], "qid long, cluster_id int, vec array<double>"), base


def test_graph_search_recall_rises_with_effort(spark):
    members, base = held_out(spark)
    graph = graph_search.collect_graph(base, knn.knn_graph(base, 10).cache())
    centers = features.centroids(members)
    truth = knn.exact_knn(members, base, 10).cache()
    values = []
    for efc, efw, m in ((32, 10, 2.0), (64, 32, 16.0), (400, 400, 400.0)):
        settings = centers.select("cluster_id", F.lit(efc).alias("efc"), F.lit(efw).alias("ef_warm"), F.lit(m).alias("m"))
        found = graph_search.search_clusters(members, centers, settings, graph, 10)
        values.append(recall.overall(recall.hits(members, truth, found, 10)).first().recall)
    assert values[0] < values[1] <= values[2] == 1.0 and values[0] < 0.95
    with pytest.raises(ValueError, match="too large"):
        graph_search.collect_graph(base, knn.knn_graph(base, 2), most=10)
    probes = features.probe(centers, base, 64)
    edges = knn.knn_graph(base, 10)
    some = [recall.overall(recall.hits(members, truth, reuse.anchor_reuse_knn(members, base, probes, edges, 10, m), 10)).first().recall for m in (0, 4, 64)]
    assert some[0] == 0 and some[0] < some[1] < some[2] <= 1


def test_boosting_learns_and_obeys_signs():
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (800, 3))
    y = 3 * x[:, 0] - 2 * x[:, 1] + rng.normal(0, 0.2, 800) + 3
    s = gbdt.Settings(loss="huber", trees=60, log_target=False, min_gain=1e-6)
    model = gbdt.fit(x, y, ["a", "b", "c"], s, [1, -1, 0])
    assert np.abs(model.predict(x) - y).mean() < 0.35 and model.importance()[0][0] == "a"
    sweep = np.full((50, 3), 0.5)
    sweep[:, 0] = np.linspace(0, 1, 50)
    assert (np.diff(model.predict(sweep)) >= -1e-9).all()
    sweep[:, 0], sweep[:, 1] = 0.5, np.linspace(0, 1, 50)
    assert (np.diff(model.predict(sweep)) <= 1e-9).all()
    high = gbdt.fit(x, y, ["a", "b", "c"], gbdt.Settings(loss="quantile", alpha=0.85, trees=60))
    assert 0.75 < (y <= high.predict(x)).mean() < 0.95
    again = gbdt.fit(x, y, ["a", "b", "c"], s, [1, -1, 0])
    assert np.array_equal(again.predict(x), model.predict(x))


def test_preparation(spark):
    df = spark.createDataFrame([(1, "1.5"), (2, "x"), (3, "2.5"), (4, None)], "i int, v string")
    out = prep.median_impute(prep.coerce_numeric(df, "v"), "v")
    assert [r.v for r in out.orderBy("i").collect()] == [1.5, 2.0, 2.5, 2.0]
    lost = spark.createDataFrame([(float("inf"),), (None,)], "v double")
    assert {r.v for r in prep.median_impute(lost, "v").collect()} == {0.0}
    wide = spark.createDataFrame([(float(v),) for v in range(101)], "v double")
    assert prep.winsorize(wide, "v").agg(F.min("v"), F.max("v")).first()[:] == (1.0, 99.0)
    with pytest.raises(ValueError, match="missing"):
        prep.require(df, "w")
    assert prep.select_features(["a", "b", "c"], ["c", "a"], ["a"]) == ["c"]
    signs = dict(zip(adaptive.HEAD_M, prep.monotone_signs(adaptive.HEAD_M, adaptive.RISING, adaptive.FALLING)))
    assert {f for f, s in signs.items() if s < 0} == {"cluster_density", "efc", "log_efc"}
    assert {f for f, s in signs.items() if s > 0} == {"cluster_radius_p50", "cluster_radius_p90", "radius_skew", "overlap128_vs_256", "jaccard128_vs_256", "recall_at_k", *adaptive.ANCHOR}
    assert prep.monotone_signs(adaptive.HEAD_A, adaptive.RISING, adaptive.FALLING)[-4:] == [1, 1, 1, 1]


@pytest.mark.parametrize("model", synth.MODELS)
def test_noise_models(model):
    rng = np.random.default_rng(3)
    center = synth.unit(rng.standard_normal(24))
    s = synth.Settings(model=model, ring_deg=20.0, ring_width_deg=2.0, mix_weights=(1.0, 1.0), mix_sigma=(0.5, 2.0), mix_anisotropy=(1.0, 4.0), rank=3, shared_share=0.3, heavy_share=0.1, jitter=0.1, anisotropy=2.0)
    x = synth.draw(center, 300, 8.0, 3.0, s, rng)
    angle = np.degrees(np.arccos(np.clip(x @ center, -1, 1)))
    assert np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-9) and angle.min() >= 3 - 1e-6 and 2 < np.median(angle) < 30


def test_generator(spark):
    members, _ = held_out(spark)
    s = synth.Settings(clusters=4, per_cluster=20, sigma_deg=5.0, outlier_share=0.1, shuffle=True)
    rows, clusters = synth.generate(spark, members, s)
    got = rows.collect()
    assert sorted(r.qid for r in got) == list(range(88)) and sum(r.cluster_id == -1 for r in got) == 8
    assert clusters.count() == 4
    again, _ = synth.generate(spark, members.repartition(3), s)
    assert sorted((r.qid, r.cluster_id, tuple(r.vec)) for r in got) == sorted((r.qid, r.cluster_id, tuple(r.vec)) for r in again.collect())
    given = synth.parameters(synth.Settings(clusters=3), [(5, 1.0, 2.0)])
    assert given == [(0, 5, 1.0, 2.0), (1, 100, 2.0, 0.0), (2, 100, 2.0, 0.0)]


def test_kmeans(spark):
    rows = spark.createDataFrame([(i, [float(i % 2) * 10 + i / 100, 0.0]) for i in range(40)], "qid long, vec array<double>")
    found, centers = clustering.kmeans(rows, 2, seed=3)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.cluster_id, set()).add(r.qid % 2)
    assert all(len(v) == 1 for v in groups.values()) or centers.count() == 2


def test_efforts_are_compared_over_the_whole_base(spark):
    from lodestone.plans import adaptive as plan
    from lodestone.plans.tables import K, LARGE, SMALL, Workload

    w = Workload(spark, "/root/testdata/sf0.001").hold()
    g = graph_search.collect_graph(w.base, w.graph)
    got = {r.cluster_id: r.overlap128_vs_256 for r in plan.cluster_features(w).select("cluster_id", "overlap128_vs_256").collect()}
    want = {}
    for row in w.centers.collect():
        center = np.array(row.center, float)
        few, many = ({r for _, r in graph_search.search(g, center, ef, np.array([g.entry(center)]))[0][:K]} for ef in (SMALL, LARGE))
        want[row.cluster_id] = len(few & many) / K
    assert got and {c: want[c] for c in got} == pytest.approx(got)


def test_order_of_features():
    """Positional models are read with these lists."""
    assert adaptive.HEAD_A[:4] == ["cluster_size", "cluster_size_log", "log1p_cluster_size", "cluster_density"]
    assert adaptive.HEAD_A[10:] == ["overlap128_vs_256", "jaccard128_vs_256", "lid_probe256_k10", "rc_probe256_k10", "expansion2k_over_k_probe256_k10", "recall_at_k"]
    assert adaptive.HEAD_B[12:] == ["lid_k_efc", "rc_k_efc", "expand2k_over_k_efc", "efc", "log_efc", "recall_at_k"]
    assert adaptive.HEAD_M[15:] == ["efc", "ef_warm", "log_efc", "log_efw", "efw_over_efc", "recall_at_k"]


def test_percentiles_with_infinities_and_wide_ranges(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 50)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal(3000), [np.inf] * 40, [-np.inf] * 7, [1e308, -1e308], np.full(500, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(3)
    shares = [0.0, 0.001, 0.01, 0.5, 0.9, 0.99, 1.0]
    got = quantiles.exact_percentiles(df, "v", shares)
    ordered = np.sort(x)
    for p, v in zip(shares, got):
        a, b = ordered[math.floor(p * (len(x) - 1))], ordered[math.ceil(p * (len(x) - 1))]
        assert v == a == b or v == pytest.approx(a + (b - a) * (p * (len(x) - 1) % 1))


def test_percentiles_of_groups(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BINS", 4)
    rng = np.random.default_rng(4)
    groups = {1: rng.standard_normal(700), 2: np.array([5.0]), 3: np.repeat([1.0, 2.0], [300, 2]), 4: rng.lognormal(0, 4, 500)}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g int, x double").repartition(3)
    got = {r.g: r for r in quantiles.group_percentiles(df, {"a": 0.5, "b": 0.9}).collect()}
    for g, x in groups.items():
        assert (got[g].n, got[g].a, got[g].b) == (len(x), pytest.approx(np.percentile(x, 50)), pytest.approx(np.percentile(x, 90)))
    ranks = spark.createDataFrame([(4, r) for r in range(0, 500, 7)], "g int, rank long")
    found = {r["rank"]: r.x for r in quantiles.values_at(df, ranks).collect()}
    assert found == {r: np.sort(groups[4])[r] for r in range(0, 500, 7)}


def test_neighbours_within_groups(spark):
    rng = np.random.default_rng(6)
    x, group = rng.standard_normal((300, 5)), np.arange(300) % 4 // 2
    rows = spark.createDataFrame([(int(g), i, v.tolist()) for i, (g, v) in enumerate(zip(group, x))], "group int, qid long, vec array<double>").repartition(3)
    got = {(r.qid, r["rank"]): r.base_id for r in knn.grouped_knn(rows, rows.withColumnRenamed("qid", "base_id"), 3, size=37).collect()}
    for i in range(300):
        d = np.where(group == group[i], ((x - x[i]) ** 2).sum(axis=1), np.inf)
        assert [got[i, k] for k in (1, 2, 3)] == np.argsort(d, kind="stable")[:3].tolist()


def test_a_higher_target_costs_more(spark):
    from lodestone.plans import adaptive as plan
    from lodestone.plans.tables import Workload

    got = plan.search(Workload(spark, "/root/testdata/sf0.1").hold(), [0.8, 0.9, 0.95]).orderBy("target_recall").collect()
    visited = [r.visited_mean for r in got]
    assert visited[0] * 1.15 < visited[1] < visited[2] and all(r.recall >= r.target_recall - 0.02 and r.qps > 0 for r in got)


def test_the_cheapest_cell_of_each_level(spark):
    from lodestone.plans import adaptive as plan

    rows = [(1, 16, 10, 5.0, 0.7, 100.0), (1, 64, 16, 8.0, 0.9, 200.0), (1, 64, 24, 9.0, 0.9, 180.0), (2, 16, 10, 5.0, 0.95, 90.0)]
    table = spark.createDataFrame(rows, "cluster_id int, efc int, ef_warm int, m double, recall_at_k double, visited_mean double")
    got = {(r.cluster_id, r.recall_at_k): (r.efc, r.ef_warm, r.m) for r in plan.cheapest(table, [0.7, 0.8, 0.95]).collect()}
    assert got == {(1, 0.7): (16, 10, 5.0), (1, 0.8): (64, 24, 9.0), (2, 0.7): (16, 10, 5.0), (2, 0.8): (16, 10, 5.0), (2, 0.95): (16, 10, 5.0)}


def test_search_over_the_whole_list_is_exact(spark):
    """With full effort the graph search gives the neighbours that comparing with all rows gives."""
    members, base = held_out(spark, 200)
    graph = graph_search.collect_graph(base, knn.knn_graph(base, 12))
    centers = features.centroids(members)
    settings = centers.select("cluster_id", F.lit(160).alias("efc"), F.lit(160).alias("ef_warm"), F.lit(160.0).alias("m"))
    key = lambda rows: sorted((r.qid, r["rank"], r.base_id, round(r.d2, 9)) for r in rows.collect())
    assert key(graph_search.search_clusters(members, centers, settings, graph, 10)) == key(knn.exact_knn(members, base, 10))
