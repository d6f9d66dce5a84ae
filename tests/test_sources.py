import numpy as np
import pytest

from lodestone.operators import gbdt
from lodestone.sources import binary, files


def test_matrices(spark, tmp_path):
    binary.register(spark)
    x = np.random.default_rng(1).standard_normal((500, 6)).astype("<f4")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "qid long, vec array<float>").repartition(4)
    path = f"{tmp_path}/base.fbin"
    binary.write_matrix(rows, path, "qid", "vec")
    assert binary.header(path) == (500, 6)
    got = spark.read.format("fbin").option("rows", 64).load(path).orderBy("id").collect()
    assert np.array_equal(np.array([r.vec for r in got], "<f4"), x) and [r.id for r in got] == list(range(500))
    ints = spark.createDataFrame([(0, [3, -1]), (1, [4, 5])], "qid long, vec array<int>")
    binary.write_matrix(ints, f"{tmp_path}/gt.ibin", "qid", "vec", "<i4")
    long = binary.long_form(spark.read.format("ibin").load(f"{tmp_path}/gt.ibin")).orderBy("qid", "rank").collect()
    assert [tuple(r) for r in long] == [(0, 1, 3), (0, 2, -1), (1, 1, 4), (1, 2, 5)]
    with open(path, "r+b") as f:
        f.truncate(100)
    with pytest.raises(Exception, match="ends before"):
        spark.read.format("fbin").load(path).collect()


def test_models_and_lists(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, (200, 2))
    model = gbdt.fit(x, x[:, 0] * 5, ["a", "b"], gbdt.Settings(trees=5, min_gain=1e-6))
    path = f"{tmp_path}/model.txt"
    files.write_model(model, path)
    back = files.read_model(spark, path, ["a", "b"])
    assert np.array_equal(back.predict(x), model.predict(x))
    assert files.model_table(spark, model).where("node < 0").count() == sum(len(t.value) for t in model.trees)
    files.write_meta(f"{tmp_path}/meta.json", {"A": ["x", "y"]}, alpha=0.85)
    assert files.read_meta(spark, f"{tmp_path}/meta.json", {"A": ["z"], "B": ["w"]}) == {"A": ["x", "y"], "B": ["w"]}
    assert files.read_meta(spark, f"{tmp_path}/none.json", {"A": ["z"]}) == {"A": ["z"]}


def test_recall_head():
    weights, knots = files.read_recall_head("# head\nintercept 0.5\nbase 2\nwS 1\nwC 1\nnum_knots_S 2\n0 0\n1 3\nnum_knots_C 1\n0 1\n")
    assert list(weights) == ["intercept", "base", "wS", "wC"] and knots == {"S": [(0.0, 0.0), (1.0, 3.0)], "C": [(0.0, 1.0)]}
    assert files.linear_head(weights, knots, 1.0, 0.5, 9.0) == pytest.approx(0.5 + 2 + 1.5 + 1)


def test_tables(spark, tmp_path):
    with open(f"{tmp_path}/clusters.cfg", "w") as f:
        f.write("10,5,2\n\n0 0 -1\n")
    assert files.read_cluster_settings(spark, f"{tmp_path}/clusters.cfg") == [(10, 5.0, 2.0), (1, 1e-6, 0.0)]
    df = spark.createDataFrame([(0.9, 1, 0.123456789)], "target double, n int, recall double")
    files.write_csv(df, f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").first().recall == "0.123457"
    for _ in range(2):
        files.append_csv(df, f"{tmp_path}/runs")
    assert files.read_runs(spark, f"{tmp_path}/runs", "target double, n int, recall double").count() == 2
    built = []
    make = lambda: built.append(1) or df
    for _ in range(2):
        assert files.load_or_build(spark, f"{tmp_path}/index", make).count() == 1
    assert len(built) == 1
    assert files.first_existing(str(tmp_path), ["no", "runs"]).endswith("runs") and files.first_existing(str(tmp_path), ["no", "none"]).endswith("/no")


def test_written_files(spark, tmp_path):
    model = gbdt.Ensemble(["a", "b"], [gbdt.Tree([0], [1.5], [-1], [-2], [10.0, 20.0], [1.0]), gbdt.Tree([1], [0.5], [-1], [-2], [1.0, 2.0], [3.0])])
    files.write_models({"A_efc": model}, f"file://{tmp_path}/models", alpha=0.85)
    back = files.read_model(spark, f"file://{tmp_path}/models/model_A_efc.txt", ["a", "b"], False)
    assert [t.value for t in back.trees] == [[10.0, 20.0], [1.0, 2.0]]
    assert (tmp_path / "models/fi_A_efc.csv").read_text() == "feature,gain\nb,3.000000\na,1.000000\n"
    assert files.read_meta(spark, f"file://{tmp_path}/models/meta.json", {"A_efc": ["x"], "B": ["y"]}) == {"A_efc": ["a", "b"], "B": ["y"]}
    files.write_clusters(spark.createDataFrame([(0, 7, 80, 5.0, 2.25)], "cluster int, center_idx long, qpc int, sigma_deg double, theta_min_deg double").coalesce(1), f"file://{tmp_path}/clusters")
    files.write_queries(spark.createDataFrame([(0.85, 3, 0.001, 0.9)], "target_recall double, qid long, search_time_s double, recall double").coalesce(1), f"file://{tmp_path}/queries")
    read = lambda name: "".join(p.read_text() for p in (tmp_path / name).glob("*.csv"))
    assert read("clusters") == "cluster,center_idx,qpc,sigma_deg,theta_min_deg\n0,7,80,5.000000,2.250000\n"
    assert read("queries") == "target_recall,qid,search_time_s,recall\n0.850000,3,0.001000,0.900000\n"


def test_training_runs(spark):
    from lodestone.plans import adaptive as plan
    from lodestone.plans.tables import Workload

    rows = plan.training_runs(Workload(spark, "/root/testdata/sf0.001").hold())
    assert rows.columns == plan.COLUMNS and len(plan.COLUMNS) == 29
    got = rows.collect()
    assert len({(r.cluster_id, r.efc, r.ef_warm, r.L_aligned) for r in got}) == len(got) and len(got) % 15 == 0
    assert all(0 <= r[c] <= 1 for r in got for c in ("recall_at_1", "recall_at_10", "recall_at_100", "overlap128_vs_256_k100")) and all(r.qps_run > 0 and r.centroid_steps > 0 for r in got)
