"""Text files around the search: model files, feature lists, cluster settings, result tables."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import piecewise_value
from ..operators.gbdt import Ensemble, Tree

# The lines of a model file that are read.
TREE_LINES = ("num_leaves", "split_feature", "threshold", "left_child", "right_child", "leaf_value")


def first_existing(folder: str, names: list[str]) -> str:
    """The first of the names that exists in the folder, or the first name."""
    paths = [os.path.join(folder, n) for n in names]
    return next((p for p in paths if os.path.exists(p)), paths[0])


def read_model(spark: SparkSession, path: str, features: list[str], log_target: bool = True) -> Ensemble:
    """An ensemble from a text file of trees; other lines are passed over."""
    rows = spark.read.text(path, wholetext=True).collect()
    trees: list[Tree] = []
    for line in "".join(r.value for r in rows).splitlines():
        key, _, value = line.partition("=")
        if key == "Tree":
            trees.append(Tree())
        elif trees and key in TREE_LINES:
            t, parts = trees[-1], value.split()
            if key == "split_feature":
                t.feature = [int(p) for p in parts]
                t.gain = [0.0] * len(parts)
            elif key == "threshold":
                t.threshold = [float(p) for p in parts]
            elif key == "left_child":
                t.left = [int(p) for p in parts]
            elif key == "right_child":
                t.right = [int(p) for p in parts]
            elif key == "leaf_value":
                t.value = [float(p) for p in parts]
    return Ensemble(features, trees, log_target)


def model_text(model: Ensemble) -> str:
    join = lambda values: " ".join(repr(v.item() if hasattr(v, "item") else v) for v in values)
    out = []
    for i, t in enumerate(model.trees):
        lists = (t.feature, t.threshold, t.left, t.right, t.value)
        lines = [f"Tree={i}", f"num_leaves={len(t.value)}", *(f"{n}={join(v)}" for n, v in zip(TREE_LINES[1:], lists))]
        out.append("\n".join(lines))
    return "\n\n".join(out) + "\n"


def put_text(path: str, text: str) -> None:
    """Write one file into any store that Spark writes to; paths without a scheme are its default's."""
    spark = SparkSession.active()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_model(model: Ensemble, path: str) -> None:
    put_text(path, model_text(model))


def write_importance(model: Ensemble, path: str) -> None:
    """feature,gain lines, highest gain first."""
    put_text(path, "feature,gain\n" + "".join(f"{name},{gain:.6f}\n" for name, gain in model.importance()))


def write_models(models: dict[str, Ensemble], folder: str, **more) -> None:  # noqa: ANN003
    """Of each model its trees and importances, and of all the feature lists (meta.json)."""
    for name, model in models.items():
        write_model(model, f"{folder}/model_{name}.txt")
        write_importance(model, f"{folder}/fi_{name}.csv")
    write_meta(f"{folder}/meta.json", {name: m.features for name, m in models.items()}, **more)


def model_table(spark: SparkSession, model: Ensemble) -> DataFrame:
    """One row a node or leaf (number below 0)."""
    rows = []
    for i, t in enumerate(model.trees):
        rows += [(i, n, model.features[f], th, a, b, None, g) for n, (f, th, a, b, g) in enumerate(zip(t.feature, t.threshold, t.left, t.right, t.gain))]
        rows += [(i, -1 - n, None, None, None, None, v, None) for n, v in enumerate(t.value)]
    return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, left int, right int, value double, gain double")


def read_meta(spark: SparkSession, path: str, defaults: dict[str, list[str]]) -> dict[str, list[str]]:
    """Feature lists by head from a JSON file; the defaults for heads, or a file, that are missing."""
    if not os.path.exists(path.removeprefix("file://")):
        return dict(defaults)
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    held = json.loads(text)
    return {head: list(held.get(f"features_{head}_used") or names) for head, names in defaults.items()}


def write_meta(path: str, features: dict[str, list[str]], **more) -> None:  # noqa: ANN003
    put_text(path, json.dumps({f"features_{head}_used": names for head, names in features.items()} | more, indent=1))


def read_recall_head(text: str) -> tuple[dict[str, float], dict[str, list[tuple[float, float]]]]:
    """Coefficients by name, and the knots of the tables S, C and U. Lines after # are comments."""
    weights: dict[str, float] = {}
    knots: dict[str, list[tuple[float, float]]] = {}
    into, left = "", 0
    for line in text.splitlines():
        parts = line.split("#")[0].split()
        if len(parts) != 2:
            continue
        if parts[0].startswith("num_knots_"):
            into, left = parts[0].removeprefix("num_knots_"), int(parts[1])
            knots[into] = []
        elif left:
            knots[into].append((float(parts[0]), float(parts[1])))
            left -= 1
        else:
            weights[parts[0]] = float(parts[1])
    return weights, knots


def linear_head(weights: dict[str, float], knots: dict[str, list[tuple[float, float]]], base: float, s: float, c: float) -> float:
    """intercept + w_base * base + w_S * S(s) + w_C * C(c), by the coefficients' order."""
    w = [*weights.values(), 0.0, 0.0, 0.0, 0.0]
    return w[0] + w[1] * base + w[2] * piecewise_value(s, knots.get("S", [])) + w[3] * piecewise_value(c, knots.get("C", []))


def read_cluster_settings(spark: SparkSession, path: str) -> list[tuple[int, float, float]]:
    """(per_cluster, sigma_deg, theta_min_deg) of each line, between commas or blanks; blank lines are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''")
    part = F.split("v", r"[,\s]+")
    rows = lines.select(F.greatest(F.lit(1), part[0].cast("double").cast("int")), F.greatest(F.lit(1e-6), part[1].cast("double")), F.greatest(F.lit(0.0), part[2].cast("double"))).collect()
    return [tuple(r) for r in rows]


def append_csv(df: DataFrame, path: str) -> None:
    """Append to a folder of CSV files, each with its header."""
    df.write.mode("append").option("header", True).csv(path)


def write_csv(df: DataFrame, path: str, decimals: int = 6) -> None:
    """Overwrite a folder of CSV files; doubles are written with fixed decimals."""
    fixed = [F.format_string(f"%.{decimals}f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*fixed).write.mode("overwrite").option("header", True).csv(path)


# The columns of the cluster file and of the file of queries.
CLUSTER_COLUMNS = ["cluster", "center_idx", "qpc", "sigma_deg", "theta_min_deg"]
QUERY_COLUMNS = ["target_recall", "qid", "search_time_s", "recall"]


def write_clusters(clusters: DataFrame, path: str) -> None:
    """The generator's clusters, with six decimals."""
    write_csv(clusters.select(*CLUSTER_COLUMNS), path)


def write_queries(rows: DataFrame, path: str) -> None:
    """Time and recall of each query and target, with six decimals."""
    write_csv(rows.select(*QUERY_COLUMNS), path)


def read_runs(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:  # noqa: ANN001
    """The table at path, built and written first when there is none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
