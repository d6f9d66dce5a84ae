"""From features to a trained, adaptive search: collect, train, choose, search, evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import adaptive, features, gbdt, graph_search, knn, prep, recall, similarity
from ..sources.scratch import kept
from .tables import K, LARGE, PROBES, SMALL, Workload

#: Cells of the collected grid: (efc, ef_warm, share of ef_warm).
CELLS = [(efc, efw, share) for efc in (16, 64, 128) for efw in (10, 16, 24, 32, 48, 64, 128) for share in (0.5, 1.0) if efw <= efc]
#: Recall levels that the heads learn the cheapest cell of.
LEVELS = [0.5, 0.6, 0.7, 0.75, 0.8, 0.825, 0.85, 0.875, 0.9, 0.925, 0.95, 0.97, 0.98, 0.99, 1.0]
QUANTILE = gbdt.Settings(loss="quantile", trees=120, min_rows=4)
MONOTONE = gbdt.Settings(loss="huber", trees=120, min_rows=4, min_gain=1e-4)


ALIKE = {"overlap": similarity.overlap, "jaccard": similarity.jaccard}
#: Depths of the lists' comparisons, and of the recalls of the training table.
DEPTHS = (1, 10, 100)
# The columns of the training table, in order.
COLUMNS = [
    "cluster_id", "cluster_size",
    "cluster_density", "cluster_radius_p50", "cluster_radius_p90", "radius_skew",
    "dist_centroid_to_entryL0", "entry_dist_norm", "dist_centroid_top1_smallEF",
    "overlap128_vs_256", "jaccard128_vs_256",
    "overlap128_vs_256_k1", "overlap128_vs_256_k10", "overlap128_vs_256_k100",
    "jaccard128_vs_256_k1", "jaccard128_vs_256_k10", "jaccard128_vs_256_k100",
    "lid_probe256_k10", "rc_probe256_k10", "expansion2k_over_k_probe256_k10",
    "efc", "ef_warm", "L_aligned",
    "recall_at_1", "recall_at_10", "recall_at_100", "qps_run",
    "centroid_steps", "visited_mean",
]


def cluster_features(w: Workload, faithful_skew: bool = False) -> DataFrame:
    """The static features of each cluster, under the names that the heads know.

    Training and serving use the same definitions; faithful_skew takes those of serving where
    the two differ.
    """
    # percentiles read their rows again and again
    shape = features.shape(kept(features.radii(w.queries, w.centers), "radii"))
    p50, p90, skew = ("p50_upper", "p90_floor", "skew_serve") if faithful_skew else ("p50", "p90", "skew")
    sizes = features.sizes(w.queries)
    density = features.density(w.queries, values=kept(features.tenth_distances(w.queries), "tenths")).withColumnRenamed("density", "nn10")
    entry = features.entry_points(w.centers, w.base)
    first = w.probes.where("rank = 1").select("cluster_id", F.sqrt("d2").alias("dist_centroid_top1_smallEF"))
    found = graph_search.probe(w.centers, w.index, (SMALL, LARGE))
    few, many = (similarity.lists(found.where(F.col("ef") == ef), "cluster_id").withColumnRenamed("ids", name) for ef, name in ((SMALL, "few"), (LARGE, "many")))
    lists = few.join(many, "cluster_id")
    sides = F.col("few"), F.col("many")
    alike = [f(*sides, K).alias(f"{name}128_vs_256") for name, f in ALIKE.items()]
    alike += [f(*(F.slice(x, 1, 100) for x in sides), k).alias(f"{name}128_vs_256_k{k}") for name, f in ALIKE.items() for k in DEPTHS]
    alike = lists.select("cluster_id", *alike)
    local = features.local_shape(w.probes)
    names = [f"{c}_serve" if faithful_skew else c for c in ("lid", "rc", "expansion")]
    local = local.select("cluster_id", *(F.col(n).alias(to) for n, to in zip(names, adaptive.PROBE)))
    # each part is a plan of its own: one plan of all of them fills the driver's heap
    parts = {"shape": shape, "sizes": sizes.drop("n"), "density": density, "entry": entry, "first": first, "alike": alike, "local": local}
    out, *others = (kept(part, name) for name, part in parts.items())
    for part in others:
        out = out.join(part, "cluster_id")
    radius = F.col(p50)
    return out.select(
        "cluster_id",
        F.col("n").cast("double").alias("cluster_size"),
        (F.col("ln_n") if faithful_skew else F.col("log1p_n")).alias("cluster_size_log"),
        F.col("log1p_n").alias("log1p_cluster_size"),
        (F.col("density_mean") if faithful_skew else F.col("nn10")).alias("cluster_density"),
        radius.alias("cluster_radius_p50"),
        F.col(p90).alias("cluster_radius_p90"),
        F.col(skew).alias("radius_skew"),
        F.col("entry_dist").alias("dist_centroid_to_entryL0"),
        F.when(radius > 0, F.col("entry_dist") / radius).otherwise(0.0).alias("entry_dist_norm"),
        "dist_centroid_top1_smallEF",
        "overlap128_vs_256",
        "jaccard128_vs_256",
        *adaptive.PROBE,
        *(f"{name}128_vs_256_k{k}" for name in ALIKE for k in DEPTHS),
    )


def static_features(w: Workload) -> DataFrame:
    """cluster_features of a workload, written once."""
    if "static" not in w.__dict__:
        w.__dict__["static"] = kept(cluster_features(w), "static")
    return w.__dict__["static"]


def anchor_features(w: Workload, rows: DataFrame) -> DataFrame:
    """rows (cluster_id, efc, ...) with the trio of the anchor's list of efc."""
    wanted = rows.select("cluster_id", "efc").distinct()
    lists = w.probes.join(wanted, "cluster_id").where(F.col("rank") <= F.least(F.col("efc"), F.lit(PROBES)))
    # a cluster and efc make one list
    key = F.struct("cluster_id", "efc")
    trio = features.local_shape(lists.select(key.alias("cluster_id"), "rank", "d2"))
    trio = trio.select("cluster_id.cluster_id", "cluster_id.efc", F.col("lid_serve").alias("lid_k_efc"), F.col("rc_serve").alias("rc_k_efc"), F.col("expansion_serve").alias("expand2k_over_k_efc"))
    return rows.join(trio, ["cluster_id", "efc"])


def graph_results(w: Workload, cells: list[tuple[int, int, float]]) -> DataFrame:
    settings = w.spark.createDataFrame(cells, "efc int, ef_warm int, m double").crossJoin(w.centers.select("cluster_id"))
    return graph_search.search_clusters(w.queries, w.centers, settings, w.index, K)


def collected(w: Workload) -> DataFrame:
    """The training table: one row a cluster and cell, with features, recall and rows visited."""
    cells = [(efc, efw, share * efw) for efc, efw, share in CELLS]
    found = kept(graph_results(w, cells), "results")
    key = ["cluster_id", "efc", "ef_warm", "m"]
    hit = found.join(w.truth.select("qid", "base_id"), ["qid", "base_id"], "left_semi").groupBy(*key).agg(F.count("*").alias("hits"))
    # a query that finds anything has a row of rank 1
    first = found.where("rank = 1").groupBy(*key)
    seen = first.agg(F.avg("visited").alias("visited_mean"), F.max("steps").alias("centroid_steps"), (F.count("*") / F.greatest(F.lit(1e-12), F.sum("seconds"))).alias("qps_run"))
    static = static_features(w)
    rows = static.join(seen, "cluster_id").join(hit, key, "left")
    rows = rows.withColumn("recall_at_k", F.coalesce("hits", F.lit(0)) / (F.col("cluster_size") * K)).drop("hits")
    return features.derived(anchor_features(w, rows))


def training_runs(w: Workload) -> DataFrame:
    """One row a cluster and valid cell of the grid, with the columns of a training file; truth has 100 neighbours."""
    most, key = DEPTHS[-1], ["cluster_id", "efc", "ef_warm", "m"]
    grid = w.grid().withColumn("m", F.col("share") * F.col("ef_warm")).select(F.col("efc").cast("int").alias("efc"), F.col("ef_warm").cast("int").alias("ef_warm"), "m")
    truth = knn.exact_knn(w.queries, w.base, most).select("qid", "base_id", F.col("rank").alias("place"))
    found = kept(graph_search.search_clusters(w.queries, w.centers, grid.crossJoin(w.centers.select("cluster_id")), w.index, most), "results")  # the grid is a setting
    hits = [(F.count_if((F.col("rank") <= k) & (F.col("place") <= k))).alias(f"hits_{k}") for k in DEPTHS]
    hit = found.join(truth, ["qid", "base_id"]).groupBy(*key).agg(*hits)
    first = found.where("rank = 1").groupBy(*key)
    seen = first.agg(F.avg("visited").alias("visited_mean"), F.max("steps").alias("centroid_steps"), (F.count("*") / F.greatest(F.lit(1e-12), F.sum("seconds"))).alias("qps_run"))
    held = truth.groupBy("qid").agg(F.count("*").alias("held")).join(w.queries, "qid").groupBy("cluster_id").agg(*(F.sum(F.least("held", F.lit(k))).alias(f"all_{k}") for k in DEPTHS))
    rows = static_features(w).join(seen, "cluster_id").join(hit, key, "left").join(held, "cluster_id")
    rows = rows.withColumns({f"recall_at_{k}": F.coalesce(f"hits_{k}", F.lit(0)) / F.col(f"all_{k}") for k in DEPTHS})
    return rows.withColumn("L_aligned", F.col("m") / F.col("ef_warm")).select(*COLUMNS)


def cheapest(rows: DataFrame, levels: list[float]) -> DataFrame:
    """For each cluster and recall level the cell that reaches it with the fewest rows visited; recall_at_k is the level.

    Levels that no cell of a cluster reaches have no row of it.
    """
    table = rows.sparkSession.createDataFrame([(x,) for x in levels], "level double")  # a few levels
    fits = rows.join(F.broadcast(table), F.col("recall_at_k") >= F.col("level") - F.lit(1e-9))
    others = [c for c in rows.columns if c not in ("cluster_id", "recall_at_k")]
    best = fits.groupBy("cluster_id", "level").agg(F.min(F.struct("visited_mean", "efc", "ef_warm", "m", *(F.col(c).alias(f"of_{c}") for c in others))).alias("x"))
    return best.select("cluster_id", F.col("level").alias("recall_at_k"), *(F.col(f"x.of_{c}").alias(c) for c in others))


def prepared(rows: DataFrame) -> DataFrame:
    trio = [*adaptive.PROBE, *adaptive.ANCHOR]
    prep.require(rows, "recall_at_k", *adaptive.ANCHOR)
    return prep.winsorize(prep.median_impute(rows, *adaptive.SHAPE, *trio), *trio)


def trained(w: Workload) -> dict[str, gbdt.Ensemble]:
    """Six models: the heads for efc, ef_warm and m (A, B, M), each by the features known at its turn, once for a quantile and once monotone (A_mono, ...)."""
    rows = kept(cheapest(kept(collected(w), "collected"), LEVELS), "cheapest")
    rows = kept(prepared(rows), "prepared")
    heads = {}
    for name, names, target in (("A", adaptive.HEAD_A, "efc"), ("B", adaptive.HEAD_B, "ef_warm"), ("M", adaptive.HEAD_M, "m")):
        heads[name] = (names, target, QUANTILE, None)
        heads[f"{name}_mono"] = (names, target, MONOTONE, prep.monotone_signs(names, adaptive.RISING, adaptive.FALLING))
    return gbdt.fit_heads(rows, heads)


def search(w: Workload, targets: list[float], monotone: bool = False) -> DataFrame:
    """Per target recall: recall reached, mean rows visited, queries a second of search time, over all queries.

    Parameters come from the quantile heads, or from the monotone ones, of which none falls with
    the target while its other features stay.
    """
    static = static_features(w)
    models = trained(w)
    models = {name: models[f"{name}_mono" if monotone else name] for name in "ABM"}
    chosen = kept(adaptive.choose(static, lambda rows: kept(anchor_features(w, rows), "anchored"), models, targets), "chosen")
    found = graph_search.search_clusters(w.queries, w.centers, chosen.select("cluster_id", "efc", "ef_warm", "m").distinct(), w.index, K)
    rows = found.join(chosen.select("target", "cluster_id", "efc", "ef_warm", "m"), ["cluster_id", "efc", "ef_warm", "m"])
    rows = kept(rows, "found")
    per = [recall.overall(recall.hits(w.queries, w.truth, rows.where(F.abs(F.col("target") - t) < 1e-9), K)).select(F.lit(t).alias("target"), "recall") for t in targets]
    out = per[0]
    for p in per[1:]:
        out = out.unionByName(p)
    first = rows.where("rank = 1").groupBy(F.round("target", 9).alias("t"))
    cost = first.agg(F.avg("visited").alias("visited_mean"), (F.count("*") / F.greatest(F.lit(1e-12), F.sum("seconds"))).alias("qps"))
    return out.join(cost, F.round("target", 9) == F.col("t"), "left").select(F.round("target", 6).alias("target_recall"), F.round("qps", 3).alias("qps"), F.round("recall", 6).alias("recall"), F.round("visited_mean", 3).alias("visited_mean"))
