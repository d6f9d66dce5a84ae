"""The queries, by name, each over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, vector
from ..operators import adaptive, clustering, features, gbdt, knn, prep, recall, similarity, synth
from . import adaptive as adaptive_plan
from .tables import K, LARGE, SMALL, Workload, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

THETA = 1.6
SPHERE_THETA = 0.3
KNOTS = [(0.0, 0.0), (0.02, 0.5), (0.05, 0.7), (0.1, 1.0)]
TARGETS = "0.85:0.05:0.95"


def query(f: Callable[[Workload], DataFrame]) -> Callable[[Workload], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Workload(spark, sf_dir))
    return f


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded for output only, never before a comparison."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


# --- scans and vector functions ---------------------------------------------------------


@query
def scan_vectors(w: Workload) -> DataFrame:
    rows = table(w.spark, w.sf_dir, "embeddings")
    return rows.select("vec_id", F.col("label").cast("long").alias("label"), F.size("embedding").cast("long").alias("dim"), r6(F.col("embedding")[0].cast("double"), "x0"))


@query
def scan_block(w: Workload) -> DataFrame:
    rows = table(w.spark, w.sf_dir, "embeddings").where(F.col("vec_id").between(100, 199))
    return rows.select("vec_id", F.col("label").cast("long").alias("label"))


def successors(w: Workload) -> DataFrame:
    """(vec_id, a, b): each vector with that of the next id."""
    other = w.vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("b"))
    return w.vectors.select("vec_id", F.col("vec").alias("a")).join(other, "vec_id")


A, B = "a", "b"


@query
def vec_dot(w: Workload) -> DataFrame:
    return successors(w).select("vec_id", r6(vector.dot(A, B), "dot"))


@query
def vec_norm(w: Workload) -> DataFrame:
    return w.vectors.select("vec_id", r6(vector.norm(F.col("vec")), "norm"))


@query
def vec_normalize(w: Workload) -> DataFrame:
    return w.vectors.select("vec_id", F.posexplode(vector.normalized(F.col("vec")))).select("vec_id", F.col("pos").cast("long").alias("pos"), r6("col", "x"))


@query
def vec_l2sq(w: Workload) -> DataFrame:
    return successors(w).select("vec_id", r6(vector.l2sq(A, B), "d2"))


@query
def vec_angle(w: Workload) -> DataFrame:
    return successors(w).select("vec_id", r6(vector.angle(A, B), "angle"))


@query
def tangent_project(w: Workload) -> DataFrame:
    t = vector.tangent(A, B)
    return successors(w).select("vec_id", t.alias("t")).select("vec_id", r6(vector.norm(F.col("t")), "norm"), r6(F.col("t")[0], "t0"))


@query
def theta_min_push(w: Workload) -> DataFrame:
    pushed = successors(w).select("vec_id", "a", vector.push_out(A, F.lit(THETA), B).alias("p"))
    return pushed.select("vec_id", r6(vector.angle(F.col("p"), A), "angle"), r6(F.col("p")[0], "p0"))


@query
def sphere_point(w: Workload) -> DataFrame:
    side = vector.normalized(vector.tangent(A, B))
    made = successors(w).select("vec_id", "a", vector.on_sphere(A, side, F.lit(SPHERE_THETA)).alias("p"))
    return made.select("vec_id", r6(vector.dot(F.col("p"), A), "cosine"), r6(F.col("p")[0], "p0"))


# --- scalars ----------------------------------------------------------------------------


@query
def target_grid(w: Workload) -> DataFrame:
    rows = list(enumerate(scalars.target_grid(TARGETS)))
    return w.spark.createDataFrame(rows, "i long, target double").select("i", r6("target"))


def lines(w: Workload, *columns: str) -> DataFrame:
    return table(w.spark, w.sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), *columns)


@query
def logit_clip(w: Workload) -> DataFrame:
    x = F.col("l_discount") * 10
    return lines(w, "l_discount").select("l_orderkey", "l_linenumber", r6(scalars.logit_clip(x), "z"), r6(scalars.sigmoid(x), "s"))


@query
def piecewise_linear(w: Workload) -> DataFrame:
    return lines(w, "l_discount").select("l_orderkey", "l_linenumber", r6(scalars.piecewise_linear(F.col("l_discount"), KNOTS), "y"))


# --- neighbours and similarity ----------------------------------------------------------


@query
def exact_knn(w: Workload) -> DataFrame:
    return w.truth.select("qid", "rank", "base_id", r6("d2"))


@query
def nearest_query(w: Workload) -> DataFrame:
    return w.nearest.select("qid", "other", r6("cosine"))


@query
def gt_trim(w: Workload) -> DataFrame:
    return knn.trim(w.truth, 5).select("qid", "rank", "base_id")


@query
def cluster_sizes(w: Workload) -> DataFrame:
    return features.sizes(w.queries).select(F.col("cluster_id").cast("long").alias("cluster_id"), "n", r6("log1p_n"), r6("ln_n"))


@query
def param_grid(w: Workload) -> DataFrame:
    return w.grid().select(F.col("efc").cast("long").alias("efc"), F.col("ef_warm").cast("long").alias("ef_warm"), "share")


def _list_values(w: Workload, f: Callable[[Column, Column, int], Column], name: str) -> DataFrame:
    pairs = similarity.paired(w.nearest, w.truth)
    ks = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), f(F.col("ids"), F.col("other_ids"), k).alias("x")) for k in (1, 5, 10))))
    return pairs.select("qid", ks.alias("v")).select("qid", "v.k", r6("v.x", name))


@query
def topk_overlap(w: Workload) -> DataFrame:
    return _list_values(w, similarity.overlap, "overlap")


@query
def topk_jaccard(w: Workload) -> DataFrame:
    return _list_values(w, similarity.jaccard, "jaccard")


@query
def gt_jaccard(w: Workload) -> DataFrame:
    """Lists of the first five, where even ids count as missing."""
    pairs = similarity.paired(w.nearest, w.truth)
    lost = lambda c: F.transform(c, lambda x: F.when(x % 2 == 0, F.lit(-1).cast("long")).otherwise(x))
    return pairs.select("qid", r6(similarity.truth_jaccard(lost(F.col("ids")), lost(F.col("other_ids")), 5), "jaccard"))


def _nearest_jaccard(w: Workload) -> DataFrame:
    return similarity.nearest_jaccard(w.nearest, w.truth, K)


@query
def nearest_query_jaccard(w: Workload) -> DataFrame:
    return _nearest_jaccard(w).select("qid", "other", r6("jaccard"))


@query
def jaccard_summary(w: Workload) -> DataFrame:
    out = similarity.summary(_nearest_jaccard(w), "jaccard")
    return out.select("n", *(r6(c) for c in out.columns if c != "n"))


@query
def jaccard_examples(w: Workload) -> DataFrame:
    out = _nearest_jaccard(w).orderBy("qid").limit(5)
    return out.select("qid", "other", r6("cosine"), r6(F.degrees(F.acos(vector.clamp(F.col("cosine"), -1.0, 1.0))), "angle_deg"), r6("jaccard"))


# --- recall of the shared-anchor search -------------------------------------------------


@query
def anchor_reuse_knn(w: Workload) -> DataFrame:
    return w.reuse().select("qid", "rank", "base_id", r6("d2"))


@query
def recall_at_k(w: Workload) -> DataFrame:
    return w.counted().select("qid", "hits", "expected")


@query
def per_query_recall(w: Workload) -> DataFrame:
    return recall.per_query(w.counted()).select("qid", r6("recall"))


@query
def recall_overall(w: Workload) -> DataFrame:
    return recall.overall(w.counted()).select("hits", "expected", r6("recall"))


@query
def recall_by_cluster(w: Workload) -> DataFrame:
    return recall.by_cluster(w.counted(), w.queries).select(F.col("cluster_id").cast("long").alias("cluster_id"), "n", "hits", r6("recall"))


@query
def recall_multi_k(w: Workload) -> DataFrame:
    out = recall.at_several(w.queries, w.truth, w.reuse(), (1, 5, 10), K)
    return out.select(F.col("cluster_id").cast("long").alias("cluster_id"), *(r6(f"recall_at_{k}") for k in (1, 5, 10)))


@query
def knn_graph(w: Workload) -> DataFrame:
    return w.graph


# --- cluster features -------------------------------------------------------------------


def _cid(df: DataFrame, *names: str) -> DataFrame:
    return df.select(F.col("cluster_id").cast("long").alias("cluster_id"), *(r6(n) for n in names))


@query
def centroid(w: Workload) -> DataFrame:
    out = w.centers.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.posexplode("center"))
    return out.select("cluster_id", F.col("pos").cast("long").alias("pos"), r6("col", "x"))


def shapes(w: Workload) -> DataFrame:
    return features.shape(features.radii(w.queries, w.centers))


@query
def radius_p50(w: Workload) -> DataFrame:
    return _cid(shapes(w), "p50")


@query
def radius_p50_upper(w: Workload) -> DataFrame:
    return _cid(shapes(w), "p50_upper")


@query
def radius_p90(w: Workload) -> DataFrame:
    return _cid(shapes(w), "p90")


@query
def radius_p90_floor(w: Workload) -> DataFrame:
    return _cid(shapes(w), "p90_floor")


@query
def density_mean(w: Workload) -> DataFrame:
    return _cid(shapes(w), "density_mean")


@query
def cluster_shape(w: Workload) -> DataFrame:
    return _cid(shapes(w), "skew", "skew_serve")


@query
def density_nn10(w: Workload) -> DataFrame:
    """Over all members of each label, for held-out queries alone are too few."""
    members = w.vectors.select(F.col("vec_id").alias("qid"), F.col("label").alias("cluster_id"), "vec")
    return _cid(features.density(members), "density")


@query
def entry_point(w: Workload) -> DataFrame:
    found = features.entry_points(w.centers, w.base).join(shapes(w).select("cluster_id", "p50"), "cluster_id")
    ratio = F.when(F.col("p50") > 0, F.col("entry_dist") / F.col("p50")).otherwise(0.0)
    return found.select(F.col("cluster_id").cast("long").alias("cluster_id"), "entry_id", r6("entry_dist"), r6(ratio, "entry_dist_norm"))


@query
def centroid_probe(w: Workload) -> DataFrame:
    first = w.probes.where("rank = 1")
    return first.select(F.col("cluster_id").cast("long").alias("cluster_id"), "base_id", r6(F.sqrt("d2"), "dist"))


def probe_lists(w: Workload) -> DataFrame:
    """(cluster_id, few, many): the probes of the small and the large list, the small one over every other row of the base.

    Exact lists of two lengths have the same prefix; half the base stands for the smaller effort.
    """
    few = features.probe(w.centers, w.base.where("base_id % 2 = 1"), SMALL)
    make = lambda df, name: similarity.lists(df, "cluster_id").withColumnRenamed("ids", name)
    return make(few, "few").join(make(w.probes.where(F.col("rank") <= LARGE), "many"), "cluster_id")


@query
def probe_overlap(w: Workload) -> DataFrame:
    both = probe_lists(w)
    a, b = F.col("few"), F.col("many")
    out = [r6(f(a, b, k), f"{n}_k{k}") for n, f in (("overlap", similarity.overlap), ("jaccard", similarity.jaccard)) for k in (1, 10, 100)]
    return both.select(F.col("cluster_id").cast("long").alias("cluster_id"), *out)


@query
def lid_rc_expansion(w: Workload) -> DataFrame:
    return _cid(features.local_shape(w.probes), "lid", "rc", "expansion", "lid_serve", "rc_serve", "expansion_serve")


@query
def efc_trio(w: Workload) -> DataFrame:
    out = features.local_shape(w.probes, width=SMALL, whole=SMALL)
    return _cid(out.select("cluster_id", F.col("lid_serve").alias("lid_k_efc"), F.col("rc_serve").alias("rc_k_efc"), F.col("expansion_serve").alias("expand2k_over_k_efc")), "lid_k_efc", "rc_k_efc", "expand2k_over_k_efc")


@query
def derived_features(w: Workload) -> DataFrame:
    out = features.derived(w.grid())
    return out.select(F.col("efc").cast("long").alias("efc"), F.col("ef_warm").cast("long").alias("ef_warm"), "share", r6("log_efc"), r6("log_efw"), r6("efw_over_efc"))


# --- centers ----------------------------------------------------------------------------


@query
def farthest_first(w: Workload) -> DataFrame:
    return clustering.farthest_first(w.queries, 5).select(F.col("place").cast("long").alias("place"), "qid")


@query
def kmeans_assign(w: Workload) -> DataFrame:
    rows = w.vectors.select(F.col("vec_id").alias("qid"), "vec")
    return clustering.assign(rows, w.centers).select("qid", F.col("cluster_id").cast("long").alias("cluster_id"), r6("d2"))


# --- table preparation ------------------------------------------------------------------


@query
def coerce_numeric(w: Workload) -> DataFrame:
    rows = table(w.spark, w.sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("bad"))
    return prep.coerce_numeric(rows, "k", "bad")


@query
def median_impute(w: Workload) -> DataFrame:
    rows = table(w.spark, w.sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    return prep.median_impute(rows, "value").select("event_id", r6("value"))


@query
def winsorize(w: Workload) -> DataFrame:
    return prep.winsorize(lines(w, "l_extendedprice"), "l_extendedprice").select("l_orderkey", "l_linenumber", r6("l_extendedprice"))


@query
def rank_target(w: Workload) -> DataFrame:
    return w.grid().select(F.col("efc").cast("long").alias("efc"), F.col("ef_warm").cast("long").alias("ef_warm"), "share", r6(F.col("share") * F.col("ef_warm"), "m"))


@query
def mae(w: Workload) -> DataFrame:
    rows = lines(w, "l_extendedprice", "l_quantity").withColumn("guess", F.col("l_quantity") * 1000.0)
    return prep.mean_absolute_error(rows, "l_extendedprice", "guess").select(r6("mae"))


#: A small ensemble, written out in the SQL as well.
SMALL_MODEL = gbdt.Ensemble(
    ["l_quantity", "l_discount", "l_tax"],
    [
        gbdt.Tree([0, 1], [25.0, 0.05], [1, -2], [-1, -3], [0.5, -0.25, 0.125], [1.0, 1.0]),
        gbdt.Tree([2, 0], [0.04, 10.0], [-1, -2], [1, -3], [0.1, 0.2, 0.3], [1.0, 1.0]),
        gbdt.Tree(value=[0.75]),
    ],
)


@query
def gbdt_score(w: Workload) -> DataFrame:
    rows = lines(w, "l_quantity", "l_discount", "l_tax")
    return rows.select("l_orderkey", "l_linenumber", r6(SMALL_MODEL.expression(), "z"))


@query
def decode_params(w: Workload) -> DataFrame:
    rows = lines(w, "l_discount", "l_tax")
    z, m = F.col("l_discount") * 50, F.col("l_tax") * 20
    return rows.select("l_orderkey", "l_linenumber", adaptive.decode_ef(z).cast("long").alias("ef"), r6(adaptive.decode_m(m), "m"))


@query
def l_pred(w: Workload) -> DataFrame:
    g = w.grid().withColumn("m", F.col("share") * F.col("ef_warm") * 1.13)
    share = adaptive.predicted_share(F.col("m"), F.col("ef_warm").cast("double"), F.col("efc").cast("double"))
    return g.select(F.col("efc").cast("long").alias("efc"), F.col("ef_warm").cast("long").alias("ef_warm"), "share", r6(share, "l_pred"))


# --- the training table -----------------------------------------------------------------

#: Seeds that the relational search can take; the graph search takes any.
CELLS = [(128, 64, 0.5), (128, 64, 0.25), (128, 16, 0.5)]


def training_rows(w: Workload) -> DataFrame:
    """One row a cluster and cell: features, parameters and recall of the relational shared-anchor search."""
    shape = shapes(w).select("cluster_id", "n", "p50", "p90", "skew", "density_mean")
    local = features.local_shape(w.probes).select("cluster_id", "lid", "rc", "expansion")
    out = None
    for efc, ef_warm, share in CELLS:
        found = w.reuse(seeds=int(share * ef_warm))
        cell = recall.at_several(w.queries, w.truth, found, (1, 5, 10), K)
        cell = cell.select("cluster_id", F.lit(efc).cast("long").alias("efc"), F.lit(ef_warm).cast("long").alias("ef_warm"), F.lit(share).alias("share"), "recall_at_1", "recall_at_5", "recall_at_10")
        out = cell if out is None else out.unionByName(cell)
    return out.join(shape, "cluster_id").join(local, "cluster_id")


@query
def training_table(w: Workload) -> DataFrame:
    out = training_rows(w)
    return out.select(F.col("cluster_id").cast("long").alias("cluster_id"), "efc", "ef_warm", "share", "n", *(r6(c) for c in ("p50", "p90", "skew", "density_mean", "lid", "rc", "expansion", "recall_at_1", "recall_at_5", "recall_at_10")))


# --- without SQL ------------------------------------------------------------------------


@query
def graph_search(w: Workload) -> DataFrame:
    return adaptive_plan.graph_results(w.hold(), [(64, 32, 16.0), (64, 16, 8.0)]).select("cluster_id", "efc", "ef_warm", "m", "qid", "rank", "base_id", r6("d2"), "visited")


@query
def training_runs(w: Workload) -> DataFrame:
    return adaptive_plan.training_runs(w.hold())


@query
def gbdt_train(w: Workload) -> DataFrame:
    models = adaptive_plan.trained(w.hold())
    rows = [(h, i, f, float(g)) for h, m in sorted(models.items()) for i, (f, g) in enumerate(m.importance())]
    return w.spark.createDataFrame(rows, "head string, place int, feature string, gain double")


@query
def adaptive_search(w: Workload) -> DataFrame:
    return adaptive_plan.search(w.hold(), scalars.target_grid(TARGETS))


@query
def synth_queries(w: Workload) -> DataFrame:
    found, clusters = synth.generate(w.spark, w.queries, synth.Settings(clusters=6, per_cluster=40, sigma_deg=8.0, theta_min_deg=2.0, model="tangent_gauss", outlier_share=0.05, min_sep_deg=30.0))
    return found.join(clusters.select("cluster_id", "center_id"), "cluster_id", "left").select("qid", "cluster_id", "center_id", r6(vector.norm(F.col("vec")), "norm"), r6(F.col("vec")[0], "x0"))
