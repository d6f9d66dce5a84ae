"""The queries in DuckDB's SQL, over views of the same tables. Common parts are CTEs by name."""

from __future__ import annotations

import re

from .queries import CELLS, KNOTS, SPHERE_THETA, THETA

L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def l2(a: str, b: str) -> str:
    return L2.format(a=a, b=b)


def dot(a: str, b: str) -> str:
    return DOT.format(a=a, b=b)


def norm(a: str) -> str:
    return f"sqrt(greatest(1e-30, list_sum(list_transform({a}, lambda y: y * y))))"


CTES = {
    "vectors": "SELECT vec_id, embedding::DOUBLE[] AS vec, label::BIGINT AS label FROM embeddings",
    "base": "SELECT vec_id AS base_id, vec FROM vectors WHERE vec_id % 5 <> 0",
    "queries": "SELECT vec_id AS qid, label AS cluster_id, vec FROM vectors WHERE vec_id % 5 = 0",
    "pairs": "SELECT x.vec_id, x.vec AS a, y.vec AS b FROM vectors x JOIN vectors y ON y.vec_id = x.vec_id + 1",
    "truth": f"SELECT * FROM (SELECT q.qid, b.base_id, {l2('q.vec', 'b.vec')} AS d2, row_number() OVER (PARTITION BY q.qid ORDER BY {l2('q.vec', 'b.vec')}, b.base_id) AS rank FROM queries q, base b) WHERE rank <= 10",
    "nearest": f"SELECT qid, other, 1 - d2 / 2 AS cosine FROM (SELECT q.qid, o.qid AS other, {l2('q.vec', 'o.vec')} AS d2, row_number() OVER (PARTITION BY q.qid ORDER BY {l2('q.vec', 'o.vec')}, o.qid) AS r FROM queries q JOIN queries o ON q.qid <> o.qid) WHERE r = 1",
    "lists": "SELECT qid, list(base_id ORDER BY rank) AS ids FROM truth GROUP BY qid",
    "paired": "SELECT n.qid, n.other, n.cosine, l.ids, o.ids AS other_ids FROM nearest n JOIN lists l ON l.qid = n.qid LEFT JOIN lists o ON o.qid = n.other",
    "nearest_jaccard": "SELECT qid, other, cosine, CASE WHEN other_ids IS NULL THEN 0.0 ELSE len(list_intersect(ids, other_ids))::DOUBLE / len(list_distinct(list_concat(ids, other_ids))) END AS jaccard FROM paired",
    "coords": "SELECT cluster_id, i, avg(vec[i]) AS x FROM queries, range(1, 65) t(i) GROUP BY cluster_id, i",
    "centers": "SELECT cluster_id, list(x ORDER BY i) AS center FROM coords GROUP BY cluster_id",
    "radii": f"SELECT q.cluster_id, q.qid, sqrt({l2('q.vec', 'c.center')}) AS r FROM queries q JOIN centers c USING (cluster_id)",
    "shapes": "SELECT cluster_id, count(*) AS n, quantile_cont(r, 0.5) AS p50, quantile_cont(r, 0.9) AS p90, list_sort(list(r))[(count(*) // 2 + 1)::INT] AS p50_upper, list_sort(list(r))[(floor(0.9 * (count(*) - 1)) + 1)::INT] AS p90_floor, 1 / (avg(r) + 1e-6) AS density_mean FROM radii GROUP BY cluster_id",
    "probes": f"SELECT * FROM (SELECT c.cluster_id, b.base_id, {l2('c.center', 'b.vec')} AS d2, row_number() OVER (PARTITION BY c.cluster_id ORDER BY {l2('c.center', 'b.vec')}, b.base_id) AS rank FROM centers c, base b) WHERE rank <= 256",
    "half": f"SELECT * FROM (SELECT c.cluster_id, b.base_id, row_number() OVER (PARTITION BY c.cluster_id ORDER BY {l2('c.center', 'b.vec')}, b.base_id) AS rank FROM centers c JOIN base b ON b.base_id % 2 = 1) WHERE rank <= 128",
    "few": "SELECT cluster_id, list(base_id ORDER BY rank) AS few FROM half GROUP BY cluster_id",
    "many": "SELECT cluster_id, list(base_id ORDER BY rank) AS many FROM probes GROUP BY cluster_id",
    "near": f"SELECT * FROM (SELECT x.base_id AS src, y.base_id AS dst, row_number() OVER (PARTITION BY x.base_id ORDER BY {l2('x.vec', 'y.vec')}, y.base_id) AS r FROM base x JOIN base y ON x.base_id <> y.base_id) WHERE r <= 16",
    "edges": "SELECT src, dst FROM near UNION SELECT dst AS src, src AS dst FROM near",
    "grid": "SELECT efc, ef_warm, share FROM (VALUES (64), (128), (256)) a(efc), (VALUES (64), (128), (256)) b(ef_warm), (VALUES (0.5::DOUBLE), (1.0), (1.5)) c(share) WHERE ef_warm <= efc AND share * ef_warm <= efc + 1e-5",
}
for _m in (16, 32, 8):
    CTES[f"seeds{_m}"] = f"SELECT cluster_id, base_id FROM probes WHERE rank <= {_m}"
    CTES[f"candidates{_m}"] = f"SELECT cluster_id, base_id FROM seeds{_m} UNION SELECT s.cluster_id, e.dst AS base_id FROM seeds{_m} s JOIN edges e ON e.src = s.base_id"
    CTES[f"found{_m}"] = f"SELECT * FROM (SELECT q.qid, b.base_id, {l2('q.vec', 'b.vec')} AS d2, row_number() OVER (PARTITION BY q.qid ORDER BY {l2('q.vec', 'b.vec')}, b.base_id) AS rank FROM queries q JOIN candidates{_m} c ON c.cluster_id = q.cluster_id JOIN base b ON b.base_id = c.base_id) WHERE rank <= 10"
CTES["counted"] = "SELECT q.qid, q.cluster_id, coalesce(h.hits, 0)::BIGINT AS hits, 10::BIGINT AS expected FROM queries q LEFT JOIN (SELECT t.qid, count(*) AS hits FROM truth t JOIN found16 f ON f.qid = t.qid AND f.base_id = t.base_id GROUP BY t.qid) h ON h.qid = q.qid"


def local(width: int, whole: int) -> str:
    return f"""SELECT cluster_id,
  CASE WHEN rk IS NOT NULL AND abs(t) > 1e-18 THEN -1 / t END AS lid,
  CASE WHEN rk IS NOT NULL THEN mean / (rk + 1e-12) END AS rc,
  CASE WHEN r2k IS NOT NULL THEN r2k / (rk + 1e-12) END AS expansion,
  CASE WHEN abs(s) > 1e-12 THEN -1 / s ELSE 0.0 END AS lid_serve,
  CASE WHEN rk > 1e-12 THEN mean_all / rk ELSE 1.0 END AS rc_serve,
  CASE WHEN rk > 1e-12 THEN r2k / rk ELSE 1.0 END AS expansion_serve
FROM (SELECT p.cluster_id, max(e.rk) AS rk, max(e.r2k) AS r2k,
    avg(CASE WHEN rank <= 10 THEN ln(greatest(sqrt(d2), 1e-12) / (e.rk + 1e-12)) END) AS t,
    avg(CASE WHEN rank <= 10 THEN ln(greatest(sqrt(d2) / (e.rk + 1e-12), 1e-12)) END) AS s,
    avg(CASE WHEN rank <= {whole} THEN sqrt(d2) END) AS mean, avg(sqrt(d2)) AS mean_all
  FROM probes p JOIN (SELECT cluster_id, max(CASE WHEN rank = 10 THEN sqrt(d2) END) AS rk, max(CASE WHEN rank = 20 THEN sqrt(d2) END) AS r2k FROM probes GROUP BY cluster_id) e USING (cluster_id)
  WHERE rank <= {width} GROUP BY p.cluster_id)"""


CTES["local"] = local(256, 100)
CTES["local_efc"] = local(128, 128)


def several(found: str) -> str:
    hits = ", ".join(f"count(*) FILTER (t.rank <= {k} AND f.rank <= {k}) AS h{k}" for k in (1, 5, 10))
    out = ", ".join(f"sum(coalesce(h{k}, 0))::DOUBLE / (count(*) * {k}) AS recall_at_{k}" for k in (1, 5, 10))
    return f"SELECT q.cluster_id, {out} FROM queries q LEFT JOIN (SELECT t.qid, {hits} FROM truth t JOIN {found} f ON f.qid = t.qid AND f.base_id = t.base_id GROUP BY t.qid) h ON h.qid = q.qid GROUP BY q.cluster_id"


def full(body: str) -> str:
    """The statement with the CTEs that it names, directly or not, in order."""
    wanted: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in wanted and re.search(rf"(?:FROM|JOIN|,) {name}\b", text):
                wanted.add(name)
                todo.append(CTES[name])
    done: list[str] = []

    def place(name: str) -> None:
        for other in CTES:
            if other != name and other in wanted and other not in done and re.search(rf"(?:FROM|JOIN|,) {other}\b", CTES[name]):
                place(other)
        if name not in done:
            done.append(name)

    for name in CTES:
        if name in wanted:
            place(name)
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in done)
    return f"WITH {head}\n{body}" if done else body


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


TAN = f"list_transform(list_zip(b, a), lambda z: z[1] - p * z[2])"
SIDE = f"(SELECT vec_id, a, b, p, {TAN} AS t FROM (SELECT vec_id, a, b, {dot('a', 'b')} AS p FROM pairs))"
UNIT = f"(SELECT vec_id, a, b, p, t, list_transform(t, lambda y: y / n) AS u FROM (SELECT *, {norm('t')} AS n FROM {SIDE}))"


def _sphere(theta: str) -> str:
    raw = f"list_transform(list_zip(a, u), lambda z: cos({theta}) * z[1] + sin({theta}) * z[2])"
    return f"(SELECT vec_id, a, b, p, list_transform(raw, lambda y: y / m) AS q FROM (SELECT *, {norm('raw')} AS m FROM (SELECT *, {raw} AS raw FROM {UNIT})))"


def _piecewise(x: str) -> str:
    out = f"CASE WHEN {x} <= {KNOTS[0][0]} THEN {KNOTS[0][1]}::DOUBLE"
    for (x0, y0), (x1, y1) in zip(KNOTS, KNOTS[1:]):
        out += f" WHEN {x} < {x1} THEN {y0}::DOUBLE + ({x} - {x0}::DOUBLE) / ({x1 - x0!r}::DOUBLE + 1e-12) * {y1 - y0!r}::DOUBLE"
    return out + f" ELSE {KNOTS[-1][1]}::DOUBLE END"


def _farthest(k: int) -> str:
    out = ["c0 AS MATERIALIZED (SELECT qid, vec FROM queries ORDER BY qid LIMIT 1)"]
    for i in range(1, k):
        near = ", ".join(f"(SELECT acos(greatest(-1, least(1, {dot('q.vec', 'c.vec')}))) FROM c{j} c)" for j in range(i))
        taken = " AND ".join(f"q.qid <> (SELECT qid FROM c{j})" for j in range(i))
        out.append(f"c{i} AS MATERIALIZED (SELECT qid, vec FROM queries q WHERE {taken} ORDER BY least({near}) DESC, qid LIMIT 1)")
    rows = " UNION ALL ".join(f"SELECT {i}::BIGINT AS place, qid FROM c{i}" for i in range(k))
    return full("SELECT 1 FROM queries").replace("\nSELECT 1 FROM queries", ",\n" + ",\n".join(out) + f"\n{rows}")


LINE = "l_orderkey, l_linenumber::BIGINT AS l_linenumber"


def statements() -> dict[str, str]:
    overlap = lambda a, b, k: f"CASE WHEN least({k}, len({a}), len({b})) > 0 THEN len(list_intersect({a}[1:least({k}, len({a}), len({b}))], {b}[1:least({k}, len({a}), len({b}))]))::DOUBLE / least({k}, len({a}), len({b})) ELSE 0.0 END"
    jaccard = lambda a, b, k: f"CASE WHEN least({k}, len({a}), len({b})) > 0 THEN len(list_intersect({a}[1:least({k}, len({a}), len({b}))], {b}[1:least({k}, len({a}), len({b}))]))::DOUBLE / len(list_distinct(list_concat({a}[1:least({k}, len({a}), len({b}))], {b}[1:least({k}, len({a}), len({b}))]))) ELSE 0.0 END"
    per_k = lambda f, name: " UNION ALL ".join(f"SELECT qid, {k}::BIGINT AS k, round({f('ids', 'other_ids', k)}, 6) AS {name} FROM paired" for k in (1, 5, 10))
    cells = " UNION ALL ".join(f"SELECT cluster_id, {efc}::BIGINT AS efc, {efw}::BIGINT AS ef_warm, {share}::DOUBLE AS share, recall_at_1, recall_at_5, recall_at_10 FROM ({several(f'found{int(share * efw)}')})" for efc, efw, share in CELLS)
    out = {
        "scan_vectors": "SELECT vec_id, label::BIGINT AS label, len(embedding)::BIGINT AS dim, round(embedding[1]::DOUBLE, 6) AS x0 FROM embeddings",
        "scan_block": "SELECT vec_id, label::BIGINT AS label FROM embeddings WHERE vec_id BETWEEN 100 AND 199",
        "vec_dot": f"SELECT vec_id, round({dot('a', 'b')}, 6) AS dot FROM pairs",
        "vec_norm": f"SELECT vec_id, round({norm('vec')}, 6) AS norm FROM vectors",
        "vec_normalize": f"SELECT vec_id, i - 1 AS pos, round(vec[i] / n, 6) AS x FROM (SELECT *, {norm('vec')} AS n FROM vectors), range(1, 65) t(i)",
        "vec_l2sq": f"SELECT vec_id, round({l2('a', 'b')}, 6) AS d2 FROM pairs",
        "vec_angle": f"SELECT vec_id, round(acos(greatest(-1, least(1, {dot('a', 'b')}))), 6) AS angle FROM pairs",
        "tangent_project": f"SELECT vec_id, round({norm('t')}, 6) AS norm, round(t[1], 6) AS t0 FROM {SIDE}",
        "theta_min_push": f"SELECT vec_id, round(acos(greatest(-1, least(1, {dot('v', 'a')}))), 6) AS angle, round(v[1], 6) AS p0 FROM (SELECT vec_id, a, CASE WHEN acos(greatest(-1, least(1, p))) < {THETA} THEN q ELSE b END AS v FROM {_sphere(str(THETA))})",
        "sphere_point": f"SELECT vec_id, round({dot('q', 'a')}, 6) AS cosine, round(q[1], 6) AS p0 FROM {_sphere(str(SPHERE_THETA))}",
        "target_grid": "SELECT i, round(0.85::DOUBLE + i * 0.05::DOUBLE, 6) AS target FROM range(0, 3) t(i)",
        "logit_clip": f"SELECT {LINE}, round(ln(x / (1 - x)), 6) AS z, round(1 / (1 + exp(-l_discount * 10)), 6) AS s FROM (SELECT *, greatest(1e-5, least(1 - 1e-5, l_discount * 10)) AS x FROM lineitem)",
        "piecewise_linear": f"SELECT {LINE}, round({_piecewise('l_discount')}, 6) AS y FROM lineitem",
        "exact_knn": "SELECT qid, rank, base_id, round(d2, 6) AS d2 FROM truth",
        "nearest_query": "SELECT qid, other, round(cosine, 6) AS cosine FROM nearest",
        "gt_trim": "SELECT qid, rank, base_id FROM truth WHERE rank <= 5",
        "cluster_sizes": "SELECT cluster_id, count(*) AS n, round(ln(1 + count(*)::DOUBLE), 6) AS log1p_n, round(ln(count(*)::DOUBLE), 6) AS ln_n FROM queries WHERE cluster_id >= 0 GROUP BY cluster_id",
        "param_grid": "SELECT efc::BIGINT AS efc, ef_warm::BIGINT AS ef_warm, share FROM grid",
        "topk_overlap": per_k(overlap, "overlap"),
        "topk_jaccard": per_k(jaccard, "jaccard"),
        "gt_jaccard": "SELECT qid, round(CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) ELSE 1.0 END, 6) AS jaccard FROM (SELECT qid, list_filter(ids[1:5], lambda i: i % 2 <> 0) AS x, list_filter(other_ids[1:5], lambda i: i % 2 <> 0) AS y FROM paired)",
        "nearest_query_jaccard": "SELECT qid, other, round(jaccard, 6) AS jaccard FROM nearest_jaccard",
        "jaccard_summary": f"SELECT n, {rounded('mean', 'p10', 'median', 'p90', 'least', 'most')} FROM (SELECT count(jaccard) AS n, avg(jaccard) AS mean, quantile_cont(jaccard, 0.1) AS p10, quantile_cont(jaccard, 0.5) AS median, quantile_cont(jaccard, 0.9) AS p90, min(jaccard) AS least, max(jaccard) AS most FROM nearest_jaccard)",
        "jaccard_examples": "SELECT qid, other, round(cosine, 6) AS cosine, round(degrees(acos(greatest(-1, least(1, cosine)))), 6) AS angle_deg, round(jaccard, 6) AS jaccard FROM nearest_jaccard ORDER BY qid LIMIT 5",
        "anchor_reuse_knn": "SELECT qid, rank, base_id, round(d2, 6) AS d2 FROM found16",
        "recall_at_k": "SELECT qid, hits, expected FROM counted",
        "per_query_recall": "SELECT qid, round(hits::DOUBLE / expected, 6) AS recall FROM counted",
        "recall_overall": "SELECT sum(hits)::BIGINT AS hits, sum(expected)::BIGINT AS expected, round(sum(hits)::DOUBLE / sum(expected), 6) AS recall FROM counted",
        "recall_by_cluster": "SELECT cluster_id, count(*) AS n, sum(hits)::BIGINT AS hits, round(sum(hits)::DOUBLE / sum(expected), 6) AS recall FROM counted GROUP BY cluster_id",
        "recall_multi_k": f"SELECT cluster_id, {rounded('recall_at_1', 'recall_at_5', 'recall_at_10')} FROM ({several('found16')})",
        "knn_graph": "SELECT src, dst FROM edges",
        "centroid": "SELECT cluster_id, i - 1 AS pos, round(x, 6) AS x FROM coords",
        "cluster_shape": "SELECT cluster_id, round(CASE WHEN p50 > 0 THEN p90 / p50 ELSE 0 END, 6) AS skew, round(CASE WHEN p50_upper > 0 THEN p90_floor / p50_upper ELSE 0 END, 6) AS skew_serve FROM shapes",
        "density_nn10": f"SELECT c.cluster_id, round(CASE WHEN m > 0 THEN 1 / m ELSE 0 END, 6) AS density FROM (SELECT DISTINCT label AS cluster_id FROM vectors) c LEFT JOIN (SELECT label AS cluster_id, median(sqrt(d2)) AS m FROM (SELECT x.label, {l2('x.vec', 'y.vec')} AS d2, row_number() OVER (PARTITION BY x.vec_id ORDER BY {l2('x.vec', 'y.vec')}, y.vec_id) AS r FROM vectors x JOIN vectors y ON x.label = y.label AND x.vec_id <> y.vec_id) WHERE r = 10 GROUP BY label) d USING (cluster_id)",
        "entry_point": f"SELECT cluster_id, base_id AS entry_id, round(sqrt(d2), 6) AS entry_dist, round(CASE WHEN p50 > 0 THEN sqrt(d2) / p50 ELSE 0 END, 6) AS entry_dist_norm FROM (SELECT c.cluster_id, b.base_id, {l2('c.center', 'b.vec')} AS d2, row_number() OVER (PARTITION BY c.cluster_id ORDER BY {l2('c.center', 'b.vec')}, b.base_id) AS r FROM centers c JOIN base b ON b.base_id % 32 = 0) JOIN shapes USING (cluster_id) WHERE r = 1",
        "centroid_probe": "SELECT cluster_id, base_id, round(sqrt(d2), 6) AS dist FROM probes WHERE rank = 1",
        "probe_overlap": "SELECT cluster_id, " + ", ".join(f"round({f('few', 'many', k)}, 6) AS {n}_k{k}" for n, f in (("overlap", overlap), ("jaccard", jaccard)) for k in (1, 10, 100)) + " FROM few JOIN many USING (cluster_id)",
        "lid_rc_expansion": f"SELECT cluster_id, {rounded('lid', 'rc', 'expansion', 'lid_serve', 'rc_serve', 'expansion_serve')} FROM local",
        "efc_trio": "SELECT cluster_id, round(lid_serve, 6) AS lid_k_efc, round(rc_serve, 6) AS rc_k_efc, round(expansion_serve, 6) AS expand2k_over_k_efc FROM local_efc",
        "derived_features": "SELECT efc::BIGINT AS efc, ef_warm::BIGINT AS ef_warm, share, round(ln(1 + efc::DOUBLE), 6) AS log_efc, round(ln(1 + ef_warm::DOUBLE), 6) AS log_efw, round(ef_warm::DOUBLE / greatest(1, efc), 6) AS efw_over_efc FROM grid",
        "kmeans_assign": f"SELECT qid, cluster_id, round(d2, 6) AS d2 FROM (SELECT v.vec_id AS qid, c.cluster_id, {l2('v.vec', 'c.center')} AS d2, row_number() OVER (PARTITION BY v.vec_id ORDER BY {l2('v.vec', 'c.center')}, c.cluster_id) AS r FROM vectors v, centers c) WHERE r = 1",
        "coerce_numeric": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events",
        "median_impute": "SELECT event_id, round(coalesce(v, m), 6) AS value FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events), (SELECT median(value) AS m FROM events WHERE event_id % 7 <> 0)",
        "winsorize": f"SELECT {LINE}, round(greatest(lo, least(hi, l_extendedprice)), 6) AS l_extendedprice FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)",
        "rank_target": "SELECT efc::BIGINT AS efc, ef_warm::BIGINT AS ef_warm, share, round(share * ef_warm, 6) AS m FROM grid",
        "mae": "SELECT round(avg(abs(l_extendedprice - l_quantity * 1000)), 6) AS mae FROM lineitem",
        "gbdt_score": f"SELECT {LINE}, round((CASE WHEN l_quantity <= 25 THEN CASE WHEN l_discount <= 0.05::DOUBLE THEN -0.25 ELSE 0.125 END ELSE 0.5 END)::DOUBLE + (CASE WHEN l_tax <= 0.04::DOUBLE THEN 0.1 ELSE CASE WHEN l_quantity <= 10 THEN 0.2 ELSE 0.3 END END)::DOUBLE + 0.75::DOUBLE, 6) AS z FROM lineitem",
        "decode_params": f"SELECT {LINE}, greatest(1, round(exp(l_discount * 50) - 1))::BIGINT AS ef, round(exp(l_tax * 20) - 1, 6) AS m FROM lineitem",
        "l_pred": "SELECT efc::BIGINT AS efc, ef_warm::BIGINT AS ef_warm, share, round(ceil(least(greatest(share * ef_warm * 1.13::DOUBLE / ef_warm, 1), greatest(1, efc::DOUBLE / ef_warm)) / 0.05::DOUBLE - 1e-9) * 0.05::DOUBLE, 6) AS l_pred FROM grid",
        "training_table": f"SELECT cluster_id, efc, ef_warm, share, n, {rounded('p50', 'p90', 'skew', 'density_mean', 'lid', 'rc', 'expansion', 'recall_at_1', 'recall_at_5', 'recall_at_10')} FROM (SELECT *, CASE WHEN p50 > 0 THEN p90 / p50 ELSE 0 END AS skew FROM shapes) JOIN local USING (cluster_id) JOIN ({cells}) USING (cluster_id)",
    }
    for name in ("p50", "p50_upper", "p90", "p90_floor"):
        out[f"radius_{name}"] = f"SELECT cluster_id, round({name}, 6) AS {name} FROM shapes"
    out["density_mean"] = "SELECT cluster_id, round(density_mean, 6) AS density_mean FROM shapes"
    return {k: full(v) for k, v in out.items()} | {"farthest_first": _farthest(5)}
