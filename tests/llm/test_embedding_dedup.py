import numpy as np

from lodestone.llm import embedding_dedup as ed


def make():
    rng = np.random.default_rng(6)
    rows, centers = [], rng.standard_normal((25, 16))
    for i in range(400):
        c = centers[i % 25]
        v = c + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.12, 0.2])
        rows.append((i, (v * rng.choice([1, 3])).tolist(), int(i % 25 % 3)))
    bad = [None, [], [0.0] * 16, [None, *[1.0] * 15], [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 15]
    rows += [(500 + k, v, 0) for k, v in enumerate(bad)]
    rows += [(600, rows[0][1], None), (601, rows[0][1], None), (602, rows[0][1], 0), (602, rows[0][1], 0)]
    return rows


def brute(rows, cosine):
    n, up, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    unit = []
    for _, v, label in rows:
        x = None if v is None or label is None or None in v else np.array(v, float)
        unit.append(x / np.linalg.norm(x) if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
    for i in range(n):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] and a @ b >= cosine:
                links[i] += 1
                links[j] += 1
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(n):
        least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    return sorted((rows[i][0], links[i], least[find(i)], rows[i][0] == least[find(i)]) for i in range(n))


def test_matches_brute_force(spark):
    rows = make()
    vectors = spark.createDataFrame([(i, v, c, "x") for i, v, c in rows], "vec_id long, embedding array<double>, label int, codes string").repartition(3)
    for block in (1024, 4):
        got = ed.component_table(vectors, ed.Dedup(block=block)).collect()
        assert sorted(tuple(r) for r in got) == brute(rows, 0.98)


def test_empty(spark):
    assert ed.component_table(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
