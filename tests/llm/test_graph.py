import random

from lodestone.llm import graph


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7777, 7777), (None, 3)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.v: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in up}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
