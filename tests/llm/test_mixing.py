import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import mixing


def test_targets_stop_and_are_shared_again():
    got = mixing.targets([10, 1000, 10, 0], [1, 2, 3, 1], 3)
    assert got[0] == 30 and got[2] == 30 and got[3] == 0 and got[1] == pytest.approx(960)
    assert mixing.targets([100, 100], [1, 3], 3) == [50, 150] and mixing.targets([0, 0], [1, 2], 3) == [0, 0]
    rnd = random.Random(1)
    for _ in range(200):
        sizes = [rnd.choice([0, 1, 5, 100, 10_000]) for _ in range(rnd.randint(1, 9))]
        weights = [1 + i % 3 for i in range(len(sizes))]
        got = mixing.targets(sizes, weights, 3)
        assert sum(got) == pytest.approx(sum(sizes)) and all(g <= 3 * s + 1e-9 for g, s in zip(got, sizes))
        free = {round(g / w, 6) for g, s, w in zip(got, sizes, weights) if g < 3 * s - 1e-6}
        assert len(free) <= 1


def test_knapsack_is_as_near_as_any_choice():
    rnd = random.Random(2)
    for _ in range(300):
        sizes = sorted(rnd.sample(range(1, 30), rnd.randint(1, 4)))
        counts = [rnd.randint(0, 4) for _ in sizes]
        budget = rnd.randint(0, 60)
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {x + s * k for x in sums for k in range(c + 1)}
        took = mixing.knapsack(sizes, counts, budget)
        assert all(took.get(s, 0) <= c for s, c in zip(sizes, counts))
        total = sum(s * n for s, n in took.items())
        assert abs(total - budget) == min(abs(x - budget) for x in sums if x <= 2 * budget)


def test_fit_comes_near_and_stays_within_counts():
    rnd = np.random.default_rng(3)
    for _ in range(40):
        sizes = np.unique(rnd.integers(0, 5000, 300))
        counts = rnd.integers(1, 50, len(sizes))
        whole = int((sizes * counts).sum())
        target = float(rnd.uniform(0, 3 * whole))
        passes, took = mixing.fit(sizes, counts, target, 3)
        assert (took >= 0).all() and (took <= counts).all() and passes + (took > 0).any() <= 3
        assert abs(passes * whole + (sizes * took).sum() - target) <= 1


def documents(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        source = rnd.choice(["b", "b", "b", "b", "a", "c", "é", None])
        rows.append((i, rnd.choice([None, " \n", "w " * rnd.randint(1, 30), "same words here"]), source, "x"))
    rows += [(7, "twin text", "a", "y")] * 3 + [(None, "no id", "c", "z")] * 2
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, target string").repartition(3)


def test_plan_takes_what_the_targets_say(spark):
    rows, docs = documents(spark)
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == sum(len((t or "").split()) for _, t, _, _ in rows)
    names = sorted({s for _, _, s, _ in rows if s is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s, _ in rows if s == n) for n in names]
    for n, size, target in zip(names, sizes, mixing.targets(sizes, [1 + i % 3 for i in range(len(names))], 3)):
        mine = [r for r in got if r.source == n]
        assert {r.source_size for r in mine} == {size} and {round(r.target, 6) for r in mine} == {round(target, 6)}
        assert abs(sum(r.taken for r in mine) - target) <= 2 and all(r.taken <= 3 * r.size for r in mine)
    again = mixing.plan(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixed_repeats_rows(spark):
    rows, docs = documents(spark)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = sum(len((r.text or "").split()) for r in out.collect())
    assert taken == sum(r.taken for r in mixing.plan(docs).collect())


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.plan(none).count() == 0 and mixing.mixed(none).count() == 0


def test_equal_rows_share_what_is_taken_of_them(spark):
    """A third of all rows are the same row, without a doc_id."""
    rows = [(None, "one and the same text", "b", 1, "x")] * 200 + [(i, f"text number {i} of the rest " + "w " * (i % 9), "abc"[i % 3], 2, "y") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies int, HASH string").repartition(5)
    plan = mixing.plan(docs).collect()
    again = sorted((str(r.doc_id), r.copies) for r in mixing.plan(docs.repartition(2)).collect())
    assert sorted((str(r.doc_id), r.copies) for r in plan) == again
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = Counter(r.doc_id for r in out.collect())
    assert got == Counter({d: n for d in {r.doc_id for r in plan} if (n := sum(r.copies for r in plan if r.doc_id == d))})
    for source in "abc":
        mine = [r for r in plan if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2 and max(r.copies for r in mine) <= 3


def test_rows_are_numbered_without_holding_a_key(spark):
    rows = spark.range(5000).selectExpr("id % 3 as k", "id as at")
    got = mixing.numbered(rows, ["k"]).collect()
    for k in range(3):
        assert sorted(r.place for r in got if r.k == k) == list(range(sum(r.k == k for r in got)))


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 2_000_000, "a"), (2, "b " * 10, "b"), (3, "", "c")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.plan(docs).collect()}
    assert got[1].size == 2_000_000 and got[2].size == 10 and got[3].taken == 0
