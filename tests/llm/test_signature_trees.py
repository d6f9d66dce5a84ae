import random
import re
from itertools import combinations

import numpy as np
import pytest

from lodestone.llm import signature_trees as st

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        shared = len(sets[i] & sets[j])
        if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
            up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def corpus(seed=1, families=14):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    passage = " ".join(word() for _ in range(30))
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rnd.choice([2, 3, 9, 40, 120]))]
        for _ in range(rnd.choice([1, 2, 6])):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                words[rnd.randrange(len(words))] = word()
            text = " ".join(words)
            rows.append(rnd.choice([text, text.upper(), text + "\n", passage + "\t" + text]))
    rows += [None, "", " \n", "one", "ONE", passage, "é É", "a b c d e f g"]
    out = [(i, t) for i, t in enumerate(rows)]
    return out + [(3, rows[5]), (3, rows[5]), (None, rows[6]), (None, "lonely words of no id")]


def proposed(bits, sizes, join, side=None):
    out = set()
    st.candidates(bits, sizes, join, np.arange(len(sizes)), lambda a, b, share: out.update(map(frozenset, zip(a.tolist(), b.tolist()))), side)
    return out


def test_trees_find_every_pair_that_links():
    rnd = random.Random(2)
    for percent in (60, 80, 85, 95):
        join = st.Join(words=1, percent=percent)
        universe = [rnd.getrandbits(64) for _ in range(400)]
        sets = []
        for _ in range(150):
            base = rnd.sample(universe, rnd.randint(1, 60))
            sets += [np.array(sorted(set(base[: len(base) - cut] + rnd.sample(universe, cut))), np.uint64) for cut in (0, min(1, len(base) - 1), min(3, len(base) - 1))]
        bits, sizes = [st.bitmap(s) for s in sets], np.array([len(s) for s in sets])
        got = proposed(bits, sizes, join)
        linked = {frozenset((i, j)) for i, j in combinations(range(len(sets)), 2) if 100 * (x := len(np.intersect1d(sets[i], sets[j]))) >= percent * (len(sets[i]) + len(sets[j]) - x)}
        assert linked <= got and len(got) < 20_000
        side = np.array([i % 2 for i in range(len(sets))])
        got = proposed(bits, sizes, join, side)
        assert {p for p in linked if len({side[i] for i in p}) == 2} <= got


def test_trees_of_several_levels_pass_over_what_can_not_link():
    rnd = random.Random(4)
    join = st.Join(words=1, percent=85)
    sets = [np.array(sorted(rnd.getrandbits(64) for _ in range(rnd.randint(33, 64))), np.uint64) for _ in range(1500)]
    sets += [np.sort(np.append(s[1:], np.uint64(rnd.getrandbits(64)))) for s in sets[:20]]
    bits, sizes = [st.bitmap(s) for s in sets], np.array([len(s) for s in sets])
    at = np.array([len(b) for b in bits])
    tree = st.SignatureTree(np.stack([b for b in bits if len(b) == at[0]]), sizes[at == at[0]], np.flatnonzero(at == at[0]))
    assert len(tree.levels) > 3
    looked = []
    st.dual(tree, None, join, lambda a, b: looked.append(len(a) * len(b) if len(a) <= st.LEAF else 0) or True, lambda *x: None)
    got = proposed(bits, sizes, join)
    assert {frozenset((i, 1500 + i)) for i in range(20)} <= got and len(got) < 60
    assert sum(looked) < len(tree.members) ** 2 / 2


@pytest.mark.parametrize("block", [7, 2048])
def test_a_crowd_of_near_copies(spark, block):
    """Copies of one text with words changed, many of them twice, and texts that share a passage with all."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    rows = [(i, " ".join(base)) for i in range(30)]
    for i in range(60):
        other = [*base]
        for at in rnd.sample(range(120), rnd.choice([1, 2])):
            other[at] = word()
        rows += [(100 + i, " ".join(other))] * rnd.choice([1, 2])
    rows += [(300 + i, " ".join(base[:60] + [word() for _ in range(rnd.choice([5, 9, 60]))])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = st.component_table(docs, st.Join(4, 85, block)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 4, 85))


def test_clashing_names_and_very_long_texts(spark):
    rnd = random.Random(9)
    text = " ".join(str(rnd.randrange(10**6)) for _ in range(700_000))
    rows = [(1, text, 1, "a", 2, 3), (2, text + " end", 1, "b", 2, 3), (3, "short text of five words here", 1, "c", 2, 3), (None, None, None, None, None, None), (4, "short text of five words here", 1, "d", 2, 3), (4, "short text of five words here", 1, "d", 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, KEY long, _row string, th long, cid long")
    got = st.representatives(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r._row or "") for r in got.collect()) == [(0, ""), (1, "a"), (3, "c")]
    assert len(text) > 4_000_000


@pytest.mark.parametrize(("words", "percent", "block"), [(4, 85, 2048), (5, 80, 2048), (2, 60, 3)])
def test_components_match_brute_force(spark, words, percent, block):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, component_id string, n int").repartition(4)
    got = st.component_table(docs, st.Join(words, percent, block)).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(key((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(map(key, brute(rows, words, percent)))


def test_one_document_of_each_component_stays(spark):
    rows = corpus(3, 8)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, lang string").repartition(3)
    kept = st.representatives(docs, st.Join(4, 85)).collect()
    truth = brute(rows, 4, 85)
    groups = {c for d, n, c in truth if n and c is not None}
    lonely = sum(1 for d, n, c in truth if n and c is None)
    empty = sum(1 for _, n, _ in truth if not n)
    assert len(kept) == len(groups) + lonely + empty
    assert {r.doc_id for r in kept if WORD.search(r.text or "") and r.doc_id is not None} == groups


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert st.component_table(none).count() == 0 and st.representatives(none).count() == 0


def test_percentages_that_the_widths_do_not_cover_are_refused():
    for percent in (0, 50, 101):
        with pytest.raises(ValueError):
            st.Join(percent=percent)
