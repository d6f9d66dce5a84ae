import random
import re

import numpy as np

from lodestone.llm import repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, window=8, least=8):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    grams = {}
    for i in range(n - window + 1):
        grams.setdefault(tuple(words[i : i + window]), []).append(i)
    hit = set()
    for spots in grams.values():
        if len(spots) > 1:
            hit |= {i + k for i in spots for k in range(window)}
    cover, longest = set(), 0
    for i in range(n):
        best = 0
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                best = max(best, k)
        if best >= least:
            cover |= set(range(i, i + best))
            longest = max(longest, best)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(cover), longest


def texts():
    rnd = random.Random(5)
    out = [None, "", " \n\t", "a", "a b a b a b a b a b a b a b a b a b a b a b", "é ü\x1cx\x85y z " * 9, "<a>|b|&#$%* " * 30]
    for _ in range(60):
        words = [rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.randint(1, 120))]
        text = " ".join(words)
        cut = text[rnd.randint(0, len(text)) :]
        out.append(rnd.choice(["", "x\n"]) + text + rnd.choice([" ", "\n", "\n\n"]) + cut + "\n" + rnd.choice([cut, "q q", ""]))
    return out


def test_measure_matches_brute_force():
    some = texts()
    got = repetition.measure(some)
    for text, row in zip(some, got.itertuples()):
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.n_covered, row.longest_repeat) == brute(text), text


def test_one_text_matches_nothing_in_another():
    text = " ".join(f"w{i}" for i in range(100))
    got = repetition.measure([text, text])
    assert got.kept.all() and not got.n_covered.any()


def test_verdicts():
    clean = " ".join(f"w{i}" for i in range(300))
    twice = clean + " " + clean
    got = repetition.measure(["too short", clean, twice, clean + " " + " ".join(f"w{i}" for i in range(70))])
    assert got.base_failed.tolist() == [True, False, True, True]
    assert got.kept.tolist() == [False, True, False, False]


def test_judge_takes_nulls_extra_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None, "x"), (1, "a b", "y"), (None, "a b", "z")], "doc_id long, text string, n_words string")
    got = repetition.judge(rows).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.kept) for r in got) == [(-1, 2, False), (1, 0, False), (1, 2, False)]
    assert repetition.judge(rows.limit(0)).count() == 0


def test_one_text_of_a_million_words_needs_little_memory():
    import tracemalloc

    for text, longest in (("same " * 1_000_000, 999_999), ("a b c d e f g " * 150_000, 1_049_993)):
        words = text.split()
        keys = np.unique(words, return_inverse=True)[1]
        tracemalloc.start()
        match = repetition.longest_matches(keys, np.zeros(len(keys), np.int64), 8)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert match.max() == longest and peak < 120 * len(words)


def test_agreeing_places():
    rnd = np.random.default_rng(4)
    keys = np.repeat(rnd.integers(0, 3, 40), rnd.integers(1, 300, 40))
    a, b = rnd.integers(0, len(keys), 500), rnd.integers(0, len(keys), 500)
    want = []
    for x, y in zip(a, b):
        k = 0
        while max(x, y) + k < len(keys) and keys[x + k] == keys[y + k]:
            k += 1
        want.append(k)
    assert repetition.agreeing(keys, a, b).tolist() == want
    assert repetition.agreeing(keys, a[:30], b[:30]).tolist() == want[:30]
