import random

import numpy as np
import pytest

from lodestone.llm import line_dedup as ld

HOW = ld.Lines()


def shingles(line):
    return {line[i : i + HOW.shingle] for i in range(max(1, len(line) - HOW.shingle + 1))}


def brute(rows, how=HOW):
    """Kept text of each distinct (doc_id, text), lines by plain union-find over all pairs."""
    docs = sorted({(d is not None, d or 0, t) for d, t in rows if t is not None}, key=lambda x: (x[0], x[1]))
    lines = [(i, n, x, x.strip(" ").lower()) for i, (_, _, t) in enumerate(docs) for n, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[3]) >= how.least]
    texts = sorted({x[3] for x in lines})
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 100 * shared >= how.percent * len(sets[i] | sets[j]):
                up[max(find(i), find(j))] = min(find(i), find(j))
    place = {t: i for i, t in enumerate(texts)}
    return docs, lines, lambda text: find(place[text])


def corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    bases = [[word() for _ in range(rnd.randint(5, 60))] for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            words = list(rnd.choice(bases))
            if len(words) > 30 and rnd.random() < 0.5:
                words[rnd.randrange(len(words))] = word()
            lines.append(rnd.choice(["", "  "]) + rnd.choice([" ".join(words), " ".join(words).upper(), "short", "", " ".join(word() for _ in range(9))]))
        rows.append((i, "\n".join(lines)))
    return rows + [(100, None), (101, ""), (None, rows[0][1]), (5, rows[5][1]), (5, rows[5][1]), (102, "x" * 5000), (103, "x" * 5000), (104, "é ü " * 30)]


def test_every_removed_line_resembles_one_that_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "en", 7) for d, t in rows], "doc_id long, text string, lang string, n_removed int").repartition(4)
    out = ld.dedup(docs)
    assert out.columns == ["doc_id", "text", "lang", "n_lines", "n_removed", "n_near"]
    got = out.collect()
    truth, lines, group = brute(rows)
    assert len(got) == len(set(rows))
    kept = {}
    for r in got:
        for x in (r.text or "").split("\n"):
            if len(x.strip(" ")) >= HOW.least:
                kept.setdefault(group(x.strip(" ").lower()), []).append(r.doc_id)
    groups = {group(x[3]) for x in lines}
    assert set(kept) == groups  # every component keeps a line
    # and only one, but for pairs that the bands may miss
    assert sum(len(v) - 1 for v in kept.values()) <= 1
    first = {}
    for i, n, _, text in lines:
        first.setdefault(group(text), i)
    for g, ids in kept.items():
        assert ids[0] == (truth[first[g]][1] if truth[first[g]][0] else None) or len(ids) > 1
    total = sum(r.n_lines - r.n_removed for r in got if r.text is not None)
    assert total == sum(len(r.text.split("\n")) for r in got if r.text and r.n_lines > r.n_removed) + sum(1 for r in got if r.text == "" and r.n_lines > r.n_removed)
    same = {r.doc_id: r for r in got}
    assert same[100].text is None and same[101].text == "" and same[103].n_removed == 1 and same[103].text == ""


def test_empty(spark):
    assert ld.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs_of_lines_that_share_a_passage(spark):
    """Families of two in a crowd whose lines all hold the same passage."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    passage, lines = [word() for _ in range(60)], []
    for _ in range(500):
        own = [word() for _ in range(30)]
        lines += [" ".join(passage + own), " ".join(passage + own[:-1] + [word()])]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    got = ld.dedup(docs).where("n_removed = 1").select("doc_id").collect()
    assert {r.doc_id for r in got} == set(range(1, 1000, 2))


@pytest.mark.parametrize("block", [3, 256])
def test_links_between_components_of_a_bucket(spark, block):
    """All pairs of different components against brute force; of a component only one link to another is needed."""
    rnd = random.Random(4)
    base = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(120))
    lines = []
    for i in range(40):
        at = rnd.sample(range(120), rnd.choice([0, 1, 2, 3]))
        lines.append("".join("#" if k in at else c for k, c in enumerate(base)) + str(i))
    members = spark.createDataFrame([(1, i, i % 30) for i in range(40)] + [(2, i, 5) for i in range(9)], "key long, a long, component long")
    texts = spark.createDataFrame(list(enumerate(lines)), "a long, line string")
    got = {(r.a, r.b) for r in ld.links_between(members, texts, ld.Lines(block=block)).collect()}
    sets = [shingles(x) for x in lines]
    linked = {(i, j) for i in range(40) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}

    def parts(pairs):
        up = list(range(30))
        for i, j in pairs:
            x, y = up[i % 30], up[j % 30]
            up = [min(x, y) if u in (x, y) else u for u in up]
        return up

    assert got <= linked and parts(got) == parts(linked)


def test_shingles_are_taken_at_every_position():
    lines = ["repeated repeated repeated", "é𝄞 and more", "short", "", "字" * 3 + "abcdefg"]
    for size in (1, 3, 5, 8):
        how = ld.Lines(shingle=size)
        want = [{x[i : i + size] for i in range(max(1, len(x) - size + 1))} for x in lines]
        assert [len(x) for x in ld.shingle_sets(lines, how)] == [len(w) for w in want]
        found, count = ld.shingles(lines, how)
        assert count.tolist() == [max(1, len(x) - size + 1) for x in lines]
        one = dict(zip([x[i : i + size] for x in lines for i in range(max(1, len(x) - size + 1))], found.tolist()))
        assert len(set(one.values())) == len(one)
        ends = np.cumsum(count)
        assert all(set(found[e - c : e].tolist()) == {one[g] for g in w} for e, c, w in zip(ends, count, want))


def test_signatures_agree_as_often_as_sets_do():
    rnd = random.Random(7)
    pairs = []
    for _ in range(300):
        a = [rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)]
        b = [*a]
        for at in rnd.sample(range(300), 3):
            b[at] = "#"
        pairs.append(("".join(a), "".join(b)))
    like = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in pairs]
    one, two = (ld.signatures([p[k] for p in pairs], HOW, 32) for k in (0, 1))
    assert abs((one == two).mean() - np.mean(like)) < 0.02
    keys = [ld.band_keys(x, 4, 8) for x in (one, two)]
    assert abs((keys[0] == keys[1]).mean() - np.mean(np.array(like) ** 4)) < 0.05
    # a signature's bins hold the least hash of the bin, or of the next that holds one
    few = ld.signatures(["a line of few"], HOW, 32)[0]
    assert set(few.tolist()) == set(ld.shingle_sets(["a line of few"], HOW)[0].tolist())


def test_one_edit_in_a_line_without_blanks(spark):
    """Han characters, base64-like runs and ordinary lines with one character or word changed."""
    rnd = random.Random(3)
    run = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    pairs = []
    for i in range(40):
        han = run([chr(0x4E00 + k) for k in range(500)], 150)
        code = run("abcdefghijklmnopqrstuvwxyz0123456789+/", 150)
        words = [run("abcdefghijklmnopqrstuvw", rnd.randint(3, 8)) for _ in range(25)]
        other = [*words]
        other[rnd.randrange(25)] = run("abcdefghijklmnopqrstuvw", 5)
        pairs += [(han, han[:9] + "字" + han[9:]), (code, code[:5] + "x" + code[5:]), (" ".join(words), " ".join(other))]
    fit = [len(shingles(a) & shingles(b)) * 100 >= 80 * len(shingles(a) | shingles(b)) for a, b in pairs]
    rows = [(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)]
    gone = {r.doc_id for r in ld.dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("n_near = 1").collect()}
    assert gone <= {2 * i + 1 for i, f in enumerate(fit) if f}
    assert len(gone) >= 0.95 * sum(fit) and sum(fit) > 100


def test_bands_keep_their_recall_as_the_corpus_grows():
    for n in (0, 1000, 10**6, 10**9, 10**12):
        rows, bands = HOW.banding(n)
        assert (1 - 0.8**rows) ** bands <= HOW.miss and rows >= 4
    assert HOW.banding(10**12)[0] > HOW.banding(10**6)[0]


def test_a_crowd_of_near_copies_becomes_one_line(spark):
    """Copies of one line with different words changed: many pairs of them don't link, but all link with the original."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    base = [word() for _ in range(60)]
    rows = [(i, " ".join(base)) for i in range(3)]
    for i in range(300):
        other = [*base]
        for at in rnd.sample(range(60), 2):
            other[at] = word()
        rows.append((10 + i, " ".join(other)))
    got = ld.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got.where("text <> ''").count() == 1


def test_clashing_names_repeated_rows_and_long_texts(spark):
    line = "this line is long enough to be compared with others of its kind"
    rows = [(1, line, 1, 2, "a", 3, "b"), (1, line, 1, 2, "a", 3, "b"), (2, line + "\n" + line, 1, 2, "a", 3, "b"), (None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int, key int, N_NEAR string, _doc int, special string")
    got = ld.dedup(docs)
    assert got.columns == ["doc_id", "text", "gone", "key", "_doc", "special", "n_lines", "n_removed", "n_near"]
    assert sorted((r.doc_id or 0, r.text, r.n_removed) for r in got.collect()) == [(0, None, 0), (1, line, 0), (2, "", 2)]
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcdefghijklmnopqrst ") for _ in range(2_000_000))
    many = "\n".join(f"{i} is a number of a line among many others" for i in range(1_000))
    docs = spark.createDataFrame([(1, long), (2, long), (3, many + "\n" + long)], "doc_id long, text string")
    out = {r.doc_id: r for r in ld.dedup(docs).collect()}
    assert out[1].text == long and out[2].text == "" and out[3].n_removed >= 1 and long not in out[3].text


def test_cleaned_keeps_the_columns(spark):
    line = "this line is long enough to be compared with others of its kind"
    rows = [(1, line, 63, 7), (2, line, 63, 8), (3, line + "\nshort", 99, 9), (4, None, None, 1), (5, "", 0, 2), (6, " ", 1, 3)]
    out = ld.cleaned(spark.createDataFrame(rows, "doc_id long, text string, N_chars int, n_removed int"))
    assert out.columns == ["doc_id", "text", "N_chars", "n_removed"] and out.schema["N_chars"].dataType.simpleString() == "int"
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == [(1, line, 63, 7), (3, "short", 5, 9), (4, None, None, 1), (5, "", 0, 2), (6, " ", 1, 3)]


def test_sets_and_signatures_of_many_lines_are_those_of_each():
    rnd = random.Random(6)
    lines = ["".join(rnd.choice("abcdefgh é字") for _ in range(rnd.choice([0, 3, 8, 40, 400]))) for _ in range(500)] + ["ab" * 100_000, "x"]
    assert sum(map(len, lines)) > 3 * ld.PIECE and ld.shingle_sets([], HOW) == [] and len(ld.signatures([], HOW, 32)) == 0
    sets, signs = ld.shingle_sets(lines, HOW), ld.signatures(lines, HOW, 32)
    for line, found, sign in zip(lines, sets, signs):
        assert np.array_equal(found, np.unique(ld.shingles([line], HOW)[0]))
        assert np.array_equal(sign, ld.signatures([line], HOW, 32)[0])


def test_small_units_share_a_batch(spark, monkeypatch):
    """Thousands of buckets of three give a few batches of links, not one each."""
    made = []
    monkeypatch.setattr(ld, "map_arrow", lambda df, fn, schema: made.append((df, fn)))
    members = spark.createDataFrame([(u, 3 * u + k, 3 * u + k) for u in range(3000) for k in range(3)], "key long, a long, component long")
    texts = spark.createDataFrame([(3 * u + k, f"line {u} of a crowd of many lines that are all alike, number {u}" + "." * k) for u in range(3000) for k in range(3)], "a long, line string")
    ld.links_between(members, texts, HOW)
    df, fn = made[0]
    out = list(fn(df.coalesce(1).sortWithinPartitions("unit", "one", "two").toArrow().to_batches()))
    links = {(a, b) for x in out for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist())}
    assert len(out) <= 10 and all(a // 3 == b // 3 for a, b in links) and len({a for a, _ in links} | {b for _, b in links}) == 9000
