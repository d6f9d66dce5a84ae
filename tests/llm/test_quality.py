import random
import zlib

import numpy as np

from lodestone.llm import quality


def corpus(spark, n=900):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(["ta", "ri", "mo", "ne", "su", "ke"]) for _ in range(rnd.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(5, 80))]
        bad = rnd.random() < 0.2
        if bad:
            words = rnd.choice([lambda w: [x.upper() + "!!" for x in w], lambda w: [x + "***" for x in w], lambda w: [w[0]] * len(w)])(words)
        docs.append((i, " ".join(words) + ".", "x"))
        labels.append((i, int(not bad), 0))
    docs += [(n, None, "y"), (n + 1, "", "z"), (None, "no id", "w"), (0, docs[0][1], "q")]
    labels += [(n + 5, 1, 0), (None, 0, 0), (3, None, 0), (5, 7, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: q for i, q, _ in labels[:n]}


def test_held_out_documents(spark):
    docs, labels, truth = corpus(spark)
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    mine = [r for r in got if r.doc_id is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in mine)
    held = [r for r in mine if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    again = {(r.doc_id, r.score) for r in quality.classify(docs.repartition(5), labels).collect()}
    assert {(d, round(s, 9)) for d, s in again} == {(r.doc_id, round(r.score, 9)) for r in got}


def test_held_out_labels_change_nothing(spark):
    docs, labels, _ = corpus(spark, 300)
    rows = labels.collect()
    turned = [(r.doc_id, 1 - r.quality if r.quality in (0, 1) and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.quality, r.toxic) for r in rows]
    other = spark.createDataFrame(turned, labels.schema)
    score = lambda x: sorted((r.doc_id or -1, r.score) for r in quality.classify(docs, x).collect())
    assert score(labels) == score(other)


def test_few_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, ones).collect()} == {1.0}
    assert quality.classify(docs.limit(0), none).count() == 0
    assert quality.scored(docs.withColumn("z", docs.doc_id), quality.train(docs, ones)).columns == ["doc_id", "text", "z", "score"]


def test_contexts_are_those_of_all_documents(spark):
    """The table of contexts against plain counting, word by word."""
    s = quality.Settings(rows=64, width=6, ones=2)
    texts = ["a b c a b", "b", "", None, "c c d 7 !!", "e f g h i j k l m n o p"] * 3
    got = quality.contexts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), s)
    index, codes, want = quality.index_vectors(64, s), quality.Codes(), np.zeros((64, 6))
    for t in texts:
        rows = quality.word_rows(codes.of(quality.tokens(t)), s)
        for i, x in enumerate(rows):
            for j in range(max(0, i - s.reach), min(len(rows), i + s.reach + 1)):
                want[x] += index[rows[j]] if i != j else 0
    assert np.allclose(got, want)


def test_score_on_fixed_weights(spark):
    """Scores of the operator against the formula, a word at a time."""
    s = quality.Settings(rows=32, width=4, ones=2, hidden=3)
    rng = np.random.default_rng(1)
    words, shapes, size = rng.standard_normal((32, 12)), rng.standard_normal((256, 12)), 12 + quality.FIGURES
    net = quality.Network(rng.standard_normal(size), np.ones(size) * 2, rng.standard_normal((size, 3)), rng.standard_normal(3), rng.standard_normal(3), 0.3, 1.7)
    model = quality.Model(words, shapes, net, 0.5, s)
    rows = [(1, "one two two one", 5), (2, None, 6), (3, "x", 7)]
    got = {r.doc_id: r.score for r in quality.scored(spark.createDataFrame(rows, "doc_id long, text string, SCORE int"), model).collect()}
    for d, text, _ in rows:
        t = (text or "").split()
        x = np.zeros(size)
        for w in t:
            code = quality.Codes()[w]
            x[:12] += (words[code >> 8 & 31] + shapes[code & 255]) / len(t)
        if t:
            x[12:] = np.log1p(len(t)), len(set(t)) / len(t), np.mean([w in t[max(0, i - 2) : i] for i, w in enumerate(t)])
        assert abs(got[d] - net.probabilities(x[None])[0]) < 1e-9


def test_clashing_names_and_a_very_long_text(spark):
    docs, labels, _ = corpus(spark, 200)
    long = spark.createDataFrame([(5000, "ta ri mo " * 1_000_000, "x")], docs.schema)
    docs = docs.unionByName(long).withColumnRenamed("score", "SCORE").selectExpr("*", "1 as _row", "doc_id as y")
    out = quality.scored(docs, quality.train(docs, labels))
    assert out.columns == ["doc_id", "text", "_row", "y", "score"]
    got = {r.doc_id: r.score for r in out.select("doc_id", "score").collect()}
    assert 0 <= got[5000] <= 1 and len(got) > 200
