import random
import re

import public_tokenizers
import pytest

import corpus_pipeline
from lodestone.llm import bpe


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice(["ta", "ri", "mo", "ne", "su", "ke", "lo"]) for _ in range(rnd.randint(1, 4)))
    shared = " ".join(word() for _ in range(25))
    rows, labels = [], []
    for i in range(400):
        lines = [" ".join(word() for _ in range(rnd.randint(8, 40))) + "." for _ in range(rnd.randint(1, 5))]
        good = rnd.random() < 0.8
        if not good:
            lines = [x.upper().replace(" ", "!! ") for x in lines]
        if good and i % 9 == 0:
            lines.insert(0, shared)
        rows.append((i, "\n".join(lines), "en", f"s{i % 4}", 0))
        labels.append((i, int(good), 0))
    for i in range(20):
        source = rows[i * 7]
        rows.append((1000 + i, source[1] if i % 2 else source[1] + " tail", "en", "s1", 0))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s2", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, seen = docs.columns, [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/stage{i}.parquet")
        docs = spark.read.parquet(f"{folder}/stage{i}.parquet")
        assert i == 4 or docs.columns == names
        seen.append(docs.collect())
    start, good, lined, single, mixed, ids = seen
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    right = sum((d in kept) == bool(q) for d, q in quality.items())
    assert right >= 0.97 * len(quality)
    # no long line is left twice
    lines = [x.strip().lower() for r in lined for x in (r.text or "").split("\n") if len(x.strip()) >= 20]
    assert len(lines) == len(set(lines)) and {r.doc_id for r in lined} <= kept
    originals = {x.strip().lower() for r in good for x in (r.text or "").split("\n") if len(x.strip()) >= 20}
    assert set(lines) <= originals and len(lines) >= 0.9 * len(originals)
    # no two documents have 80 % of their shingles of five words in common
    grams = []
    for r in single:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").lower())
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    for i, a in enumerate(grams):
        for b in grams[:i]:
            assert not a or not b or len(a & b) < 0.8 * len(a | b)
    # the mix repeats whole documents, three times at most
    counts = {}
    for r in mixed:
        counts[r.doc_id, r.text] = counts.get((r.doc_id, r.text), 0) + 1
    assert max(counts.values()) <= 3 and set(counts) <= {(r.doc_id, r.text) for r in single}
    enc = bpe.encoding(corpus_pipeline.BYTE_RANKS, public_tokenizers.PATTERN)
    want = sorted((r.doc_id, enc.encode_ordinary(r.text or "")) for r in mixed)
    assert sorted((r.doc_id, list(r.ids)) for r in ids) == want and all(r.lossless and r.n_tokens == len(r.ids) for r in ids)


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids", "lossless"]
    assert out.count() == spark.read.parquet(f"{folder}/stage4.parquet").count()
