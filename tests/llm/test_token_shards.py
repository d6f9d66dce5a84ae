import random
import struct
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lodestone.llm import token_shards as ts

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_chunks_give_the_ids_of_the_whole_text():
    enc, lib = ts.ChunkEncoder(PATH, remembered=50), Tokenizer.from_file(PATH)
    lib.encode_special_tokens = True
    assert enc.direct and enc.width == 2
    rnd = random.Random(1)
    letters = "aZé́ßÀÿªµ.,'s’ΣσςİıⅨ1٣日🙂\x01\x1c\x85\xa0  \n\t<|endoftext|>$*"
    texts = [None, "", "Hello, world's end***", "<|endoftext|>"] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40))) for _ in range(800)]
    for text, got in zip(texts, enc.encode(texts), strict=True):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert got == struct.pack(f"<{len(ids)}H", *ids), text


def test_perfect_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 63, 1000, 20_000):
        keys = ts.mix(np.arange(n, dtype=np.uint64), 3)
        assert sorted(ts.PerfectHash.build(keys).slots(keys)) == list(range(n))


def test_shard_finds_its_keys_only():
    ids = [None, None, -5, 0, 7, 7, 9]
    payloads = [struct.pack(f"<{k}I", *range(k)) for k in range(len(ids))]
    shard = ts.Shard(ts.pack_shard(ids, payloads, 0, 0)[0])
    assert [len(x) for x in shard.get(7)] == [4, 5] and [len(x) for x in shard.get(None)] == [0, 1]
    assert shard.get(9)[0].tolist() == list(range(6))
    assert not any(shard.get(k) for k in range(10, 500)) and not ts.Shard(ts.pack_shard([], [], 0, 0)[0]).get(1)


def rows():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab cd. ") for _ in range(rnd.randint(0, 90))) for _ in range(300)]
    out = [(i * 3, t, 1) for i, t in enumerate(texts)]
    return out + [(None, None, 2), (None, "x y", 3), (6, "again", 4), (6, "again", 5), (11, None, 6)]


def test_files_hold_every_document_in_order(spark, tmp_path):
    made = rows()
    random.Random(4).shuffle(made)
    docs = spark.createDataFrame(made, "doc_id long, text string, start int").repartition(5)
    path = f"file://{tmp_path}/shards"
    ts.write(docs, path, PATH, shard_ids=500)
    got = ts.read(spark, path).collect()
    assert len(got) == len(made) and len({(r.part, r.seq) for r in got}) > 3
    lib = Tokenizer.from_file(PATH)
    ids = [lib.encode(t or "", add_special_tokens=False).ids + [2] for _, t, _ in made]
    want = sorted((-1 if d is None else d, len(i), zlib.crc32(struct.pack(f"<{len(i)}I", *i))) for (d, _, _), i in zip(made, ids))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at, last = 0, -1
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (r.doc_id if r.doc_id is not None else -1) >= last
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else -1
    found = ts.fetch(spark, path, [6, None, 4444]).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in found) == [-1, -1, 6, 6, 6]
    for key in (6, None, 4444, 9, 33):
        mine = sorted(i for (d, _, _), i in zip(made, ids) if d == key)
        assert sorted(x.tolist() for x in ts.get(spark, path, key)) == mine
    lines = ts.manifest(spark, path).orderBy("base").collect()
    assert [r.base for r in lines] == [sum(x.n_ids for x in lines[:i]) for i in range(len(lines))]


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    ts.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert ts.read(spark, path).count() == 0 and ts.get(spark, path, 1) == [] and ts.fetch(spark, path, [1, None]).count() == 0


def test_keyed_access_reads_ranges_only():
    docs = list(range(0, 60_000, 3))
    payloads = [struct.pack("<50I", *range(i, i + 50)) for i in docs]
    blob, _ = ts.pack_shard(docs, payloads, 0, 0)
    taken = []

    def read(at, size):
        taken.append(size)
        return blob[at : at + size]

    assert [x.tolist() for x in ts.look_up(read, 30_000)] == [list(range(30_000, 30_050))]
    assert len(taken) <= 8 and sum(taken) < 0.01 * len(blob)
    assert ts.look_up(read, 30_001) == [] and ts.look_up(read, None) == []


def test_a_very_long_text(spark, tmp_path):
    text = "some words and 12345 numbers, " * 400_000
    path = f"file://{tmp_path}/long"
    ts.write(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"), path, PATH, shard_ids=1000)
    got = {r.doc_id: r for r in ts.read(spark, path).collect()}
    (ids,) = ts.get(spark, path, 1)
    assert got[1].n_tokens == len(ids) and zlib.crc32(ids.tobytes()) == got[1].ids_crc32
    few = Tokenizer.from_file(PATH).encode(text[:300], add_special_tokens=False).ids
    assert ids.tolist() == few * (len(text) // 300) + [2]
