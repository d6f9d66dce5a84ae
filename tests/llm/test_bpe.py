import hashlib
import random

import public_tokenizers
import pytest

from lodestone.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", "a", "Hello, world's  end\n\n x\t\x1c!\x1c y\xa0 z", "é́ 日本語 テキスト 🙂🙂  ", "  　 a", "don't  stop \r\n\r\n now", "x" * 500 + " " * 40 + "y"]


@pytest.fixture(scope="module")
def enc():
    return bpe.encoding(PATH, public_tokenizers.PATTERN)


def test_safe_pieces_leave_the_ids_as_they_are(enc):
    rnd = random.Random(3)
    chars = "ab1 '.\n\t\r\x1c\x85\xa0 　é日s🙂-"
    some = TEXTS + ["".join(rnd.choice(chars) for _ in range(rnd.randint(1, 200))) for _ in range(400)]
    for text in some:
        for stretch in (1, 3, 17):
            assert "".join(bpe.safe_pieces(text, stretch)) == text
            assert bpe.encode(text, enc, stretch) == enc.encode_ordinary(text)


def test_round_trip(spark, enc):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate([None, *TEXTS, *TEXTS])], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.round_trip(rows, PATH, public_tokenizers.PATTERN).collect()}
    assert len(got) == 2 * len(TEXTS) + 1 and all(r.lossless for r in got.values())
    for i, text in enumerate([None, *TEXTS]):
        ids = enc.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    encoded = bpe.encode_documents(rows, PATH, public_tokenizers.PATTERN)
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode_ids(encoded, PATH, public_tokenizers.PATTERN).collect()}
    assert back[3] == TEXTS[2].encode() and back[0] == b""
    assert bpe.round_trip(rows.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
