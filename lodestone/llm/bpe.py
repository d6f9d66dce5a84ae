"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at safe boundaries before they are handed to the library: places where
a character that is not white space is followed by one that is. No alternative of the
split pattern runs from the one into the other, and its look-ahead only looks past white
space, so the matches on the two sides are those of the whole text. Decoding works on raw
bytes, which keeps ids that end inside a character.

Defined results: a null text counts as empty and has no ids, the digests of empty strings;
repeated rows are encoded once each; extra columns are not read; a text of any length is
encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The white space of the pattern's \s class (fixed values: Unicode's White_Space property).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
#: Texts longer than this many characters are cut at the first safe boundary after each such stretch.
STRETCH = 1 << 16

#: Characters of texts that are encoded together; their ids are Python integers for a while, which take most memory.
PIECE = 250_000

_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The library's encoder for a rank file; made once in each Python process."""
    key = (path, pattern)
    if key not in _encodings:
        _encodings[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    return _encodings[key]


def safe_pieces(text: str, stretch: int = STRETCH) -> Iterator[str]:
    """Cut a text at safe boundaries, each at least `stretch` characters behind the last; joined, the pieces are the text."""
    start = 0
    while len(text) - start > stretch:
        cut = _SAFE.search(text, start + stretch)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode(text: str | None, enc: tiktoken.Encoding, stretch: int = STRETCH) -> list[int]:
    if not text:
        return []
    if len(text) <= stretch:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in safe_pieces(text, stretch):
        ids.extend(enc.encode_ordinary(piece))
    return ids


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): every whole text as ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in common.small_batches(batches, "text", PIECE):
            ids = [encode(t, enc) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.map_arrow(rows, run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes binary): the raw bytes of each row's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            out = [enc.decode_bytes(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return common.map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, lossless: encode and decode again in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in common.small_batches(batches, "text", PIECE):
            counts, ids_sha, back_sha, same = [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = encode(text, enc)
                back = enc.decode_bytes(ids)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                back_sha.append(hashlib.sha256(back).hexdigest())
                same.append(back == (text or "").encode())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string()), pa.array(same, pa.bool_())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.map_arrow(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")


def checked(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids and lossless: encoded, and whether decoding gives the text's bytes again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in common.small_batches(batches, "text", PIECE):
            texts = batch.column("text").to_pylist()
            ids = [encode(t, enc) for t in texts]
            same = [enc.decode_bytes(i) == (t or "").encode() for i, t in zip(ids, texts)]
            counts = [len(i) for i in ids]
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "lossless"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.map_arrow(rows, run, "doc_id long, n_tokens long, ids array<int>, lossless boolean")
