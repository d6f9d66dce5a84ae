"""Token-id shards with a minimal perfect hash index.

Documents are dealt out by ranges of doc_id, encoded, and written as raw files. A shard is

    magic, JSON header with the sections' places (space-padded to HEADER bytes), then
    ids       the raw payload, documents one after another in ascending doc_id; uint16 where
              the vocabulary has at most 65,536 ids, else uint32
    starts    uint64, n_docs + 1 places in ids
    keys      int64 doc_id of every document, and a byte that is 1 where it is null
    levels    the index: bit arrays of uint64 words, one level after another
    prints    uint32 fingerprint of every slot's key
    slots     uint32 first document and number of documents of every slot's key

all little-endian. The index is a minimal perfect hash: each level hashes the keys left over
into twice as many bits and keeps the ones that are alone in their bit; a key's slot is the
number of bits set before its own. A lookup costs a few hashes however many keys there are,
and the fingerprint turns unknown keys away. Beside the shards lies a manifest, one JSON
line a shard.

Files go through Spark's own writer, so they reach any file system that Spark does and a
lost or repeated task leaves no half shard. A shard ends at SHARD_IDS ids; only a single
longer document makes a larger one.

Defined results: a null text counts as empty, a document of the end id alone; null doc_ids
come first and are found by the key None; documents of one doc_id lie side by side under one
slot; repeated rows are kept; an empty table gives no shard and no rows; extra columns are
not read.
"""

from __future__ import annotations

import json
import os
import string
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MAGIC = b"LODEIDS1"
HEADER = 1024
#: Ids after which a shard is closed (4 or 8 MB of payload).
SHARD_IDS = 1 << 21
#: Chunks between white space whose ids a worker remembers.
REMEMBERED = 1_000_000
#: ASCII marks but the apostrophe, at which the tokenizer may split.
MARKS = string.punctuation.replace("'", "")
NULL_KEY = np.uint64(0x9E3779B97F4A7C15)


# --- encoding ---------------------------------------------------------------------------


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)]


class ChunkEncoder(dict):
    """Packed ids of texts, by way of their chunks between ASCII white space; chunks met before are remembered.

    The tokenizer normalizes, drops white space and splits before it merges, and none of that
    reaches across ASCII white space; so a text's ids are its chunks' ids in a row. Where the
    tokenizer lowers letters and splits at their runs, a chunk of Latin-1 letters, with marks behind,
    goes to the library's merges directly; any other chunk goes through the library's whole course. Strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.remembered = remembered
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.letters = _byte_letters()
        self.merge = self.tokenizer.model.tokenize
        self.ends: dict[str, list[int]] = {}
        self.direct = self._lowers_and_splits()

    @property
    def width(self) -> int:
        return struct.calcsize(f"<{self.kind}")

    def _lowers_and_splits(self) -> bool:
        """Whether the shortcut gives the library's ids, tried on words of all letters that may take it."""
        letters = [chr(c) for c in range(256) if chr(c).isalpha()]
        tried = ["a" + x + "b" + end for x in letters for end in ("", ".", ",.", "...", MARKS, "!!", "$$$")] + ["".join(letters), "ABC", "xyz,"]
        return all(self._short(w) == self._whole(w) for w in tried)

    def _whole(self, chunk: str) -> list[int]:
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def _short(self, chunk: str) -> list[int] | None:
        core = chunk.rstrip(MARKS)
        if not core.isalpha():
            return None
        end = chunk[len(core) :]
        if core.isascii():
            core = core.lower()
        elif max(core) > "\xff":
            return None
        else:
            core = "".join(map(self.letters.__getitem__, core.lower().encode()))
        ids = [t.id for t in self.merge(core)]
        if end:
            if end not in self.ends:
                self.ends[end] = [t.id for t in self.merge(end)]
            ids += self.ends[end]
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        ids = self._short(text) if self.direct else None
        if ids is None:
            ids = self._whole(text)
        packed = self[chunk] = struct.pack(f"<{len(ids)}{self.kind}", *ids)
        return packed

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self) > self.remembered:
            self.clear()
            self.ends.clear()
        return [b"".join(map(self.__getitem__, (t or "").encode().split())) for t in texts]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file in a Python process, so that later tasks find its chunks remembered."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


# --- the minimal perfect hash -----------------------------------------------------------


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finalizer; a bijection for each seed."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """bits: all levels' words in a row; places: where each level begins, in words."""

    bits: np.ndarray
    places: list[int]

    def __post_init__(self) -> None:
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits).astype(np.int64))])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """For distinct uint64 keys."""
        left, levels, places = keys, [], [0]
        while len(left):
            words = max(1, -(-2 * len(left) // 64))
            spot = mix(left, len(levels)) % np.uint64(64 * words)
            held = np.bincount(spot.astype(np.int64), minlength=64 * words)
            alone = held[spot.astype(np.int64)] == 1
            level = np.zeros(words, np.uint64)
            mine = spot[alone]
            np.bitwise_or.at(level, (mine >> np.uint64(6)).astype(np.int64), np.uint64(1) << (mine & np.uint64(63)))
            levels.append(level)
            places.append(places[-1] + words)
            left = left[~alone]
        return cls(np.concatenate(levels) if levels else np.zeros(0, np.uint64), places)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those that no level holds; unknown keys may get any slot."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (at, end) in enumerate(zip(self.places, self.places[1:])):
            if not len(left):
                break
            spot = mix(keys[left], k) % np.uint64(64 * (end - at))
            word = at + (spot >> np.uint64(6)).astype(np.int64)
            bit = np.uint64(1) << (spot & np.uint64(63))
            hit = (self.bits[word] & bit) != 0
            below = np.bitwise_count(self.bits[word[hit]] & (bit[hit] - np.uint64(1))).astype(np.int64)
            out[left[hit]] = self.before[word[hit]] + below
            left = left[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def hashed_keys(doc_ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """uint64 keys, distinct for distinct doc_ids; null is told apart by its fingerprint and checked by the null byte."""
    return np.where(null, NULL_KEY, mix(doc_ids.astype("<i8").view("<u8"), 7))


# --- the file format --------------------------------------------------------------------


def pack_shard(doc_ids: list[int | None], payloads: list[bytes], part: int, seq: int, width: int = 4) -> tuple[bytes, dict]:
    """The bytes of a shard of documents in order, and its line for the manifest."""
    null = np.array([d is None for d in doc_ids], bool)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    starts = np.concatenate([[0], np.cumsum([len(p) // width for p in payloads])]).astype("<u8")
    hashed = hashed_keys(keys, null)
    distinct, first, count = np.unique(hashed, return_index=True, return_counts=True)
    index = PerfectHash.build(distinct)
    slots = index.slots(distinct)
    prints = np.zeros(len(distinct), "<u4")
    prints[slots] = fingerprints(distinct)
    spans = np.zeros((len(distinct), 2), "<u4")
    spans[slots, 0], spans[slots, 1] = first, count
    sections = {"ids": b"".join(payloads), "starts": starts.tobytes(), "keys": keys.tobytes(), "null": null.astype("u1").tobytes(), "levels": index.bits.astype("<u8").tobytes(), "prints": prints.tobytes(), "slots": spans.tobytes()}
    at, places = len(MAGIC) + HEADER, {}
    for name, data in sections.items():
        places[name] = [at, len(data)]
        at += len(data)
    head = {"part": part, "seq": seq, "n_docs": len(doc_ids), "n_ids": int(starts[-1]), "width": width, "sections": places, "levels": index.places}
    blob = b"".join([MAGIC, json.dumps(head).encode().ljust(HEADER), *sections.values()])
    some = [d for d in doc_ids if d is not None]
    line = {"part": part, "seq": seq, "n_docs": len(doc_ids), "n_ids": head["n_ids"], "least": some[0] if some else None, "most": some[-1] if some else None, "nulls": int(null.sum())}
    return blob, line


class Shard:
    """A shard's bytes, opened for keyed access."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        self.head = json.loads(data[len(MAGIC) : len(MAGIC) + HEADER])
        get = lambda name, kind: np.frombuffer(data, kind, offset=(at := self.head["sections"][name])[0], count=at[1] // np.dtype(kind).itemsize)
        self.ids, self.starts, self.keys, self.null = get("ids", f"<u{self.head['width']}"), get("starts", "<u8").astype(np.int64), get("keys", "<i8"), get("null", "u1") != 0
        self.index = PerfectHash(get("levels", "<u8"), self.head["levels"])
        self.prints, self.spans = get("prints", "<u4"), get("slots", "<u4").reshape(-1, 2)

    def find(self, doc_ids: np.ndarray, null: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key, (-1, 0) for unknown keys."""
        null = np.zeros(len(doc_ids), bool) if null is None else null
        keys = hashed_keys(np.asarray(doc_ids), null)
        slot = self.index.slots(keys)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == fingerprints(keys[known])
        first = np.where(known, self.spans[slot, 0].astype(np.int64), -1) if len(self.spans) else np.full(len(keys), -1)
        known &= (self.null[first] == null) & (null | (self.keys[first] == doc_ids)) if len(self.keys) else known
        count = np.where(known, self.spans[slot, 1].astype(np.int64), 0) if len(self.spans) else np.zeros(len(keys), np.int64)
        return np.where(known, first, -1), count

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, as uint32."""
        return self.ids[self.starts[i] : self.starts[i + 1]].astype("<u4")

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of that key."""
        first, count = self.find(np.array([doc_id or 0]), np.array([doc_id is None]))
        return [self.document(int(first[0]) + k) for k in range(int(count[0]))]


# --- Spark ------------------------------------------------------------------------------


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Encode all documents and write them as shards under path, in ascending doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end, width = struct.pack(f"<{enc.kind}", end_id), enc.width
        part, seq, held = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        payloads: list[bytes] = []

        def close() -> pa.RecordBatch:
            blob, line = pack_shard(ids, payloads, part, seq, width)
            return pa.record_batch([pa.array(["ids", "manifest"]), pa.array([blob, json.dumps(line).encode()], pa.binary())], names=["kind", "value"])

        for some in common.small_batches(batches, "text"):
            for doc_id, payload in zip(some.column("doc_id").to_pylist(), enc.encode(some.column("text").to_pylist()), strict=True):
                ids.append(doc_id)
                payloads.append(payload + end)
                held += len(payload) // width + 1
                if held >= shard_ids:
                    yield close()
                    seq, held, ids, payloads = seq + 1, 0, [], []
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the text's hash lets the documents of one doc_id fall into several ranges
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")
    blobs = common.map_arrow(ordered.select("doc_id", "text"), run, "kind string, value binary")
    writer = blobs.select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind")
    writer.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _missing(spark: SparkSession, path: str) -> bool:
    """Whether nothing was written there: an empty table makes no shard."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def shards(spark: SparkSession, path: str, parts: list[int] | None = None) -> DataFrame:
    """(content binary): the shard files, or those of some parts."""
    if _missing(spark, f"{path}/kind=ids") or parts == []:
        return spark.createDataFrame([], "content binary")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    return spark.read.format("binaryFile").schema(schema).load(f"{path}/kind=ids" if parts is None else [f"{path}/kind=ids/part-{p:05d}-*" for p in parts]).select("content")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a shard, with `base`, the number of ids in all shards before it.

    The running sum goes in two steps, blocks of 1024 parts and then the blocks' totals, so
    that no task gets the lines of all shards.
    """
    none = _missing(spark, f"{path}/kind=manifest")
    lines = spark.createDataFrame([], "value string") if none else spark.read.schema("value string").text(f"{path}/kind=manifest")
    line = lines.select(F.from_json("value", "part long, seq long, n_docs long, n_ids long, least long, most long, nulls long").alias("x")).select("x.*")
    line = line.withColumn("block", F.floor(F.col("part") / 1024))
    block = line.groupBy("block").agg(F.sum("n_ids").alias("total"))
    whole = "rows between unbounded preceding and 1 preceding"
    block = block.select("block", F.expr(f"coalesce(sum(total) over (order by block {whole}), 0L)").alias("ahead"))
    inside = F.expr(f"coalesce(sum(n_ids) over (partition by block order by part, seq {whole}), 0L)")
    return line.withColumn("inside", inside).join(block, "block").select("part", "seq", "n_docs", "n_ids", "least", "most", "nulls", (F.col("ahead") + F.col("inside")).alias("base"))


def _each(fn, schema: str, source: DataFrame) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield fn(Shard(batch.column("content")[i].as_buffer().to_pybytes()))

    return common.map_arrow(source, run, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, out of the files: doc_id, start, n_tokens, ids_crc32, and part and seq of its shard.

    Every document is reached by its key through the index.
    """

    def summary(shard: Shard) -> pa.RecordBatch:
        first, count = shard.find(shard.keys, shard.null)
        if (count < 1).any():
            raise ValueError("a key of the shard is missing in its index")
        # the k-th document of a key is the k-th of its slot's run
        at = first + (np.arange(len(first)) - first)
        ends = shard.starts[at + 1]
        crc = [zlib.crc32(shard.document(i).tobytes()) for i in at]
        n = len(at)
        return pa.record_batch(
            [pa.array(shard.keys, mask=shard.null), pa.array(shard.starts[at]), pa.array(ends - shard.starts[at]), pa.array(crc, pa.int64()), pa.array(np.full(n, shard.head["part"])), pa.array(np.full(n, shard.head["seq"]))],
            names=["doc_id", "local", "n_tokens", "ids_crc32", "part", "seq"],
        )

    rows = _each(summary, "doc_id long, local long, n_tokens long, ids_crc32 long, part long, seq long", shards(spark, path))
    base = manifest(spark, path).select("part", "seq", "base")
    return rows.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")


def _ranges(spark: SparkSession, file) -> Callable[[int, int], bytes]:  # noqa: ANN001
    """A reader of byte ranges of a file in any store that Spark reads."""
    stream = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(file)
    read_all = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray

    def read(at: int, size: int) -> bytes:
        if not size:
            return b""
        stream.seek(at)
        return bytes(read_all(stream, size))

    return read


def look_up(read: Callable[[int, int], bytes], doc_id: int | None) -> list[np.ndarray]:
    """The ids of every document of a key, out of a shard of which only ranges are read.

    Read are the head, the index' bits (a few for each document), one fingerprint and slot, the
    keys and starts of the slot's documents, and their ids.
    """
    start = read(0, len(MAGIC) + HEADER)
    if start[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token shard")
    head = json.loads(start[len(MAGIC) :])

    def cells(name: str, kind: str, at: int, count: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.frombuffer(read(head["sections"][name][0] + at * size, count * size), kind)

    key = hashed_keys(np.array([doc_id or 0]), np.array([doc_id is None]))
    index = PerfectHash(cells("levels", "<u8", 0, head["sections"]["levels"][1] // 8), head["levels"])
    slot = int(index.slots(key)[0])
    if slot < 0 or cells("prints", "<u4", slot, 1)[0] != fingerprints(key)[0]:
        return []
    first, count = map(int, cells("slots", "<u4", 2 * slot, 2))
    null, own = bool(cells("null", "u1", first, 1)[0]), int(cells("keys", "<i8", first, 1)[0])
    if null != (doc_id is None) or not null and own != doc_id:
        return []
    starts = cells("starts", "<u8", first, count + 1).astype(np.int64)
    ids = cells("ids", f"<u{head['width']}", int(starts[0]), int(starts[-1] - starts[0])).astype("<u4")
    return [ids[a:b] for a, b in zip(starts - starts[0], starts[1:] - starts[0])]


def _holding(spark: SparkSession, path: str, doc_ids: list[int | None]) -> DataFrame:
    """(part, key) of the parts that may hold the keys, by the manifest."""
    keys = spark.createDataFrame([(d,) for d in dict.fromkeys(doc_ids)], "key long")
    lines = manifest(spark, path).select("part", "least", "most", "nulls")
    inside = (F.col("key") >= F.col("least")) & (F.col("key") <= F.col("most")) | F.col("key").isNull() & (F.col("nulls") > 0)
    return lines.join(F.broadcast(keys), inside).select("part", "key").distinct()  # the keys are the caller's own list


def get(spark: SparkSession, path: str, doc_id: int | None) -> list[np.ndarray]:
    """The ids of every document of one key. The manifest names the shards, of which ranges are read."""
    found: list[tuple[int, np.ndarray]] = []
    jvm = spark.sparkContext._jvm
    for row in sorted(_holding(spark, path, [doc_id]).collect()):
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/kind=ids/part-{row.part:05d}-*")
        for status in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(folder):
            read = _ranges(spark, status.getPath())
            for ids in look_up(read, doc_id):
                found.append((row.part, ids))
    return [ids for _, ids in found]


def fetch(spark: SparkSession, path: str, doc_ids: list[int | None]) -> DataFrame:
    """(doc_id, ids): the documents of the given keys; only files of parts that the manifest names are read, each asked through its index."""
    null, keys = np.array([d is None for d in doc_ids], bool), np.array([d or 0 for d in doc_ids], np.int64)
    parts = sorted({r.part for r in _holding(spark, path, doc_ids).collect()})  # as many rows as keys and the shards they span

    def ask(shard: Shard) -> pa.RecordBatch:
        first, count = shard.find(keys, null)
        hits = [(doc_ids[k], int(first[k]) + j) for k in np.flatnonzero(count) for j in range(int(count[k]))]
        return pa.record_batch([pa.array([d for d, _ in hits], pa.int64()), pa.array([shard.document(i).astype(np.int64) for _, i in hits], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return _each(ask, "doc_id long, ids array<long>", shards(spark, path, parts))
