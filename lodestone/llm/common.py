"""Shared helpers of the training-data operators: tables, shared folders, Arrow loops."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words are runs of characters outside this class in every contract.
SPACE = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where none is set and the session runs in one process, as in tests, a temporary folder
    is made for the application; on a cluster the setting is needed.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        given = context._jsc.sc().getCheckpointDir()
        if given.isDefined():
            found = given.get()
        elif context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        else:
            if context.applicationId not in _own_dirs:
                _own_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
            found = _own_dirs[context.applicationId]
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


#: Spark's own setting that drops a query's shuffle files at its end.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lineage cut that survives lost executors.

    Nothing reads the shuffles of that write again, so its files go when it ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    ease(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path  # noqa: SLF001
    return out


#: The driver's memory is looked after at most once in so many seconds; its heap is collected when more than this part of it is taken.
REST, TAKEN = 3.0, 0.6
_eased = [0.0]


def ease(spark: SparkSession) -> None:
    """Hand memory that plans of earlier actions took back to the system: the driver would keep all it may have."""
    if time.monotonic() < _eased[0] + REST:
        return
    _eased[0] = time.monotonic()
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > TAKEN * runtime.maxMemory():
        jvm.java.lang.System.gc()
    give_back()
    with contextlib.suppress(Py4JError):  # other Java machines have no such command
        trim_driver(spark)


def trim_driver(spark: SparkSession) -> str:
    """Hand memory that is free but held by the driver's allocator, outside the heap, back to the system; what the Java machine says of it."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    named = jvm.java.lang.Class.forName
    kinds, given = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = named(kind)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    return named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)


def ease_executors(spark: SparkSession) -> None:
    """Hand the heap that an earlier step took on the executors back to the system; they would keep all they may have.

    Short tasks, several for each core, ask for it; an executor that gets none keeps its heap.
    """
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def discard(df: DataFrame) -> None:
    """Delete the files behind a table that materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_lodestone_path", None)
    if path:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def packed(docs: DataFrame) -> DataFrame:
    """docs as one column _row, so that no column of it can clash with an operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def unpacked(df: DataFrame, docs: DataFrame, instead: dict[str, Column] | None = None, added: dict[str, Column] | None = None) -> DataFrame:
    """The columns of docs out of df's _row: those of `instead` in their places, those of `added` at the end.

    Names are compared without regard to case; a column of docs that is named like an added one goes.
    """
    changed = {k.lower(): v for k, v in (instead or {}).items()}
    new = {k.lower() for k in added or {}}
    own = [changed.get(c.lower(), F.col(f"_row.`{c}`")).alias(c) for c in docs.columns if c.lower() not in new]
    return df.select(*own, *(v.alias(k) for k, v in (added or {}).items()))


def small_batches(batches: Iterator[pa.RecordBatch], column: str, chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `chars` bytes of a string column, one row at least."""
    for batch in batches:
        array = batch.column(column)
        start, size = 0, 0
        lengths = pa.compute.binary_length(array).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + (n or 0) > chars:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(fn, schema), whose tasks leave no memory behind in the workers that run them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Hand memory that is free but held by this process back to the system: workers are used again, and idle ones stay."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


class WordCodes(dict):
    """64-bit codes of words (bytes), the same in every process; at most `most` bytes of them are remembered."""

    def __init__(self, most: int = 16_000_000):
        super().__init__()
        self.most, self.held = most, 0

    def __missing__(self, word: bytes) -> int:
        if self.held > self.most:
            self.clear()
            self.held = 0
        code = self[word] = xxhash.xxh64_intdigest(word)
        self.held += len(word) + 180
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Words of 64 bits of a membership filter: 1 MB at least, 64 MB at most.
FILTER_WORDS, MOST_FILTER_WORDS = 1 << 17, 1 << 23
#: Bits of a filter for each key, of which a key sets four.
KEY_BITS = 16


def filter_words(keys: int) -> int:
    """The size of a filter for so many keys: up to 33 million of them, 1 in 400 other rows passes."""
    words = FILTER_WORDS
    while 64 * words < KEY_BITS * keys and words < MOST_FILTER_WORDS:
        words *= 2
    return words


def with_mark(rows: DataFrame, key: Column, wanted: DataFrame, name: str, mark: str, keys: int = 0) -> DataFrame:
    """rows with a flag that is true where the long key may be in the column `name` of wanted.

    wanted, of about `keys` rows, is hashed into a bitmap that every task gets; with more keys than
    it is made for more other rows are marked, but never a wanted one missed. What joins afterwards
    has less to move.
    """
    size = filter_words(keys)
    hashes = lambda c: [F.xxhash64(F.lit(n), c) for n in (77, 78)]
    spots = lambda many: [F.pmod(x, F.lit(64 * size)) for h in many for x in (h, F.shiftright(h, 32))]
    marks = wanted.select(F.explode(F.array(*spots(hashes(F.col(name))))).alias("spot"))
    words = marks.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot % 64 as int)))").alias("bits"))
    every = rows.sparkSession.range(size).withColumnRenamed("id", "word").join(words, "word", "left")
    one = every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("x"))
    one = one.select(F.transform("x", lambda y: y["bits"]).alias("_filter"))
    placed = rows.withColumns(dict(zip(("_spot", "_spot_2"), hashes(key)))).crossJoin(F.broadcast(one))
    hit = F.lit(True)
    for spot in spots([F.col("_spot"), F.col("_spot_2")]):
        word = F.get("_filter", F.shiftright(spot, 6).cast("int"))
        hit = hit & (F.call_function("shiftright", word, F.pmod(spot, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return placed.withColumn(mark, F.coalesce(hit, F.lit(False))).drop("_spot", "_spot_2", "_filter")


def perhaps_in(rows: DataFrame, key: Column, wanted: DataFrame, name: str, keys: int = 0) -> DataFrame:
    """The rows whose long key may be in the column `name` of wanted, and few others."""
    return with_mark(rows, key, wanted, name, "_mark", keys).where("_mark").drop("_mark")


def units(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The groups of a partition sorted by the key columns, each as one table; only the group at hand is held."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            values = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            key = tuple(batch.column(k)[start].as_py() for k in keys)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)
