"""Fuzzy line dedup over a whole corpus: MinHash bands, exact Jaccard, union-find.

A line's set holds the hashes of its character shingles: the `shingle` characters from every
position on. Lines of the same text, but for case and surrounding blanks, form a class;
hashes of lines are 64 bits wide, and lines that share one hash without sharing another are
told apart and only compared exactly.

1. Hashes of shingles fall into bins by their first bits; the signature is the least hash of
   each bin, or of the next one that isn't empty. Each `rows` bins in turn make the key of a
   band, so that two sets of similarity s have a key in common with a chance of s**rows. There
   are so many bands that a pair at exactly the threshold meets in none of them with a chance
   of `miss` at most; pairs above it miss far more rarely. `rows` grows with the logarithm of
   the corpus, so that unrelated lines seldom meet however many there are, and `bands` with it.
2. Each class of a bucket is tried with two hubs, the class with the most copies and the one
   with the least hash; pairs are verified by the exact Jaccard similarity of the whole sets.
3. Buckets of three or more whose classes aren't connected are gone through in blocks: all
   pairs of different components whose signatures agree in half their bins (at a similarity of
   0.8, all but 1 in 10,000 do) are verified until they are connected. So no pair that meets in
   a bucket stays untried, but for pairs inside a component, which can't change it, and only
   links that connect leave a task.
4. Connected components of the verified links; of each component, and of each class outside,
   the first line in order of (doc_id, text hash, place) stays.

Signatures and exact similarities are numpy's work on Arrow batches: DataFrame functions alone
take more than the time allowed (README has the figures). All else is DataFrame functions.

Only texts of lines that meet others travel: a bitmap, sized by their number, keeps the rest at home.

Defined results: null and empty texts stay as they are; lines under `least` characters stay
everywhere; rows equal in doc_id and text are one document; null doc_ids come first; a
document whose lines all go has an empty text; extra columns pass through whatever their
names, but columns named like the three new ones are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, graph
from .common import discard, map_arrow, materialize, packed, perhaps_in, unpacked, with_mark
from .signature_trees import UnionFind, blocks


@dataclass(frozen=True)
class Lines:
    shingle: int = 8
    percent: int = 80
    least: int = 20
    #: The chance that a pair at exactly the threshold meets in no bucket.
    miss: float = 0.015
    #: The most lines of a block.
    block: int = 256

    def banding(self, documents: int) -> tuple[int, int]:
        """Hashes of a key, and keys of a line, for a corpus of so many documents."""
        rows = max(4, math.ceil(math.log2(documents + 1) / 7))
        return rows, math.ceil(math.log(self.miss) / math.log1p(-((self.percent / 100) ** rows)))


#: Blocks of so many lines are compared without a look at signatures.
SMALL = 8
PLACE = ["_doc", "_th", "_pos"]
NO_ID = -(1 << 63)
ADDED = ["n_lines", "n_removed", "n_near"]


def documents(docs: DataFrame) -> DataFrame:
    """_doc (doc_id, never null), _th (hash of the text), text, and _row (all columns as they are)."""
    rows = packed(docs).select("_row", F.col("_row.doc_id").cast("long").alias("id"), F.col("_row.text").cast("string").alias("text"))
    return rows.select(F.coalesce("id", F.lit(NO_ID)).alias("_doc"), F.xxhash64("text").alias("_th"), "text", "_row")


def normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def long_lines(docs: DataFrame, how: Lines) -> DataFrame:
    """Every line long enough to be compared: its place, text and two hashes a and b."""
    lines = documents(docs).select("_doc", "_th", F.posexplode(F.split("text", "\n", -1)).alias("_pos", "line")).select(*PLACE, normal(F.col("line")).alias("line"))
    return lines.where(F.char_length("line") >= how.least).withColumns({"a": F.xxhash64("line"), "b": F.xxhash64(F.lit(1), F.col("line"))})


def _mixed_up(x: np.ndarray) -> np.ndarray:
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    z = y >> np.uint64(27)
    y ^= z
    y *= np.uint64(0x94D049BB133111EB)
    np.right_shift(y, np.uint64(31), out=z)
    y ^= z
    return y


def windows(points: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` code points: polynomials in their hashes, put together from runs of 1, 2, 4, ..."""
    power, span, factor = _mixed_up(points.astype(np.uint64) + np.uint64(1)), 1, np.uint64(0xD6E8FEB86659FD95)
    out, held = np.full(len(points), size, np.uint64), 0
    with np.errstate(over="ignore"):
        while held < size:
            if size & span:
                n = len(points) - held - span + 1
                out = out[:n] * factor
                out += power[held : held + n]
                held += span
            if held < size:
                longer = power[: len(power) - span] * factor
                longer += power[span:]
                power, factor = longer, factor * factor
            span *= 2
        return _mixed_up(out)


#: Lines are hashed in pieces of so many characters, whose numbers fit in a core's cache.
PIECE = 60_000


def pieces(lines: list[str]) -> Iterator[list[str]]:
    start, size = 0, 0
    for i, x in enumerate(lines):
        if size and size + len(x) > PIECE:
            yield lines[start:i]
            start, size = i, 0
        size += len(x)
    if start < len(lines):
        yield lines[start:]


def shingles(lines: list[str], how: Lines) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the shingles of all lines, one after the other, and how many each line has; a line shorter than a shingle is one."""
    size = how.shingle
    lines = [x if len(x) >= size else x + "\0" * (size - len(x)) for x in lines]
    points = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4")
    length = np.array([len(x) for x in lines], np.int64)
    count = length - size + 1
    skipped = np.arange(len(lines)) * (size - 1)
    return windows(points, size)[np.arange(count.sum()) + np.repeat(skipped, count)], count


def shingle_sets(lines: list[str], how: Lines) -> list[np.ndarray]:
    """The set of each line, sorted."""
    out = []
    for some in pieces(lines):
        found, count = shingles(some, how)
        ends = np.cumsum(count)
        starts = ends - count
        for start, end in zip(starts.tolist(), ends.tolist()):
            found[start:end].sort()
        new = np.empty(len(found), bool)
        np.not_equal(found[1:], found[:-1], out=new[1:])
        new[starts] = True
        found, ends = found[new], np.cumsum(np.add.reduceat(new, starts, dtype=np.int64)).tolist()
        out += [found[start:end] for start, end in zip([0, *ends], ends)]
    return out


def signatures(lines: list[str], how: Lines, bins: int) -> np.ndarray:
    """(lines, bins): the least hash of each bin, or of the next that isn't empty."""
    return np.concatenate([binned(*shingles(some, how), bins) for some in pieces(lines)] or [np.empty((0, bins), np.uint64)])


def binned(found: np.ndarray, count: np.ndarray, bins: int) -> np.ndarray:
    """The signatures of lines that have so many hashes (count) of those found."""
    spot = (found >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(count) * bins, none)
    np.minimum.at(out, np.repeat(np.arange(len(count)) * bins, count) + spot.astype(np.int64), found)
    out = out.reshape(len(count), bins)
    empty = (out == none).any(axis=1)
    if empty.any():
        some = out[empty]
        twice = np.concatenate([some, some], axis=1) != none
        follow = np.where(twice, np.arange(2 * bins), 2 * bins)
        follow = np.minimum.accumulate(follow[:, ::-1], axis=1)[:, ::-1][:, :bins]
        out[empty] = np.take_along_axis(some, follow % bins, axis=1)
    return out


def band_keys(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """(lines, bands) keys, as signed integers."""
    out = np.empty((len(signature), bands), np.uint64)
    signature = np.ascontiguousarray(signature.T)
    with np.errstate(over="ignore"):
        for i in range(bands):
            key = np.full(len(out), i + 1, np.uint64)
            for j in range(i * rows, (i + 1) * rows):
                key = _mixed_up(key * np.uint64(0x9E3779B97F4A7C15) + signature[j])
            out[:, i] = key
    return out.view(np.int64)


def alike(one: np.ndarray, two: np.ndarray, how: Lines) -> bool:
    """Whether two sets are similar enough."""
    if 100 * min(len(one), len(two)) < how.percent * max(len(one), len(two)):
        return False
    shared = int(np.count_nonzero(two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one))
    return 100 * shared >= how.percent * (len(one) + len(two) - shared)


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df with a column that is computed once a row, before anything that uses it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def signed(docs: DataFrame, how: Lines, rows: int, bands: int) -> DataFrame:
    """Every long line: its place, a, b and its keys k0, k1, ..."""
    names = [f"k{i}" for i in range(bands)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in common.small_batches(batches, "line", 1_000_000):
            keys = band_keys(signatures(some.column("line").to_pylist(), how, rows * bands), rows, bands)
            yield pa.record_batch([some.column(c) for c in (*PLACE, "a", "b")] + [pa.array(k) for k in keys.T.copy()], names=[*PLACE, "a", "b", *names])

    lines = long_lines(docs, how).select(*PLACE, "a", "b", "line")
    return map_arrow(lines, run, "_doc long, _th long, _pos int, a long, b long, " + ", ".join(f"{k} long" for k in names))


def hub_pairs(members: DataFrame, hubs: Column) -> DataFrame:
    """(a, b): each class with the hubs of its bucket."""
    pairs = members.select("a", F.explode(F.array_distinct(hubs)).alias("hub")).where("a <> hub")
    return pairs.select(F.greatest("a", "hub").alias("a"), F.least("a", "hub").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, how: Lines) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. texts: (a, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in common.small_batches(batches, "line_a", 1_000_000):
            one, two = some.column("line_a").to_pylist(), some.column("line_b").to_pylist()
            lines = list({*one, *two})
            sets = dict(zip(lines, shingle_sets(lines, how)))
            fits = [alike(sets[x], sets[y], how) for x, y in zip(one, two)]
            yield pa.record_batch([some.column("a"), some.column("b")], names=["a", "b"]).filter(pa.array(fits, pa.bool_()))

    both = pairs.join(texts.select("a", F.col("line").alias("line_a")), "a").join(texts.select(F.col("a").alias("b"), F.col("line").alias("line_b")), "b")
    return materialize(map_arrow(both.select("a", "b", "line_a", "line_b"), run, "a long, b long"), "line_links")


def placed(members: DataFrame, groups: DataFrame) -> DataFrame:
    """members with the component of each, without the buckets that one component fills. groups: (a, component)."""
    found = materialize(members.join(groups, "a", "left").withColumn("component", F.coalesce("component", "a")), "line_placed")
    mixed = found.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
    return materialize(found.join(mixed, "key"), "line_mixed")


def connecting(ids: list[int], sets: list[np.ndarray], group: list[int], side: np.ndarray | None, how: Lines, bins: int = 32) -> list[tuple[int, int]]:
    """Links that connect the components (group) of lines with these sets, of all pairs or of those between side 0 and side 1."""
    number = {g: i for i, g in enumerate(dict.fromkeys(group))}
    forest, mine = UnionFind(len(number)), [number[g] for g in group]
    sift = len(ids) > SMALL
    if sift:
        size = np.array([len(x) for x in sets])
        signature = binned(np.concatenate(sets), size, bins)
        short = size < 2 * bins  # few shingles say little in bins
    links = []
    for i in range(len(ids)) if side is None else np.flatnonzero(side == 0).tolist():
        other = np.arange(i + 1, len(ids)) if side is None else np.flatnonzero(side == 1)
        if sift:
            other = other[(2 * (signature[other] == signature[i]).sum(axis=1) >= bins) | short[other] | short[i]]
        for j in other.tolist():
            if forest.find(mine[i]) != forest.find(mine[j]) and alike(sets[i], sets[j], how):
                forest.join(mine[i], mine[j])
                links.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
    return links


def links_between(members: DataFrame, texts: DataFrame, how: Lines) -> DataFrame:
    """(a, b): links that connect the components of buckets. members: (key, a, component)."""

    def linked(units: list[pa.Table]) -> pa.RecordBatch:
        links, start = [], 0
        sets = shingle_sets([x for unit in units for x in unit.column("line").to_pylist()], how)
        for unit in units:
            one, two = unit.column("one")[0].as_py(), unit.column("two")[0].as_py()
            side = None if one == two else (unit.column("part").to_numpy() == two).astype(int)
            end = start + len(unit)
            links += connecting(unit.column("cid").to_pylist(), sets[start:end], unit.column("component").to_pylist(), side, how)
            start = end
        return pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # most units are small, so many are gone through at once
        held, size = [], 0
        for unit in common.units(batches, "unit", "one", "two"):
            held.append(unit)
            size += unit.column("line").nbytes
            if size > 500_000:
                yield linked(held)
                held, size = [], 0
        if held:
            yield linked(held)

    dealt = blocks(members.select(F.col("key").alias("unit"), F.col("a").alias("cid"), "component"), how)
    rows = dealt.join(texts.withColumnRenamed("a", "cid"), "cid").repartition("unit", "one", "two").sortWithinPartitions("unit", "one", "two")
    return map_arrow(rows.select("unit", "one", "two", "part", "cid", "component", "line"), run, "a long, b long")


def buckets(classes: DataFrame, bands: int) -> DataFrame:
    """(a, key, m, hubs): the classes of each bucket (key) of m > 1 classes, with the bucket's hubs. Buckets of the same classes are one."""
    keys = classes.select("a", "copies", F.explode(F.array(*(F.col(f"k{i}") for i in range(bands)))).alias("key"))
    marks = [F.count("*").alias("m"), F.bit_xor("a").alias("x"), F.bit_xor(F.xxhash64("a")).alias("y"), F.max_by("a", "copies").alias("h0"), F.min("a").alias("h1")]
    full = keys.groupBy("key").agg(*marks).where("m > 1")
    full = full.groupBy("m", "x", "y").agg(F.min("key").alias("key"), F.min("h0").alias("h0"), F.min("h1").alias("h1"))
    full = materialize(full.drop("x", "y"), "line_buckets")
    met = perhaps_in(keys.select("a", "key"), F.col("key"), full, "key", full.count()).join(full.select("key", "m", F.array("h0", "h1").alias("hubs")), "key")
    return materialize(met, "line_members")


def line_links(docs: DataFrame, classes: DataFrame, bands: int, how: Lines) -> DataFrame:
    """(a, b): edges that connect the classes of lines that verified links connect."""
    members = buckets(classes, bands)
    wanted = materialize(members.select("a").distinct(), "line_wanted")
    texts = perhaps_in(long_lines(docs, how).select("a", "line"), F.col("a"), wanted, "a", wanted.count()).groupBy("a").agg(F.min("line").alias("line"))
    texts = materialize(texts.join(wanted, "a"), "line_texts")
    links = verified(materialize(hub_pairs(members, F.col("hubs")), "line_pairs"), texts, how)
    groups = materialize(graph.components(links).withColumnRenamed("v", "a"), "line_stars")
    # components so far go on as stars, which are settled if nothing joins them
    links = groups.select("a", F.col("component").alias("b"))
    # in buckets of two nothing is left to try
    crowded = placed(members.where("m > 2").select("a", "key"), groups)
    if not crowded.isEmpty():
        links = links.unionByName(materialize(links_between(crowded, texts, how), "line_links"))
    return links


def removed(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """(_doc, _th, gone, n_near): of each document that loses lines, their places, and how many of them only resemble the line that stays."""
    rows, bands = how.banding(docs.count())
    lines = materialize(signed(docs, how, rows, bands), "lines")
    keys = [f"k{i}" for i in range(bands)]
    classes = lines.groupBy("a").agg(F.count("*").alias("copies"), F.min("b").alias("least"), F.max("b").alias("most"), *(F.min(c).alias(c) for c in keys))
    classes = materialize(classes, "line_classes")
    links = line_links(docs, classes.where("least = most"), bands, how)
    groups = materialize(graph.components(links).withColumnRenamed("v", "a"), "line_groups")
    # only classes of several lines, and those that links connect, can lose lines
    several = classes.where("copies > 1").select("a").unionByName(groups.select("a")).distinct()
    several = materialize(several.join(groups, "a", "left"), "line_several")
    some = perhaps_in(lines.select(*PLACE, "a", "b"), F.col("a"), several, "a", several.count()).join(several, "a")
    # a class outside all components is told by both hashes
    group = some.select(*PLACE, "a", F.coalesce("component", "a").alias("g"), F.when(F.col("component").isNull(), F.col("b")).otherwise(F.lit(0)).alias("h"))
    group = materialize(group, "line_places")
    first = materialize(group.groupBy("g", "h").agg(F.min(F.struct(*PLACE, "a")).alias("first")), "line_firsts")
    gone = group.join(first, ["g", "h"]).where(F.struct(*PLACE) != F.struct(*(F.col(f"first.{p}") for p in PLACE)))
    out = gone.groupBy("_doc", "_th").agg(F.collect_set("_pos").alias("gone"), F.count_if(F.col("a") != F.col("first.a")).alias("n_near"))
    out = materialize(out, "removed")
    for df in (lines, classes, groups, several, group, first):
        discard(df)
    return out


def kept(docs: DataFrame, how: Lines) -> DataFrame:
    """Per document: _row, the text that stays (kept) and ADDED; equal rows once."""
    gone = removed(docs, how)
    rows = documents(docs).withColumn("key", F.xxhash64("_doc", "_th"))
    # documents that lose nothing and occur once stay where they are
    counts = rows.select("_doc", "_th", "key").groupBy("_doc", "_th").agg(F.count("*").alias("rows")).where("rows > 1")
    special = gone.join(counts, ["_doc", "_th"], "full")
    special = materialize(special.select("_doc", "_th", F.xxhash64("_doc", "_th").alias("key"), "gone", "n_near", F.coalesce("rows", F.lit(1)).alias("rows")), "changed")
    marked = with_mark(rows, F.col("key"), special, "key", "special", special.count()).drop("key")
    # the changes fit in memory where the texts needn't, so these are hashed and the texts are not sorted
    changed = marked.where("special").join(special.select("_doc", "_th", "gone", "n_near", "rows").hint("shuffle_hash"), ["_doc", "_th"], "left")
    names = ["_row", "text", "gone", "n_near"]
    one = changed.where("rows is null or rows = 1").select(*names)
    equal = changed.where("rows > 1").dropDuplicates(["_doc", "_th"]).select(*names)
    same = marked.where("not special").select("_row", "text", F.lit(None).cast("array<int>").alias("gone"), F.lit(None).cast("long").alias("n_near"))
    out = once(one.unionByName(equal).unionByName(same), F.split("text", "\n", -1), "lines")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    out = out.withColumn("kept", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")))
    figures = [F.coalesce(F.size("lines"), F.lit(0)), F.coalesce(F.size("gone"), F.lit(0)), F.coalesce("n_near", F.lit(0))]
    return out.select("_row", "kept", *(x.cast("long").alias(n) for n, x in zip(ADDED, figures)))


def dedup(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """docs with the text that stays, and n_lines, n_removed and n_near of each."""
    return unpacked(kept(docs, how), docs, {"text": F.col("kept")}, {n: F.col(n) for n in ADDED})


def cleaned(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """docs with the text that stays, without documents that lose lines and have none but blanks left.

    All other columns stay as they are, but for n_chars, which follows a text that changes.
    """
    rest = kept(docs, how).where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("kept", r"\s", " ")) != ""))
    changed = {"text": F.col("kept")}
    for c in docs.columns:
        if c.lower() == "n_chars":
            size = F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(F.col(f"_row.`{c}`"))
            changed[c] = size.cast(docs.schema[c].dataType)
    return unpacked(rest, docs, changed)
