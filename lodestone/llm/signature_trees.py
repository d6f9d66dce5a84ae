"""N-gram Jaccard join by signature trees.

A document's set holds the hashes of its distinct word shingles. Documents of one set form a
class; only classes are joined.

1. Counts of all shingles in a fixed-width table (each slot counts the shingles that hash to
   it, over all documents) give one order of the shingles, rare first. Two sets that are
   similar enough share a shingle among the first n - ceil(t n) + 1 of either, whatever the
   order is; with this one, a passage that many documents hold seldom leads them together.
2. Each shared shingle makes a unit of the classes that hold it so early. Units of the same
   members are one. Only ids and sizes are dealt out until it is known which classes meet.
3. Within a unit, the classes' signatures (bitmaps of their shingles) make a tree: nodes hold
   the OR of the bitmaps below, the range of the sizes and the most shingles that any member
   loses to collisions. Two trees are gone through together; a pair of nodes is passed over
   when the sizes can't fit or when the common bits, and the collisions, can't make up the
   overlap that the least sizes need. So no pair that links is passed over. A unit in which
   nothing fits is done after one look.
4. Pairs that remain are verified on the whole sets. ROUNDS times each class is verified with
   its likeliest partner outside its component, so that copies meet their original first; then
   all pairs that remain between components are. Pairs inside a component can't change it. A
   unit too large for a task is dealt out in blocks in those rounds, in others each time, and
   each block gets the unit's class of most documents. At last the blocks outside the unit's
   largest component are gone through with each other and with that component's blocks.

The result is components only: links inside a component are not listed, so there is neither a
table nor a number of all links.

Defined results: null and empty texts and texts without words have an empty set, link with
nothing and are their own component; fewer words than a shingle make one shingle of the whole
sequence; documents of one doc_id are documents of their own; a component's name is its least
doc_id that is not null; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph
from .common import WordCodes, discard, map_arrow, materialize, packed, perhaps_in, unpacked

NO_ID = -(1 << 63)
LEAF = 16
#: Bits of a signature for each shingle, at least; the fewer collide, the fewer pairs are verified in vain.
BITS = 4
FANOUT = 4
#: Slots of the table of counts: 2**20 counters, 4 MB in each task and the driver.
SLOTS = 1 << 20
#: Rounds in which each class is verified with its likeliest partner, before all pairs that are left.
ROUNDS = 2
#: Classes of a unit that one task goes through together.
BLOCK = 512
#: Partners of one class, and shingles, that one task verifies together.
PARTNERS, SHINGLES = 256, 1_000_000


@dataclass(frozen=True)
class Join:
    words: int = 5
    percent: int = 80  # pairs link when 100 * intersection >= percent * union
    block: int = BLOCK

    def __post_init__(self) -> None:
        if not 50 < self.percent <= 100:
            raise ValueError("percent must be over 50 and at most 100")

    def least(self, n: int) -> int:
        """The overlap that a set of n needs with any that it links with."""
        return -(-self.percent * n // 100)

    def overlap(self, a, b):  # noqa: ANN001, ANN201
        """The overlap that sets of a and b need."""
        return -(-self.percent * (a + b) // (100 + self.percent))


# --- sets -------------------------------------------------------------------------------

def shingle_set(text: str | None, width: int, codes: WordCodes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text with A-Z in lower case."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    words = codes.of(words)
    k = min(width, len(words))
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        h = np.full(n, 0x9E3779B97F4A7C15 + k, np.uint64)
        for i in range(k):
            h = (h ^ words[i : i + n]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def bitmap_bits(n: int) -> int:
    """A power of two at least BITS times the size of the set."""
    return max(64, 1 << (BITS * n - 1).bit_length())


def bitmap(shingles: np.ndarray) -> np.ndarray:
    bits = bitmap_bits(len(shingles))
    out = np.zeros(bits // 64, np.uint64)
    spot = (shingles >> np.uint64(20)) & np.uint64(bits - 1)
    np.bitwise_or.at(out, (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63)))
    return out


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) folded to fewer words; the low bits of a hash stay its place."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), axis=1) if bits.shape[1] > words else bits


# --- trees ------------------------------------------------------------------------------


class UnionFind:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


class SignatureTree:
    """levels[0] are the members in order of size, each further level holds nodes over runs of the one below."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, members: np.ndarray):
        order = np.lexsort((bits[:, 0], sizes))
        bits, sizes, self.members = bits[order], sizes[order], members[order]
        lost = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, lost)]
        run = LEAF
        while len(self.levels[-1][0]) > 1:
            bits, least, most, lost = self.levels[-1]
            at = np.arange(0, len(bits), run)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.maximum.reduceat(lost, at)))
            run = FANOUT

    def below(self, level: int, i: int) -> range:
        run = LEAF if level == 1 else FANOUT
        return range(i * run, min((i + 1) * run, len(self.levels[level - 1][0])))

    def span(self, level: int, i: int) -> tuple[int, int]:
        run = LEAF * FANOUT ** (level - 1) if level else 1
        return i * run, min((i + 1) * run, len(self.members))


def fits(a: tuple, b: tuple, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows of a and b (bits, least, most, lost) may hold a link, and the most that they have in common; arrays broadcast."""
    bits_a, least_a, most_a, lost_a = a
    bits_b, least_b, most_b, lost_b = b
    common_bits = np.bitwise_count(bits_a & bits_b).sum(axis=-1).astype(np.int64) + np.minimum(lost_a, lost_b)
    sizes = (100 * most_a >= join.percent * least_b) & (100 * most_b >= join.percent * least_a)
    return sizes & (common_bits >= join.overlap(least_a, least_b)) & (100 * common_bits >= join.percent * np.maximum(least_a, least_b)), common_bits


def dual(one: SignatureTree, two: SignatureTree | None, join: Join, apart, found) -> None:  # noqa: ANN001
    """Go through two trees together, or one with itself.

    apart(members, members) is false where no pair of the two groups is of use;
    found(members, members, shares) gets the pairs of members that may link, with the highest
    similarity that they may have.
    """
    other = two or one
    top = (len(one.levels) - 1, 0, len(other.levels) - 1, 0)
    stack = [top]
    row = lambda t, level, i: tuple(x[i] for x in t.levels[level])
    while stack:
        p, i, q, j = stack.pop()
        if p == 0 and q == 0:
            if two is None and i == j:
                continue
        a, b = one.span(p, i), other.span(q, j)
        if not fits(row(one, p, i), row(other, q, j), join)[0] or not apart(one.members[slice(*a)], other.members[slice(*b)]):
            continue
        if p <= 1 and q <= 1:
            left, right = tuple(x[slice(*a)] for x in one.levels[0]), tuple(x[slice(*b)] for x in other.levels[0])
            pairs, shared = fits((left[0][:, None], *(x[:, None] for x in left[1:])), (right[0][None], *(x[None] for x in right[1:])), join)
            if two is None and a == b:
                pairs = np.triu(pairs, 1)
            x, y = np.nonzero(pairs)
            if len(x):
                most = shared[x, y]
                found(one.members[a[0] + x], other.members[b[0] + y], most / (left[1][x] + right[1][y] - most))
        elif p > q:
            stack += [(p - 1, x, q, j) for x in one.below(p, i)]
        elif q > p:
            stack += [(p, i, q - 1, y) for y in other.below(q, j)]
        else:
            stack += [(p - 1, x, q - 1, y) for x in one.below(p, i) for y in other.below(q, j) if two is not None or i != j or x <= y]


def candidates(bits: list[np.ndarray], sizes: np.ndarray, join: Join, group: np.ndarray, found, side: np.ndarray | None = None) -> None:  # noqa: ANN001
    """Hand found(members, members, shares) all pairs of members that may link and lie in different groups.

    group: numbers of the members' components. With side, only pairs of a member with side 0
    and one with side 1.
    """

    def apart(a: np.ndarray, b: np.ndarray) -> bool:
        return not (group[a[0]] == group[a]).all() or not (group[a[0]] == group[b]).all()

    def between(a: np.ndarray, b: np.ndarray, share: np.ndarray) -> None:
        far = group[a] != group[b]
        if far.any():
            found(a[far], b[far], share[far])

    widths = np.array([len(b) for b in bits])
    trees: dict[tuple[int, int, int], SignatureTree] = {}

    def tree(width: int, words: int, where: int) -> SignatureTree | None:
        key = (width, words, where)
        if key not in trees:
            mine = np.flatnonzero((widths == width) & (True if side is None else side == where))
            trees[key] = SignatureTree(fold(np.stack([bits[i] for i in mine]), words), sizes[mine], mine) if len(mine) else None
        return trees[key]

    known = sorted(set(widths.tolist()))
    for w in known:
        for v in (w, 2 * w):  # sets that link have widths at most one step apart, as the percentage is over 50
            if v not in known:
                continue
            if side is None:
                dual(tree(w, w, 0), None if v == w else tree(v, w, 0), join, apart, between)
            else:
                for s in (0, 1) if v != w else (0,):
                    one, two = tree(w, w, s), tree(v, w, 1 - s)
                    if one and two:
                        dual(one, two, join, apart, between)


def best_partners(cid: np.ndarray, bits: list[np.ndarray], sizes: np.ndarray, join: Join, group: np.ndarray, tried: list[set[int]]) -> list[tuple[int, int, float]]:
    """(member, partner, share): for each member its likeliest partner of another group that it hasn't been tried with; the lesser cid on a tie."""
    best: dict[int, tuple[float, int]] = {}

    def found(a: np.ndarray, b: np.ndarray, share: np.ndarray) -> None:
        for x, y in ((a, b), (b, a)):
            order = np.lexsort((cid[y], -share, x))
            at = np.flatnonzero(np.append(True, x[order][1:] != x[order][:-1]))
            ends = np.append(at[1:], len(order))
            for start, end in zip(at.tolist(), ends.tolist()):
                me = int(x[order[start]])
                for k in order[start:end].tolist():
                    if int(cid[y[k]]) not in tried[me]:
                        best[me] = max(best.get(me, (-1.0, 0)), (float(share[k]), -int(cid[y[k]])))
                        break

    candidates(bits, sizes, join, group, found)
    return [(int(cid[me]), -partner, share) for me, (share, partner) in best.items()]


# --- Spark ------------------------------------------------------------------------------


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, key (doc_id, never null), text and th (its hash)."""
    rows = packed(docs).select(F.col("_row.doc_id").cast("long").alias("doc_id"), F.col("_row.text").cast("string").alias("text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "text", F.xxhash64("text").alias("th"))


def shingle_counts(docs: DataFrame, join: Join, slots: int = SLOTS) -> np.ndarray:
    """How many shingles of all documents' sets hash to each slot. Tasks' tables are added up in steps of 16."""
    width = join.words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, codes = np.zeros(slots, np.int64), WordCodes()
        for some in common.small_batches(batches, "text"):
            spots = [(shingle_set(t, width, codes) & np.uint64(slots - 1)).astype(np.int32) for t in some.column("text").to_pylist()]
            out += np.bincount(np.concatenate(spots), minlength=slots)
        yield pa.record_batch([pa.array([out.astype("<u4").tobytes()], pa.binary())], names=["counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(slots, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                out += np.frombuffer(x.as_py(), "<u4")
        yield pa.record_batch([pa.array([np.minimum(out, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())], names=["counts"])

    rows = _texts(docs).select("text")
    tables = map_arrow(rows, count, "counts binary")
    left = rows.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // 16)
        tables = map_arrow(tables.repartition(left), add, "counts binary")
    total = np.zeros(slots, np.int64)
    for row in tables.collect():  # one table
        total += np.frombuffer(row.counts, "<u4")
    return total


def _fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def class_number(fp: bytes) -> int:
    return int.from_bytes(fp[:8], "little", signed=True)


def signed(docs: DataFrame, join: Join, counts: np.ndarray) -> DataFrame:
    """Per document: doc_id, key, th, n, cid and more (the halves of its set's 128-bit fingerprint; cid is its class), keys (its first shingles), bits."""
    width, slots = join.words, len(counts)
    held = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 0xFFFFFFFF).astype("<u4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, codes = held.value, WordCodes()
        for some in common.small_batches(batches, "text"):
            sizes, ids, more, keys, bits = [], [], [], [], []
            for text in some.column("text").to_pylist():
                s = shingle_set(text, width, codes)
                n = len(s)
                fp = _fingerprint(s)
                sizes.append(n)
                ids.append(class_number(fp))
                more.append(class_number(fp[8:]))
                often = counted[(s & np.uint64(slots - 1)).astype(np.int64)]
                first = np.argsort(often, kind="stable")[: n - join.least(n) + 1] if n else np.zeros(0, np.int64)
                keys.append(s[first].view(np.int64))
                bits.append(bitmap(s).tobytes())
            own = [some.column(c) for c in ("doc_id", "key", "th")]
            new = [pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(more, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.record_batch(own + new, names=["doc_id", "key", "th", "n", "cid", "more", "keys", "bits"])

    return map_arrow(_texts(docs).select("doc_id", "key", "th", "text"), run, "doc_id long, key long, th long, n long, cid long, more long, keys array<long>, bits binary")


PAIRS = "a long, b long"


def _members(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    bits = [np.frombuffer(b.as_py(), np.uint64) for b in table.column("bits")]
    return table.column("cid").to_numpy(), table.column("n").to_numpy(), bits


def likeliest_pairs(units: DataFrame, join: Join) -> DataFrame:
    """(unit, cid, other, share): each class with its likeliest partner of another component in each block of a unit, and with the block's hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.units(batches, "unit", "part"):
            if table.num_rows < 2:
                continue
            cid, n, bits = _members(table)
            group = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
            if group.max() == 0:
                continue
            tried = [set(t or ()) for t in table.column("tried").to_pylist()]
            pairs = best_partners(cid, bits, n, join, group, tried)
            hub = table.column("hub")[0].as_py()
            if hub is not None:
                at = int(np.flatnonzero(cid == hub)[0])
                side = (np.arange(len(cid)) == at).astype(int)
                met: list[tuple[np.ndarray, np.ndarray]] = []
                candidates(bits, n, join, group, lambda a, b, share: met.append((a, b)), side)  # noqa: B023
                for a, b in met:
                    pairs += [(int(cid[x]), hub, 0.0) for x in np.where(a == at, b, a).tolist() if hub not in tried[x]]
            if pairs:
                a, b, share = zip(*pairs)
                yield pa.record_batch([pa.array([table.column("unit")[0].as_py()] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(share, pa.float64())], names=["unit", "cid", "other", "share"])

    dealt = units.repartition("unit", "part").sortWithinPartitions("unit", "part").select("unit", "part", "cid", "n", "bits", "component", "tried", "hub")
    return map_arrow(dealt, run, "unit long, cid long, other long, share double")


def further_pairs(units: DataFrame, join: Join) -> DataFrame:
    """(a, b): all pairs of a unit's two blocks (or one with itself) that may link and lie in different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.units(batches, "unit", "one", "two"):
            cid, n, bits = _members(table)
            group = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
            side = table.column("part").to_numpy()
            both = table.column("one")[0].as_py() != table.column("two")[0].as_py()
            side = (side == table.column("two")[0].as_py()).astype(int) if both else None
            out: list[tuple[np.ndarray, np.ndarray]] = []
            candidates(bits, n, join, group, lambda a, b, share: out.append((a, b)), side)  # noqa: B023
            for a, b in out:
                yield pa.record_batch([pa.array(np.maximum(cid[a], cid[b])), pa.array(np.minimum(cid[a], cid[b]))], names=["a", "b"])

    dealt = units.repartition("unit", "one", "two").sortWithinPartitions("unit", "one", "two")
    return map_arrow(dealt.select("unit", "one", "two", "part", "cid", "n", "bits", "component"), run, PAIRS)


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """(a, b): the pairs whose whole sets link. classes: (cid, n, key, th) names a document of each class.

    A task gets the text of b and those of some of its partners a, so that a text travels as
    often as it is compared with others, and no task gets all partners of a class of many.
    """
    width, percent = join.words, join.percent
    known = classes.select("cid", "n", "key", "th")
    partner = pairs.join(known, F.col("a") == F.col("cid")).select("a", "b", "n", "key", "th")
    size = partner.groupBy("b").agg(F.count("*").alias("rows"), F.sum("n").alias("all"))
    parts = F.greatest(F.ceil(F.col("rows") / PARTNERS), F.ceil(F.col("all") / SHINGLES)).cast("int")
    partner = materialize(partner.join(size.select("b", parts.alias("parts")), "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")), "partners")
    homes = partner.select("b", "part").distinct().join(known, F.col("b") == F.col("cid")).select("b", "part", F.col("b").alias("cid"), "key", "th")
    asked = materialize(partner.select("b", "part", F.col("a").alias("cid"), "key", "th").unionByName(homes), "verify")
    # the first of equal rows; others stay where they are
    place = F.xxhash64("key", "th")
    some = perhaps_in(_texts(docs).select("key", "th", "text"), place, asked.select(place.alias("place")), "place")
    some = some.groupBy("key", "th").agg(F.min("text").alias("text"))
    rows = asked.join(some, ["key", "th"]).select("b", "part", "cid", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for table in common.units(batches, "b", "part"):
            home = table.column("b")[0].as_py()
            ids = table.column("cid").to_pylist()
            sets = [shingle_set(t.as_py(), width, codes) for t in table.column("text")]
            sets = {c: s for c, s in zip(ids, sets) if class_number(_fingerprint(s)) == c}
            one = sets.pop(home, None)
            if one is None:
                raise RuntimeError("the text of a class was not found")
            links = []
            for c, two in sets.items():
                shared = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * shared >= percent * (len(one) + len(two) - shared):
                    links.append(c)
            yield pa.record_batch([pa.array([max(c, home) for c in links], pa.int64()), pa.array([min(c, home) for c in links], pa.int64())], names=["a", "b"])

    dealt = rows.repartition("b", "part").sortWithinPartitions("b", "part")
    out = materialize(map_arrow(dealt, check, PAIRS), "links")
    discard(partner)
    discard(asked)
    return out


def _mixed(placed: DataFrame) -> DataFrame:
    """The members of units that hold more than one component; the others are done."""
    mixed = placed.groupBy("unit").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("unit")
    return materialize(placed.join(mixed, "unit"), "mixed")


def classes_of(rows: DataFrame) -> DataFrame:
    """(cid, n, copies, key, th): each class, with how many documents have its set and one of them."""
    found = rows.where("n > 0").groupBy("cid").agg(F.min("n").alias("n"), F.count("*").alias("copies"), F.min("more").alias("least"), F.max("more").alias("most"), F.min(F.struct("key", "th")).alias("chosen"))
    found = materialize(found, "classes")
    if not found.where("least <> most").isEmpty():
        raise RuntimeError("two sets share a 64-bit class number")
    return found.select("cid", "n", "copies", "chosen.key", "chosen.th")


def units_of(rows: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """(unit, m, cid, hub): the classes that meet in a unit of m; hub where the unit is larger than a block."""
    keys = rows.select("cid", "n", F.explode("keys").alias("shingle"))
    shared = keys.groupBy("shingle").agg(F.min("cid").alias("least"), F.max("cid").alias("most")).where("least <> most").select("shingle")
    shared = materialize(shared, "shared")
    members = materialize(perhaps_in(keys, F.col("shingle"), shared, "shingle").join(shared, "shingle").distinct(), "met")
    marks = [F.count("*").alias("m"), F.bit_xor("cid").alias("x"), F.bit_xor(F.xxhash64("cid")).alias("y"), F.min("n").alias("least"), F.max("n").alias("most")]
    unit = members.groupBy("shingle").agg(*marks).where((F.col("m") > 2) | (100 * F.col("least") >= join.percent * F.col("most")))
    # units of the same members count once
    unit = unit.groupBy("m", "x", "y").agg(F.min("shingle").alias("shingle")).select("shingle", "m")
    found = materialize(members.join(unit, "shingle").select(F.col("shingle").alias("unit"), "m", "cid"), "units")
    large = found.where(F.col("m") > join.block).join(classes.select("cid", "copies"), "cid")
    hubs = large.groupBy("unit").agg(F.max_by("cid", F.struct("copies", "cid")).alias("hub"))
    out = materialize(found.join(hubs, "unit", "left"), "members")
    for df in (shared, members, found):
        discard(df)
    return out


def classes_and_links(docs: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, key, th, n, cid) and verified links (a, b) that connect exactly the classes that links connect."""
    counts = shingle_counts(docs, join)
    rows = materialize(signed(docs, join, counts), "signed")
    small = materialize(rows.select("doc_id", "key", "th", "n", "cid", "more"), "documents")
    classes = classes_of(small)
    members = units_of(rows, classes, join)
    wanted = members.select("cid").distinct()
    signs = perhaps_in(rows.select("cid", "n", "bits"), F.col("cid"), wanted, "cid").join(wanted, "cid", "left_semi")
    signs = materialize(signs.groupBy("cid").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "signatures")
    discard(rows)
    links = tried = members.sparkSession.createDataFrame([], PAIRS)
    asked = members.sparkSession.createDataFrame([], "cid long, other long")
    placed = members.withColumn("component", F.col("cid"))
    open_ = True
    for turn in range(ROUNDS):
        # at most one partner a round, and the hub
        parts = F.ceil(F.col("m") / F.lit(join.block)).cast("int")
        dealt = placed.withColumns({"parts": parts, "part": F.pmod(F.xxhash64("cid", "unit", F.lit(turn)), parts).cast("int")})
        hubs = dealt.where("cid = hub").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.where("hub is null or cid <> hub").unionByName(hubs)
        known = asked.groupBy("cid").agg(F.collect_set("other").alias("tried"))
        needed = perhaps_in(signs, F.col("cid"), placed, "cid") if turn else signs
        found = materialize(likeliest_pairs(dealt.join(needed, "cid").join(known, "cid", "left"), join), "asked")
        best = found.groupBy("cid").agg(F.max(F.struct("share", (-F.xxhash64("other")).alias("tie"), "other")).alias("x")).select("cid", F.col("x.other").alias("other"))
        now = materialize(best.unionByName(found.where("share = 0").select("cid", "other")).distinct(), "now")
        asked = asked.unionByName(now).unionByName(now.select(F.col("other").alias("cid"), F.col("cid").alias("other")))
        pairs = now.groupBy(F.greatest("cid", "other").alias("x"), F.least("cid", "other").alias("y")).agg(F.min("other").alias("b"))
        pairs = pairs.select((F.col("x").bitwiseXOR(F.col("y")).bitwiseXOR(F.col("b"))).alias("a"), "b", "x", "y")
        pairs = materialize(pairs.join(tried.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti"), "pairs")
        links = links.unionByName(verified(pairs.select("a", "b"), docs, classes, join))
        tried = tried.unionByName(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")))
        groups = materialize(graph.components(links), "groups")
        # units without a pair that fits are done, but for those of which only blocks were seen
        alive = found.select("unit").unionByName(placed.where("hub is not null").select("unit")).distinct()
        placed = placed.drop("component").join(alive, "unit", "left_semi").join(groups.withColumnRenamed("v", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        placed = _mixed(placed)
        if placed.isEmpty():
            open_ = False
            break
    if open_:
        rest = further_pairs(blocks(placed, join).join(perhaps_in(signs, F.col("cid"), placed, "cid"), "cid"), join).distinct().join(tried, ["a", "b"], "left_anti")
        links = links.unionByName(verified(materialize(rest, "pairs"), docs, classes, join))
    discard(signs)
    return small, links


def blocks(placed: DataFrame, join) -> DataFrame:  # noqa: ANN001
    """(unit, one, two, part, cid, component): members in blocks, one row for each block (one, two hold its pair) that theirs is gone through with.

    Blocks 0, 1, ... lie outside the largest component of the unit, the others inside; two of these
    last aren't gone through together. So members of the largest component, the many, are copied
    once for each block of the others.
    """
    size = placed.groupBy("unit", "component").agg(F.count("*").alias("of"))
    top = size.groupBy("unit").agg(F.max(F.struct("of", "component")).alias("top"), F.sum("of").alias("all"))
    few, many = F.ceil((F.col("all") - F.col("top.of")) / F.lit(join.block)).cast("int"), F.ceil(F.col("top.of") / F.lit(join.block)).cast("int")
    rows = placed.join(top.select("unit", F.col("top.component").alias("largest"), few.alias("few"), many.alias("many")), "unit")
    inside = F.col("component") == F.col("largest")
    spot = F.xxhash64("cid", "unit", F.lit(ROUNDS))
    part = F.when(inside, F.col("few") + F.pmod(spot, F.col("many"))).otherwise(F.pmod(spot, F.col("few"))).cast("int")
    rows = rows.withColumn("part", part)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)))
    return rows.select("unit", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "cid", "component")


def component_table(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, class_size (documents of the same set)."""
    rows, links = classes_and_links(docs, join)
    groups = graph.components(links)
    size = rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("first"), F.count("*").alias("class_size"))
    named = size.join(groups.withColumnRenamed("v", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = materialize(named, "named")
    name = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(name, "component").select("cid", "component_id", "class_size")
    out = rows.join(named, "cid", "left")
    empty = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(empty, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"))


def representatives(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """docs with one row of each component: of its least doc_id, null last, then by the text's hash. Rows without words all stay.

    Of rows equal in doc_id and text one stays; extra columns pass through whatever their names.
    """
    rows, links = classes_and_links(docs, join)
    groups = graph.components(links).withColumnRenamed("v", "cid")
    missing = F.col("doc_id").isNull().alias("missing")
    first = rows.where("n > 0").groupBy("cid").agg(F.min(F.struct(missing, "key", "th")).alias("first"))
    first = first.join(groups, "cid", "left").groupBy(F.coalesce("component", "cid").alias("component")).agg(F.min("first").alias("first"))
    kept = materialize(first.select("first.key", "first.th", F.xxhash64("first.key", "first.th").alias("place")), "kept")
    keyed = packed(docs).select("_row", F.col("_row.doc_id").cast("long").alias("id"), F.col("_row.text").cast("string").alias("text"))
    blank = F.coalesce(F.length(F.regexp_replace("text", f"[{common.SPACE}]", "")), F.lit(0)) == 0
    keyed = keyed.select("_row", F.coalesce("id", F.lit(NO_ID)).alias("key"), F.xxhash64("text").alias("th"), blank.alias("blank"))
    marked = perhaps_in(keyed.where("not blank"), F.xxhash64("key", "th"), kept, "place")
    # only keys that occur several times need one of their rows chosen
    several = marked.groupBy("key", "th").agg(F.count("*").alias("rows"))
    wanted = materialize(kept.select("key", "th").join(several, ["key", "th"]), "chosen")
    found = marked.join(wanted.hint("shuffle_hash"), ["key", "th"])
    one = found.where("rows = 1").select("_row").unionByName(found.where("rows > 1").dropDuplicates(["key", "th"]).select("_row"))
    return unpacked(one.unionByName(keyed.where("blank").select("_row")), docs)
