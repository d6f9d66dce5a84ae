"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Every word has a row of a table of fixed size, by hash; words that share a row share its
vectors. A row's index vector is sparse and random; its context vector is the sum of the index
vectors of the rows around its words, over all documents. Beside that a word has a random
vector of its shape and length. A document is the mean of its words' index, context and shape
vectors, the logarithm of its length, and the shares of distinct words and of words that
occurred one or two places before; a network with one hidden layer, fitted by numpy, turns it
into a logit, and a temperature fitted on documents that the weights haven't seen makes that a
probability.

The fit uses at most `sample` labelled documents, chosen by a hash of their id; contexts are
counted and scores given over whole texts of all documents. Only the text is an input.

Defined results: a null text counts as empty and gets the score of a document without words;
repeated rows score alike; documents whose labels disagree, or are neither 0 nor 1, aren't
learned from; without labels of both kinds every score is the share of label 1 (0.5 without
any); extra columns are not read by classify() and pass through scored(), which replaces a
column named like its own (in any case of letters); an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import give_back, map_arrow, materialize, unpacked

_TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


@dataclass(frozen=True)
class Settings:
    #: The most labelled documents that the fit uses.
    sample: int = 4000
    #: Rows of the table of word vectors, a power of two up to 2**24; every word has one.
    rows: int = 1 << 14
    width: int = 48
    ones: int = 4  # non-zero components of an index vector
    reach: int = 2  # words to either side that make the context
    hidden: int = 24
    steps: int = 300
    rate: float = 0.02
    penalty: float = 1e-3
    threshold: float = 0.3
    folds: int = 5  # documents with crc32(doc_id) mod folds = 0 are held out
    seed: int = 31


def tokens(text: str | None) -> list[str]:
    return _TOKENS.findall(text or "")


def shape(token: str) -> str:
    """Kind and rough length of a word."""
    if token[0].isalpha():
        kind = "X" if token.isupper() else "x" if token.islower() else "Xx" if token[0].isupper() and token[1:].islower() else "xX"
    else:
        kind = "9" if token[0].isdigit() else token[:1] + token[-1]
    return f"<{kind} {min(len(token), 20).bit_length()}>"


#: Shapes go by hash to as many vectors.
SHAPES = 256


class Codes(dict):
    """Words to codes: 32 bits of the word's hash (the last give its row) and 8 of its shape's. At most `most` bytes of words are remembered."""

    def __init__(self, most: int = 16_000_000):
        super().__init__()
        self.most, self.held = most, 0

    def __missing__(self, token: str) -> int:
        if self.held > self.most:
            self.clear()
            self.held = 0
        code = self[token] = xxhash.xxh32_intdigest(token) << 8 | xxhash.xxh32_intdigest(shape(token)) % SHAPES
        self.held += 4 * len(token) + 180
        return code

    def of(self, some: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, some), np.int64, len(some))


def word_rows(codes: np.ndarray, s: Settings) -> np.ndarray:
    return codes >> 8 & (s.rows - 1)


def index_spots(size: int, s: Settings, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(size, ones) components that aren't 0 of each row's index vector, and what they are: 1 or -1."""
    rng = np.random.default_rng([s.seed, salt])
    return rng.random((size, s.width)).argsort(axis=1)[:, : s.ones], rng.choice([-1.0, 1.0], (size, s.ones))


def index_vectors(size: int, s: Settings, salt: int = 0) -> np.ndarray:
    out = np.zeros((size, s.width), np.float32)
    spots, signs = index_spots(size, s, salt)
    out[np.arange(size)[:, None], spots] = signs
    return out


#: Figures beside the pooled vector.
FIGURES = 3


def pooled(texts: list[str | None], codes: Codes, words: np.ndarray, shapes: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The mean over each text's words of their rows of `words` plus their rows of `shapes`; log(1 + words), share of distinct words, share of words of one or two before."""
    out = np.zeros((len(texts), words.shape[1]))
    figures = np.zeros((len(texts), FIGURES))
    for i, t in enumerate(texts):
        of = codes.of(tokens(t))
        if n := len(of):
            some, counts = np.unique(of, return_counts=True)
            out[i] = counts @ (words[word_rows(some, s)] + shapes[some & (SHAPES - 1)]) / n
            again = np.zeros(n, bool)
            again[1:] = of[1:] == of[:-1]
            again[2:] |= of[2:] == of[:-2]
            figures[i] = np.log1p(n), len(some) / n, again.mean()
    return out, figures


@dataclass
class Network:
    """Two layers on standardized inputs, and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, s: Settings) -> Network:
    """Cross-entropy by Adam on four fifths of the rows, the temperature by search on the rest."""
    rng = np.random.default_rng(s.seed + 1)
    fold = rng.permutation(len(x)) % 5 == 0
    if len(x) < 50 or len(set(y[fold])) < 2:
        fold = np.zeros(len(x), bool)
    xt, yt = x[~fold], y[~fold]
    scale = xt.std(axis=0)
    net = Network(xt.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), rng.standard_normal((x.shape[1], s.hidden)) / np.sqrt(x.shape[1]), np.zeros(s.hidden), rng.standard_normal(s.hidden) / np.sqrt(s.hidden), 0.0)
    z = (xt - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, s.steps + 1):
        w1, b1, w2, b2 = params
        h = np.tanh(z @ w1 + b1)
        p = 1 / (1 + np.exp(-np.clip(h @ w2 + b2, -40, 40)))
        d = (p - yt) / len(yt)
        dh = np.outer(d, w2) * (1 - h * h)
        grads = [z.T @ dh + s.penalty * w1, dh.sum(axis=0), h.T @ d + s.penalty * w2, np.array([d.sum()])]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - s.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if fold.any():
        raw = net.logits(x[fold])

        def loss(t: float) -> float:
            return float(np.mean(np.logaddexp(0, raw / t) - y[fold] * raw / t))

        net.temperature = min(np.exp(np.linspace(-1.5, 3, 91)), key=loss)
    return net


@dataclass
class Model:
    words: np.ndarray | None  # index and context vectors of every row, side by side, and room for shapes
    shapes: np.ndarray | None  # the shapes' vectors in that room
    network: Network | None
    prior: float
    settings: Settings

    def scorer(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The first layer is linear in the mean, so it is applied to the tables' rows beforehand."""
        net = self.network
        w = net.w1 / net.scale[:, None]
        return self.words @ w[:-FIGURES], self.shapes @ w[:-FIGURES], w[-FIGURES:], net.b1 - net.mean @ w

    def score(self, texts: list[str | None], parts: tuple | None = None, codes: Codes | None = None) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.prior)
        words, shapes, by_figure, base = parts or self.scorer()
        mean, figures = pooled(texts, Codes() if codes is None else codes, words, shapes, self.settings)
        net = self.network
        logit = np.tanh(mean + figures @ by_figure + base) @ net.w2 + net.b2
        return 1 / (1 + np.exp(-np.clip(logit / net.temperature, -40, 40)))


def _held_out(s: Settings):  # noqa: ANN202
    return (F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % s.folds) == 0


def sample(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, text, y): the labelled documents to learn from, s.sample at most."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~_held_out(s))
    marked = marked.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("doc_id", "y")
    chosen = marked.orderBy(F.xxhash64(F.lit(s.seed), "doc_id"), "doc_id").limit(s.sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most s.sample rows of 12 bytes are broadcast
    return materialize(rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), "sample")


def add_contexts(out: np.ndarray, rows: np.ndarray, spots: np.ndarray, signs: np.ndarray, s: Settings) -> None:
    """Add to each row of out (flat) the index vectors of the rows up to `reach` places beside it; -1 parts texts."""
    for step in range(1, s.reach + 1):
        a, b = rows[:-step], rows[step:]
        fine = (a >= 0) & (b >= 0)
        a, b = a[fine], b[fine]
        for x, y in ((a, b), (b, a)):
            out += np.bincount((x[:, None] * s.width + spots[y]).ravel(), signs[y].ravel(), len(out))


def contexts(docs: DataFrame, s: Settings) -> np.ndarray:
    """The context vectors of all rows over all documents: one table of fixed size. Tasks' tables are added up in steps of 16."""
    schema = "x binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (spots, signs), codes = index_spots(s.rows, s), Codes()
        out, gap = np.zeros(s.rows * s.width), np.full(s.reach, -1)
        for some in common.small_batches(batches, "text", 1_000_000):
            texts = [word_rows(codes.of(tokens(t)), s) for t in some.column("text").to_pylist()]
            add_contexts(out, np.concatenate([x for t in texts for x in (t, gap)]), spots, signs, s)
        yield pa.record_batch([pa.array([out.astype("<f8").tobytes()], pa.binary())], names=["x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(s.rows * s.width)
        for batch in batches:
            for x in batch.column("x"):
                out += np.frombuffer(x.as_buffer(), "<f8")
        yield pa.record_batch([pa.array([out.astype("<f8").tobytes()], pa.binary())], names=["x"])

    # the sums are of whole numbers, so their order doesn't matter
    rows = docs.select(F.col("text").cast("string").alias("text"))
    tables = map_arrow(rows, count, schema)
    left = rows.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // 16)
        tables = map_arrow(tables.repartition(left), add, schema)
    out = np.zeros(s.rows * s.width)
    for row in tables.collect():  # one table
        out += np.frombuffer(row.x, "<f8")
    return out.reshape(s.rows, s.width)


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    spark = docs.sparkSession
    context = contexts(docs, s)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    none = np.zeros((s.rows, s.width), np.float32)
    words = np.concatenate([index_vectors(s.rows, s), (context / np.where(norm > 0, norm, 1)).astype(np.float32), none], axis=1)
    shapes = np.concatenate([none[:SHAPES], none[:SHAPES], index_vectors(SHAPES, s, 1)], axis=1)
    both = spark.sparkContext.broadcast((words, shapes))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, (by_word, by_shape) = Codes(), both.value
        for part in common.small_batches(batches, "text"):
            x = np.concatenate(pooled(part.column("text").to_pylist(), codes, by_word, by_shape, s), axis=1)
            yield pa.record_batch([part.column("doc_id"), part.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    some = sample(docs, labels, s)
    rows = map_arrow(some.select("doc_id", "y", "text"), pool, "doc_id long, y int, x binary").collect()  # s.sample rows at most
    common.discard(some)
    both.unpersist()
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([r.y for r in rows], float)
    prior = float(y.mean()) if len(y) else 0.5
    network = fit_network(np.stack([np.frombuffer(r.x) for r in rows]), y, s) if len(set(y)) == 2 else None
    give_back()
    return Model(words, shapes, network, prior, s)


def _scores(docs: DataFrame, model: Model) -> DataFrame:
    """_row (all columns but the text), text and score."""
    # the tables go out as the first layer sees them, a quarter of their size
    parts = model.scorer() if model.network is not None else None
    held = docs.sparkSession.sparkContext.broadcast((replace(model, words=None, shapes=None), parts))
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"))
    rows = docs.select(rest.alias("_row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fitted, parts), codes = held.value, Codes()
        for some in common.small_batches(batches, "text"):
            score = fitted.score(some.column("text").to_pylist(), parts, codes)
            yield pa.record_batch([some.column("_row"), some.column("text"), pa.array(score)], names=["_row", "text", "score"])

    return map_arrow(rows, run, rows.withColumn("score", F.lit(0.0)).schema)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score added to their columns (in place of one of that name)."""
    return unpacked(_scores(docs, model), docs, {"text": F.col("text")}, {"score": F.col("score")})


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose score reaches the threshold, as they are."""
    return unpacked(_scores(docs, model).where(F.col("score") >= model.settings.threshold), docs, {"text": F.col("text")})


def classify(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scored(rows, train(docs, labels, s))
    return out.select("doc_id", _held_out(s).alias("held_out"), "score", (F.col("score") >= s.threshold).cast("int").alias("predicted"))
