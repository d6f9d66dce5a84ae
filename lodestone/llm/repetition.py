"""Quality rules with suffix-array repetition.

Per text: counts of words, symbols and repeated lines, and its repeated substrings. The
words of a batch of texts make one sequence; prefix doubling sorts its suffixes, where a
suffix's first key is (text, word), so that nothing is equal across texts. The longest
common prefixes of neighbours in that order give, for every place, the longest substring
that starts there and occurs again. They are compared directly only where the words before
differ; everywhere else the prefix is one word shorter than the one before (the sum of those
compared is at most n log n), so a text needs a few arrays of its length and no more. A repeat is maximal when it can't be extended to the
left either; the union of the maximal repeats' spans gives the covered fraction, and the
highest LCP the longest repeat.

Defined results: a null or empty text has zeros everywhere and base_failed (under 20
words); repeated rows are judged alike; extra columns are not read; texts are judged whole,
and a text of any length is a batch of its own if need be.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered long, covered_fraction double, longest_repeat long, base_failed boolean, kept boolean"
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    window: int = 8
    max_window_percent: int = 30
    #: Maximal repeats of fewer words don't count as covering.
    min_repeat: int = 8
    #: The most of a text's words that maximal repeats may cover.
    max_covered: float = 0.30
    #: The longest repeat may be this many words long, or that share of the text if it is more.
    max_repeat: int = 60
    max_repeat_share: float = 0.15


def suffix_order(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The order of all suffixes, each up to the end of its text.

    keys are equal for equal words of one text only, and rise with the text. A suffix that
    ends earlier comes first. Each round sorts only the suffixes that still share a rank.
    """
    n = len(keys)
    kind = np.int32 if n < 1 << 31 else np.int64
    ends = np.searchsorted(text, text, side="right").astype(kind)
    order = np.argsort(keys, kind="stable").astype(kind)
    ordered = keys[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    del ordered
    rank = np.empty(n, kind)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=kind), 0))
    width = 1
    while True:
        sizes = np.diff(np.append(np.flatnonzero(new), n))
        if not (sizes > 1).any():
            return order
        spots = np.flatnonzero(np.repeat(sizes > 1, sizes)).astype(kind)
        who = order[spots]
        after = who + kind(width)
        inside = after < ends[who]
        following = np.full(len(who), -1, kind)
        following[inside] = rank[after[inside]]
        del after, inside
        group = rank[who]
        by = np.lexsort((following, group))
        who, following, group = who[by], following[by], group[by]
        order[spots] = who
        first = np.ones(len(who), bool)
        first[1:] = (group[1:] != group[:-1]) | (following[1:] != following[:-1])
        new[spots] = first
        rank[who] = np.maximum.accumulate(np.where(first, spots, 0))
        width *= 2


def agreeing(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many keys from places a and b on are equal; a key tells its text, so this ends where a text does."""
    n, out = len(keys), np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    step = 0
    while len(left) > 64:  # word by word for the many, which mostly differ soon
        x, y = a[left] + step, b[left] + step
        same = (x < n) & (y < n)
        same[same] = keys[x[same]] == keys[y[same]]
        out[left[~same]] = step
        left = left[same]
        step += 1
    for i in left.tolist():  # by stretches for the few
        x, y, size = int(a[i]) + step, int(b[i]) + step, 64
        while True:
            size = min(size, n - max(x, y))
            differ = np.flatnonzero(keys[x : x + size] != keys[y : y + size])
            if len(differ) or not size:
                out[i] = x - int(a[i]) + (int(differ[0]) if len(differ) else 0)
                break
            x, y, size = x + size, y + size, min(2 * size, 1 << 16)
    return out


def longest_matches(keys: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """For each place, the length of the longest substring from there that its text holds elsewhere too (0 if under least)."""
    n = len(keys)
    match = np.zeros(n, np.int64)
    if n < 2:
        return match
    order = suffix_order(keys, text)
    before = np.full(n, -1, order.dtype)  # whose suffix comes just before this one
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    fresh = (before <= 0) | (at == 0)
    later = np.flatnonzero(~fresh)
    fresh[later] = keys[later - 1] != keys[before[later] - 1]
    spots = np.flatnonzero(fresh & (before >= 0))
    prefix = np.zeros(n, np.int64)
    prefix[spots] = agreeing(keys, spots, before[spots].astype(np.int64))
    start = np.maximum.accumulate(np.where(fresh, at, 0))
    prefix = np.maximum(prefix[start] - (at - start), 0)
    prefix[prefix < least] = 0
    match = prefix
    ahead = before >= 0
    np.maximum.at(match, before[ahead], prefix[ahead].copy())
    return match


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the union of the spans covers."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + lengths, -1)
    return np.cumsum(steps[:-1]) > 0


def line_repeats(text: str) -> int:
    seen: set[str] = set()
    repeats = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            if line in seen:
                repeats += 1
            else:
                seen.add(line)
    return repeats


def measure(texts: list[str | None], rules: Rules = Rules()) -> pd.DataFrame:
    """The rules' figures and verdicts for a batch of texts, in order."""
    texts = [t or "" for t in texts]
    # bytes.split() splits at exactly the white space of the contract
    words = [t.encode().split() for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    flat = np.empty(int(n_words.sum()), object)
    flat[:] = [w for some in words for w in some]
    codes, seen = pd.factorize(flat)
    text = np.repeat(np.arange(len(texts)), n_words)
    match = longest_matches(text * max(1, len(seen)) + codes, text, min(rules.window, rules.min_repeat))
    spots = np.flatnonzero(match >= rules.window)
    windows = covered(spots, np.full(len(spots), rules.window), len(match))
    before = np.zeros_like(match)
    before[1:] = match[:-1]
    spots = np.flatnonzero((match >= rules.min_repeat) & (before <= match))  # else the repeat before holds it
    spans = covered(spots, match[spots], len(match))
    count = lambda flags: np.bincount(text, weights=flags, minlength=len(texts)).astype(np.int64)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, text, match)
    out = pd.DataFrame({"n_words": n_words})
    out["word_chars"] = [len(t) - sum(map(t.count, BLANKS)) for t in texts]
    out["n_symbols"] = [sum(map(t.count, SYMBOLS)) for t in texts]
    out["n_dup_lines"] = [line_repeats(t) for t in texts]
    out["n_repeat_words"] = count(windows)
    out["n_covered"] = count(spans)
    out["covered_fraction"] = out.n_covered / np.maximum(1, n_words)
    out["longest_repeat"] = longest
    out["base_failed"] = (n_words < rules.min_words) | (100 * out.n_repeat_words > rules.max_window_percent * n_words)
    fits = (out.covered_fraction <= rules.max_covered) & (longest <= np.maximum(rules.max_repeat, rules.max_repeat_share * n_words))
    out["kept"] = ~out.base_failed & fits
    return out


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document with the rules' figures, base_failed and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text"):
            out = measure(batch.column("text").to_pylist(), rules)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(out[c].to_numpy()) for c in out)], names=["doc_id", *out])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.map_arrow(rows, run, SCHEMA)
