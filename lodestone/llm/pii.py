"""Personal data by weak supervision, with DataFrame functions only.

Finders, regular expressions from strict to broad, propose spans with the text on either
side. Labelers vote for (1) or against (-1) each, or abstain (0): by format, by checksum or
range, by gazetteers of domains, calling codes and issuers, by words before the span, and by
its borders. Expectation-maximisation over the counts of vote patterns estimates how often
each labeler gives each vote for personal data and for other spans; the patterns' posteriors
then train a logistic span classifier, which decides about the spans that are not certain.
Spans of the base patterns always stay.

Only counts of vote patterns come to the driver, at most 3 ** 6 for each kind. Patterns are
written so that the regex engine neither recurses nor backtracks along a text: loops are
possessive, and a match begins only where its run of characters begins or a match before it
ended.

Defined results: a null text counts as empty and has no spans; positions are code points;
repeated rows get their spans each; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Kinds in the order in which spans of one start are listed; the first four have base patterns.
KINDS = ["email", "ip", "card", "phone", "national_id", "iban"]
BASE = KINDS[:4]

_LOCAL = r"A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Finder:
    kind: str
    pattern: str
    base: bool
    needs: str  # a cheap test that any match passes


FINDERS = [
    Finder("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True, "@"),
    Finder("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True, "[0-9]"),
    # a whole chain of 14 to 19 digits: none before it and none behind
    Finder("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])", True, "[0-9]"),
    Finder("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True, r"[+]"),
    Finder("email", rf"(?<![{_LOCAL}])[{_LOCAL}]++\x20?(?:\(at\)|\[at\]|\{{at\}})\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\{{dot\}}|\.)\x20?[A-Za-z0-9-]++)++", False, r"[(\[{]at[)\]}]"),
    Finder("phone", r"(?<![0-9+])(?:00[1-9][0-9][0-9\x20.-]{7,14}[0-9]|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?![0-9])", False, "[0-9]"),
    Finder("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", False, "[0-9]"),
    Finder("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", False, "[A-Z][0-9]"),
]

# The gazetteers and the words that speak for or against a kind.
DOMAINS = "com org net edu gov int info biz io de fr es it nl uk us ca au ch at be se no dk pl eu ru jp cn in br".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 354 358 359 370 371 372 380 385 386 420 421 971 972".split()
IBAN_LENGTHS = {"DE": 22, "FR": 27, "ES": 24, "IT": 27, "NL": 18, "GB": 22, "AT": 20, "BE": 16, "CH": 21, "PT": 25, "IE": 22, "PL": 28, "SE": 24, "DK": 18, "NO": 15, "FI": 18}
HINTS = {
    "email": "e-?mail|mail|contact|write|reach|address",
    "ip": r"\bip\b|address|host|server|login|from",
    "card": "card|visa|master|credit|debit|amex|payment",
    "phone": "phone|tel|call|mobile|cell|fax|contact|ring",
    "national_id": r"ssn|social security|\bid\b|identity|national",
    "iban": "iban|account|bank|konto|compte|cuenta|transfer",
}
AGAINST = r"version|\bv$|isbn|issn|order|invoice|serial|ticket|article|item|page|section|chapter|build|release|doi"

VOTES = ["format", "check", "gazetteer", "context", "against", "border"]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, 1).cast("int")  # i-th digit from the right, from 0
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def octets_fit(text: Column) -> Column:
    """Whether all parts between dots are at most 255, whatever their length."""
    parts = F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def holds(kind: str, text: Column) -> Column:
    """The test that a match of a base pattern must pass."""
    n = F.length(_digits(text))
    if kind == "ip":
        return octets_fit(text)
    if kind == "card":
        return n.between(14, 19) & luhn(_digits(text))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


_FOUND = "array<struct<start:bigint,text:string,before:string,after:string>>"


def found(text: Column, finder: Finder) -> tuple[Column, Column]:
    """The finder's matches, and the pieces of text around them."""
    any_ = text.contains(finder.needs) if finder.needs == "@" else text.rlike(finder.needs)
    pattern = F.lit(finder.pattern)
    return F.when(any_, F.regexp_extract_all(text, pattern, 0)), F.when(any_, F.split(text, finder.pattern, -1))


def located(matches: Column, pieces: Column) -> Column:
    """Matches with their start and 24 and 2 characters on either side."""

    def step(acc: Column, i: Column) -> Column:
        before, match = F.get(pieces, i), F.get(matches, i)
        start = acc["at"] + F.char_length(before)
        one = F.struct(start.alias("start"), match.alias("text"), F.right(before, F.lit(24)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(2)).alias("after"))
        return F.struct((start + F.char_length(match)).alias("at"), F.array_append(acc["out"], one).alias("out"))

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(f"cast(array() as {_FOUND})").alias("out"))
    return F.when(F.size(matches) > 0, F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), zero, step)["out"]).otherwise(F.expr(f"cast(array() as {_FOUND})"))


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out.when(no, -1) if no is not None else out).otherwise(0).cast("int")


def votes(finder: Finder, x: Column) -> list[Column]:
    """The labelers' votes about a located match."""
    kind, text = finder.kind, x["text"]
    before, digits = F.lower(x["before"]), _digits(x["text"])
    n, never = F.length(digits), F.lit(False)
    varied = F.size(F.array_distinct(F.split(digits, ""))) >= 4
    if kind == "email":
        plain = F.lower(F.regexp_replace(F.regexp_replace(text, r"\x20?[(\[{]at[)\]}]\x20?", "@"), r"\x20?[(\[{]dot[)\]}]\x20?", "."))
        shape = plain.rlike(r"^[a-z0-9][a-z0-9._%+-]*+@[a-z0-9.-]*[a-z0-9-]\.[a-z]{2,}$")
        check, known = F.lit(0), _vote(F.element_at(F.split(plain, r"\."), -1).isin(DOMAINS), ~shape)
    elif kind == "ip":
        shape = text.rlike(r"^([1-9][0-9]{0,2}|0)(\.([1-9][0-9]{0,2}|0)){3}$")
        check, known = _vote(octets_fit(text), ~octets_fit(text)), _vote(never, text.rlike(r"^0\."))
    elif kind == "card":
        shape = text.rlike(r"^([0-9]{14,19}|[0-9]{4}([\x20-][0-9]{2,6}){2,4})$")
        check, known = _vote(luhn(digits), ~luhn(digits)), _vote(digits.rlike("^(4|5[1-5]|2[2-7]|3[47]|6011|65|30|36|38)"), digits.rlike("^0"))
    elif kind == "phone":
        shape = text.rlike(r"^(\+|00)[1-9][0-9\x20().-]*$|^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$")
        code = F.regexp_extract(text, r"^(?:\+|00)([0-9]{1,3})", 1)
        known = _vote(code.isin(CALLING_CODES) | F.left(code, F.lit(2)).isin(CALLING_CODES) | (F.left(code, F.lit(1)).isin("1", "7")), digits.rlike("^(0000|1234567)"))
        check = _vote(n.between(10, 15) & varied, ~n.between(10, 15) | ~varied)
    elif kind == "national_id":
        shape, known = varied, F.lit(0)
        bad = text.rlike(r"^(000|666|9)|-00-|-0000$")
        check = _vote(~bad, bad)
    else:
        plain = F.regexp_replace(text, r"\x20", "")
        length = F.create_map(*(F.lit(v) for pair in IBAN_LENGTHS.items() for v in pair))[F.left(plain, F.lit(2))]
        shape, check = varied, _vote(F.length(plain) == length, F.length(plain) != length)
        known = _vote(length.isNotNull(), length.isNull())
    clear = x["before"].rlike(r"(^|[\s\"'(<\[{:;,=|])$") & x["after"].rlike(r"^($|[\s\"')>\]}:;,.!?|*#$%&=])")
    return [
        _vote(shape, ~shape).alias("format"),
        check.cast("int").alias("check"),
        known.cast("int").alias("gazetteer"),
        _vote(before.rlike(HINTS[kind])).alias("context"),
        _vote(never, before.rlike(AGAINST)).alias("against"),
        _vote(clear, ~clear).alias("border"),
    ]


def proposals(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (start, order, end, base, votes...), certain or not, of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for i, f in enumerate(FINDERS):
        matches, pieces = found(F.col("text"), f)
        rows = rows.withColumns({f"m{i}": matches, f"p{i}": pieces})
    rows = rows.select("doc_id", *(located(F.col(f"m{i}"), F.col(f"p{i}")).alias(f"f{i}") for i in range(len(FINDERS))))

    def spans(i: int) -> Column:
        f = FINDERS[i]
        kept = F.filter(f"f{i}", lambda x: holds(f.kind, x["text"])) if f.base else F.col(f"f{i}")
        order = KINDS.index(f.kind)
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), (x["start"] + F.char_length(x["text"])).alias("end"), F.lit(f.base).alias("base"), *votes(f, x)))

    rows = rows.select("doc_id", *(spans(i).alias(f"s{i}") for i in range(len(FINDERS))))
    sure = F.concat(*(F.col(f"s{i}") for i, f in enumerate(FINDERS) if f.base))
    more = F.concat(*(F.col(f"s{i}") for i, f in enumerate(FINDERS) if not f.base))
    rows = rows.select("doc_id", sure.alias("sure"), more.alias("more"))
    # of the uncertain spans, those that no base span meets
    free = F.filter("more", lambda x: ~F.exists("sure", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return rows.select("doc_id", F.array_sort(F.concat("sure", free)).alias("spans"))


@dataclass
class Model:
    """Labelers' estimated votes, and the classifier's weights: one for each (labeler, vote) and each kind."""

    share: float
    reliability: dict[tuple[str, int], tuple[float, float]]  # chance of the vote for other spans and for personal data
    weights: dict[tuple[str, int], float]
    kinds: dict[int, float]
    bias: float

    def accepts(self, x: Column) -> Column:
        total = F.lit(float(self.bias))
        for (name, vote), w in sorted(self.weights.items()):
            total = total + F.when(x[name] == vote, float(w)).otherwise(0.0)
        for kind, w in sorted(self.kinds.items()):
            total = total + F.when(x["order"] == kind, float(w)).otherwise(0.0)
        return total >= 0


def fit(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 60, steps: int = 400) -> Model:
    """From (kind, votes, count) of all proposed spans."""
    total = sum(n for _, _, n in patterns)
    names = [(v, s) for v in VOTES for s in (-1, 0, 1)]
    if not total:
        return Model(0.5, {k: (1 / 3, 1 / 3) for k in names}, {k: float(k[1]) for k in names}, {}, 0.0)
    # start from the majority of the votes
    post = [1 / (1 + math.exp(-sum(v))) for _, v, _ in patterns]
    share, reliability = 0.5, {}
    for _ in range(rounds):
        yes = sum(p * n for p, (_, _, n) in zip(post, patterns))
        share = (yes + 1) / (total + 2)
        for i, name in enumerate(VOTES):
            for s in (-1, 0, 1):
                one = sum(p * n for p, (_, v, n) in zip(post, patterns) if v[i] == s)
                all_ = sum(n for _, v, n in patterns if v[i] == s)
                reliability[name, s] = ((all_ - one + 1) / (total - yes + 3), (one + 1) / (yes + 3))
        for k, (_, v, _) in enumerate(patterns):
            odds = math.log(share / (1 - share)) + sum(math.log(reliability[name, s][1] / reliability[name, s][0]) for name, s in zip(VOTES, v))
            post[k] = 1 / (1 + math.exp(-max(-40, min(40, odds))))
    weights, kinds, bias = dict.fromkeys(names, 0.0), dict.fromkeys(range(len(KINDS)), 0.0), 0.0
    for step in range(steps):
        grad, by_kind, by_bias = dict.fromkeys(names, 0.0), dict.fromkeys(kinds, 0.0), 0.0
        for p, (kind, v, n) in zip(post, patterns):
            z = bias + kinds[kind] + sum(weights[x] for x in zip(VOTES, v))
            d = (p - 1 / (1 + math.exp(-max(-40, min(40, z))))) * n / total
            by_bias += d
            by_kind[kind] += d
            for x in zip(VOTES, v):
                grad[x] += d
        rate = 2.0 / (1 + step / 200)
        bias += rate * by_bias
        for k in kinds:
            kinds[k] += rate * (by_kind[k] - 1e-3 * kinds[k])
        for x in names:
            weights[x] += rate * (grad[x] - 1e-3 * weights[x])
    return Model(share, reliability, weights, kinds, bias)


def train(proposed: DataFrame) -> Model:
    """Fit on the vote patterns of all proposed spans."""
    x = proposed.select(F.explode("spans").alias("x")).select("x.*")
    rows = x.groupBy("order", *VOTES).agg(F.count("*").alias("n")).collect()
    return fit(sorted((r["order"], tuple(r[v] for v in VOTES), r["n"]) for r in rows))


def detect(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id and spans: array of (start, order, end, base) of every document, in order."""
    proposed = materialize(proposals(docs), "spans")
    fitted = model or train(proposed)
    kept = F.filter("spans", lambda x: x["base"] | fitted.accepts(x))
    return proposed.select("doc_id", F.transform(kept, lambda x: F.struct(x["start"], x["order"], x["end"], x["base"])).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["order"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def mask(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id and text with every span replaced by its kind in angle brackets. spans: of detect(), one row a doc_id."""
    kinds = F.array(*(F.lit(f"<{k}>") for k in KINDS))

    def step(acc: Column, x: Column) -> Column:
        start = F.greatest(acc["at"], x["start"])
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (start - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], gap, F.when(x["start"] >= acc["at"], F.get(kinds, x["order"])).otherwise("")).alias("out"))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(spans.select("doc_id", "spans"), "doc_id")
    done = F.aggregate("spans", F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")), step)
    return rows.withColumn("done", done).select("doc_id", F.concat(F.col("done.out"), F.expr("substring(text, cast(done.at as int) + 1)")).alias("text"))
