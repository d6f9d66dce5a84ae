import random
import re

from pyspark.sql import functions as F

from lodestone.llm import pii, queries

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def brute(text):
    spans = [(m.start(), list(PATTERNS).index(k), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def texts():
    rnd = random.Random(8)
    pieces = ["a@b.c", "x.y+z@mail1.example.com", "@d.e", "_q", "1.2.3.4", ".5.6.7.8", "256.1.1.1", "010.000.0.255", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "0 ", "-", " ", "+1 (743) 555-3824", "+49 30", "123456789012345678901", "é🙂", "\n", "call me: ", "(at)", "john (at) site (dot) com", "555-123-4567", "123-45-6789", "DE89370400440532013000", ".", "7"]
    out = [None, "", "plain", "1" * 40_000, "a" * 40_000, "1 " * 20_000, "a." * 10_000 + "@" + "b." * 5000 + "c", "+1" + " 2" * 9000]
    return out + ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 25))) for _ in range(500)]


def test_base_spans_match_plain_regular_expressions(spark):
    some = texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(some)], "doc_id long, text string, spans string").repartition(4)
    spans = pii.detect(docs)
    got = {r.doc_id: r.s for r in spans.select("doc_id", pii.written(F.filter("spans", lambda x: x["base"])).alias("s")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(some)}
    whole = {r.doc_id: r.s for r in spans.select("doc_id", pii.written(F.col("spans")).alias("s")).collect()}
    assert all(set(got[i].split(",")) - {""} <= set(whole[i].split(",")) for i in got)


def test_weak_labels_take_likely_spans_and_leave_others(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(5))
    likely = [f"{word()} please call 212-{rnd.randint(200, 999)}-{rnd.randint(1000, 9999)} now" for _ in range(60)]
    likely += [f"mail {word()} (at) {word()} (dot) com today" for _ in range(40)] + [f"mail {word()}@{word()}.com today" for _ in range(40)]
    unlikely = [f"{word()} order 000-000-{rnd.randint(1, 9):04d}x9 {word()}" for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(likely + unlikely)], "doc_id long, text string")
    got = {r.doc_id: len(r.spans) for r in pii.detect(docs).collect()}
    assert sum(got[i] > 0 for i in range(140)) >= 130 and sum(got[140 + i] > 0 for i in range(60)) <= 5


def test_mask(spark):
    docs = spark.createDataFrame([(1, "é write a@b.com or 1.2.3.4."), (2, None), (3, "no")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.mask(docs, pii.detect(docs)).collect()}
    assert got == {1: "é write <email> or <ip>.", 2: "", 3: "no"}


def test_query_and_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op5_personal_data(spark, str(tmp_path)).count() == 0
