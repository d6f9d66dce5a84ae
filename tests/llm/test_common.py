import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import common


def test_filters_pass_the_same_share_of_other_rows_at_any_size(spark):
    """Twelve times the keys and rows give no more than about twelve times the rows that pass by chance."""
    for keys in (100_000, 1_200_000):
        wanted = spark.range(0, 2 * keys, 2, 4).withColumnRenamed("id", "k")
        rows = spark.range(0, 2 * keys, 1, 4)
        found = common.perhaps_in(rows, F.col("id"), wanted, "k", keys)
        right, other = found.agg(F.count_if(F.col("id") % 2 == 0), F.count_if(F.col("id") % 2 == 1)).first()
        assert right == keys and other <= 0.004 * keys


def test_filters_are_bounded():
    assert common.filter_words(0) == common.FILTER_WORDS
    assert common.filter_words(10**6) * 64 >= common.KEY_BITS * 10**6
    assert common.filter_words(10**12) == common.MOST_FILTER_WORDS


def test_the_drivers_heap_is_given_back(spark, monkeypatch):
    calls = []

    class Jvm:
        class java:  # noqa: N801
            class lang:  # noqa: N801
                class Runtime:
                    @staticmethod
                    def getRuntime():  # noqa: N802
                        return type("R", (), {"totalMemory": lambda _: 700, "maxMemory": lambda _: 750})()

                class System:
                    gc = staticmethod(lambda: calls.append(1))

    session = type("S", (), {"sparkContext": type("C", (), {"_jvm": Jvm})})
    monkeypatch.setattr(common, "trim_driver", lambda _: "")
    monkeypatch.setattr(common, "_eased", [float("-inf")])
    common.ease(session)
    common.ease(session)
    assert len(calls) == 1  # at most once in REST seconds
    monkeypatch.setattr(common, "TAKEN", 0.95)
    monkeypatch.setattr(common, "_eased", [float("-inf")])
    common.ease(session)
    assert len(calls) == 1


def test_memory_outside_the_drivers_heap_is_given_back(spark):
    assert "Trim native heap" in common.trim_driver(spark)


def test_stages_begin_with_the_memory_of_the_one_before(spark, monkeypatch):
    common.ease_executors(spark)  # runs on any session

    class Asked(Exception):
        pass

    def asked(_):
        raise Asked

    monkeypatch.setattr(corpus_pipeline, "ease_executors", asked)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Asked):
            stage(spark, spark.range(1), "nowhere")
