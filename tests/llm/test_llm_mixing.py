from pyspark.sql import functions as F
import pytest
from llm_data import AWKWARD, awkward, empty, prose, rows, DOCS

from callsift.llm import mixing


def water_fill(sizes, weights, budget, most):
    """By bisection on the level."""
    low, high = 0.0, 1e9
    for _ in range(300):
        mid = (low + high) / 2
        total = sum(min(most * s, mid * w) for s, w in zip(sizes, weights, strict=True))
        low, high = (mid, high) if total < budget else (low, mid)
    return [min(most * s, high * w) for s, w in zip(sizes, weights, strict=True)]


def planned(spark, docs, **more):
    weights = mixing.cycled_weights(docs.select("source").distinct(), (5.0, 2.0, 1.0))
    return mixing.plan(docs, weights, **{"share": 1.5, "max_epochs": 2.0, **more})


def test_weights_by_code_point_null_last(spark):
    sources = spark.createDataFrame([("b",), (None,), ("Z",), ("é",), ("a",)], "source string")
    got = {r["source"]: r["weight"] for r in mixing.cycled_weights(sources, (5.0, 2.0, 1.0)).collect()}
    assert got == {"Z": 5.0, "a": 2.0, "b": 1.0, "é": 5.0, None: 2.0}


@pytest.mark.parametrize("share", [0.1, 1.5, 1.9, 2.5])
def test_targets_are_water_filled(spark, share):
    sizes = {"a": 100, "b": 1000, "c": 10, "d": 4000, None: 500}
    table = spark.createDataFrame(list(sizes.items()), "source string, size long")
    weighed = dict(zip(sizes, (5.0, 2.0, 1.0, 0.5, 3.0), strict=True))
    weights = spark.createDataFrame(list(weighed.items()), "source string, weight double")
    got = {r["source"]: r["target"] for r in mixing.targets(table, weights, share, 2.0).collect()}
    want = water_fill(sizes.values(), weighed.values(), share * sum(sizes.values()), 2.0)
    assert [got[s] for s in sizes] == pytest.approx(want, rel=1e-9)


def test_sources_without_weight_get_nothing(spark):
    table = spark.createDataFrame([("a", 10), ("b", 10), ("c", 0)], "source string, size long")
    weights = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 1.0)], "source string, weight double")
    got = {r["source"]: r["target"] for r in mixing.targets(table, weights, 1.5, 2.0).collect()}
    assert got == {"a": 20.0, "b": 0.0, "c": 0.0}


def test_words_taken_come_near_the_target(spark):
    docs = spark.createDataFrame(rows([prose(i, 20 + i % 60) for i in range(1200)], ("a", "b", "c")), DOCS)
    got = planned(spark, docs)
    sums = got.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"))
    for r in sums.collect():
        assert abs(r["taken"] - r["target"]) <= 10
    assert got.filter("copies > 2 or copies < 0").count() == 0
    again = planned(spark, docs.repartition(7))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, again.collect()))


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = planned(spark, docs)
    assert got.count() == len(AWKWARD) + 3
    assert got.filter("text_key is null or size is null or copies is null").count() == 0
    mixed = mixing.resample(docs, got)
    assert mixed.columns == docs.columns
    assert mixed.count() == got.agg(F.sum("copies")).first()[0]
    want = got.groupBy("doc_id").agg(F.sum("copies").alias("n")).filter("n > 0")
    counted = mixed.groupBy("doc_id").agg(F.count("*").alias("n"))
    assert sorted(map(repr, want.collect())) == sorted(map(repr, counted.collect()))


def test_empty(spark):
    docs = empty(spark)
    got = planned(spark, docs)
    assert got.count() == 0 and mixing.resample(docs, got).count() == 0
