import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.mixing import mix_sources, reached, thresholds


@pytest.mark.parametrize("rate", [0.01, 0.5, 1.0, 3.7, 40.0, 400.0])
def test_thresholds_are_the_distribution(rate):
    own = thresholds(rate)
    p = [own[0], *(b - a for a, b in zip(own, own[1:], strict=False))]
    assert math.isclose(sum(p), 1, abs_tol=1e-9) and math.isclose(sum(k * x for k, x in enumerate(p)), rate, rel_tol=1e-6)


def test_weights(spark):
    rows = [(i, "big" if i % 3 == 0 else "small" if i % 10 == 1 else None, "t") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = mix_sources(docs, {"big": 0.2, "small": 0.5}, rest=0.3, size=1.5, seed=3)
    got = {r["source"]: r["n"] for r in mixed.groupBy("source").count().withColumnRenamed("count", "n").collect()}
    for name, weight in (("big", 0.2), ("small", 0.5), (None, 0.3)):
        assert math.isclose(got[name], weight * 9000, rel_tol=0.1)
    again = mix_sources(docs, {"big": 0.2, "small": 0.5}, rest=0.3, size=1.5, seed=3)
    assert sorted(map(tuple, mixed.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)


def test_rows(spark):
    docs = spark.createDataFrame([(None, "a", 1), (5, None, 2), (5, None, 2), (6, "b", 3)], "doc_id long, source string, copy int")
    none = mix_sources(docs, {"a": 1.0, "b": 0.0}, rest=0.0, names=("repeat", "key"))
    assert {r["source"] for r in none.collect()} <= {"a"} and none.columns == ["doc_id", "source", "copy", "repeat", "key"]
    everything = mix_sources(docs, {}, rest=1.0, size=5.0, names=("repeat", "key")).collect()
    five = [r["repeat"] for r in everything if r["doc_id"] == 5]
    assert sorted(five) == sorted([*range(1, len(five) // 2 + 1)] * 2)
    assert mix_sources(docs.limit(0), {"a": 1.0}, names=("repeat", "key")).collect() == []


@pytest.mark.parametrize("rate", [0.0, 0.3, 7.0, 2000.0, 100_000.0])
def test_reached_counts_thresholds(spark, rate):
    steps = thresholds(rate)
    numbers = [0.0, 2.0**-52, 0.1, 0.5, 0.75, 1 - 2.0**-52, *steps[len(steps) // 2 : len(steps) // 2 + 3]]
    given = spark.createDataFrame([(x,) for x in numbers], "u double")
    plan = given.select("u", reached(steps, F.col("u")).alias("n"))
    assert {r["u"]: r["n"] for r in plan.collect()} == {u: sum(x <= u for x in steps) for u in numbers}


def test_large_rate(spark):
    docs = spark.createDataFrame([(i, "rare" if i == 0 else "rest") for i in range(1000)], "doc_id long, source string")
    mixed = mix_sources(docs, {"rare": 0.9}, rest=0.1, size=100.0, seed=1)
    n = mixed.where("source = 'rare'").count()
    assert abs(n - 90_000) < 5 * 300


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "mine")], "doc_id long, source string, Copy string")
    with pytest.raises(ValueError, match="copy"):
        mix_sources(docs, {"a": 1.0})
    with pytest.raises(ValueError):
        mix_sources(docs, {"a": 1.0}, names=("n", "N"))
    assert {r["Copy"] for r in mix_sources(docs, {"a": 1.0}, size=9.0, names=("n", "key")).collect()} == {"mine"}


def test_a_named_source_without_rows(spark):
    docs = spark.createDataFrame([(i, "a") for i in range(2000)], "doc_id long, source string")
    assert abs(mix_sources(docs, {"a": 0.5, "gone": 0.5}).count() - 1000) < 150
