"""Pairs grow with the square of how dense transactions are: they may not be shuffled or written as they are."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import transfers as T
from ledgerloom.plans import catalog
from ledgerloom.plans import transfers as P

SF = "/root/testdata/sf0.001"


def shuffled(df):
    """The keys that a plan shuffles rows by, once it has run."""
    df.collect()
    return re.findall(r"Exchange hashpartitioning\((\w+)#", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture
def stored(monkeypatch):
    """What the queries write, by name."""
    out, plain = {}, P.written

    def keep(df, name):
        out[name] = plain(df, name)
        return out[name]

    monkeypatch.setattr(P, "written", keep)
    monkeypatch.setattr(T, "written", keep)
    return out


def of_pairs(df):
    return [k for k in shuffled(df) if k in ("out_id", "in_id", "out_account", "in_account")]


def likely_alone(rows):
    assert rows.where(F.col("score") < T.ONE_SIDED).isEmpty() and not rows.isEmpty()
    assert not [c for c, kind in rows.dtypes if kind.startswith("array")]


def test_mutual_best(spark, stored):
    catalog.queries()["mutual_best"](spark, SF).collect()
    likely_alone(stored["pairs"])


def test_scores(spark):
    assert of_pairs(catalog.queries()["transfer_scores"](spark, SF)) == []


def test_assign(spark, stored):
    """A component with most of the pairs is ranked by ranges of the whole order, not within one task."""
    catalog.queries()["transfer_assign"](spark, SF).collect()
    likely_alone(stored["pairs"])
    assert dict(stored["edges"].dtypes)["rank"] == "bigint"


def test_components_of_ids_along_a_chain(spark, monkeypatch):
    """A chain whose ids run along it takes few rounds."""
    from ledgerloom.operators import graph

    rounds, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: rounds.append(name) or plain(df, name))
    labels = graph.components(spark.range(300).selectExpr("id as a", "id + 1 as b"))
    assert labels.where("label <> 0").isEmpty() and labels.count() == 301
    assert rounds.count("hung") < 20


def test_overlap(spark):
    assert of_pairs(catalog.queries()["counterparty_overlap"](spark, SF)) == []


def test_lane_counts(spark):
    found = of_pairs(catalog.queries()["pair_lane_counts"](spark, SF))
    assert set(found) == {"out_account"} and len(found) <= 2  # the counts themselves, in the first plan and the last


def test_scores_lane(spark):
    assert of_pairs(catalog.queries()["transfer_scores_lane"](spark, SF)) == []


def test_viable(spark, stored):
    catalog.queries()["viable_pairs"](spark, SF).collect()
    likely_alone(stored["pairs"])


def test_components(spark, stored):
    catalog.queries()["transfer_components"](spark, SF).collect()
    likely_alone(stored["pairs"])


def test_rank(spark, stored):
    catalog.queries()["pair_rank"](spark, SF).collect()
    likely_alone(stored["pairs"])
