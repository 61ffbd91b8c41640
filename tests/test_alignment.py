import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import alignment
from ledgerloom.operators.ranks import page, ranked

ROWS = "key string, id string, high boolean, meaning string, bank_category string, bank_reference_id string, stays boolean"


def plain(rows, given):
    """Key after key over lists."""
    used, short = {}, []
    for key in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == key]
        delta = sum(r[2] for r in own) - given.get(key, 0)
        able = []
        for _, i, high, meaning, category, ref, stays in own:
            if not i:
                continue
            if delta > 0 and high and meaning in ("internal_transfer", "external_transfer"):
                able.append((0 if stays else 1, i, "demote_internal_clear_reference" if stays else "demote_internal"))
            elif delta > 0 and high and meaning == "unknown" and category == "transfer" and ref:
                able.append((2, i, "demote_unknown_clear_reference"))
            elif delta < 0 and not high and meaning == "unknown":
                able.append((0, i, "promote_unknown"))
        taken = 0
        for _, i, action in sorted(able):
            if taken < abs(delta) and i not in used:
                used[i] = (key, action)
                taken += 1
        if taken < abs(delta):
            short.append((key, "demote" if delta > 0 else "promote", abs(delta), abs(delta) - taken))
    return used, short


@pytest.mark.parametrize("folded", [0, 25, 10_000])
@pytest.mark.parametrize("seed", range(3))
def test_against_the_loop(spark, seed, folded):
    rng = random.Random(seed)
    rows = [
        (f"k{rng.randrange(14):02}", rng.choice(["", None, *[f"t{i:02}" for i in range(40)]]), rng.random() < 0.5, rng.choice(["internal_transfer", "external_transfer", "unknown", "income", None]), rng.choice(["transfer", ""]), rng.choice(["r", ""]), rng.random() < 0.3)
        for _ in range(90)
    ] + [("lone", f"u{i}", True, "unknown", "transfer", "r", False) for i in range(9)]
    given = {f"k{i:02}": rng.randrange(6) for i in range(0, 14, 2)} | {"lone": 4, "absent": 3}
    found = alignment.align(spark.createDataFrame(rows, ROWS), spark.createDataFrame(list(given.items()), "key string, n long"), folded)
    used, short = plain(rows, given)
    assert {r.id: (r.key, r.action) for r in found.operations.collect()} == used
    assert sorted(map(tuple, found.unresolved.collect())) == sorted(short)


def test_empty(spark):
    found = alignment.align(spark.createDataFrame([], ROWS), spark.createDataFrame([], "key string, n long"))
    assert found.operations.collect() == [] and found.unresolved.collect() == [] and found.deltas.collect() == []


def test_ranks_of_a_hot_group(spark):
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"g{i % 7}", i * 7919 % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, x int").repartition(5)
    got = {(r.g, r.x): r["rank"] for r in ranked(df, ["g"], [F.desc("x")]).collect()}
    by = {}
    for g, x in sorted(rows, key=lambda r: -r[1]):
        by.setdefault(g, []).append(x)
    assert got == {(g, x): k + 1 for g, xs in by.items() for k, x in enumerate(xs)}


def test_pages(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, f"v{i}") for i in range(1000)], "x int, v string").repartition(7)
    whole = [r.x for r in df.orderBy(F.desc("x")).collect()]
    for offset, limit in ((0, 10), (495, 30), (990, 50), (1000, 5), (5000, 5)):
        got = page(df, [F.desc("x")], offset, limit)
        rows = sorted((r["rank"], r.x) for r in got.collect())
        assert rows == [(offset + k + 1, x) for k, x in enumerate(whole[offset : offset + limit])]
    # Only the parts that hold the page are sorted.
    assert "part" in page(df, [F.desc("x")], 10, 5)._jdf.queryExecution().optimizedPlan().toString()
