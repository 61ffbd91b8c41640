import random

import pytest

from ledgerloom.operators.split import apply_steps

PLAN = "place int, transaction_id string, account_id string, statement_row_id string, dedup_key string, reference string"


def plain(plan, transactions, links):
    """Step after step; a clone is known by account and key."""
    tx, owner = {t[0]: t for t in transactions}, {r: t for t, r in links}
    counts = {"inserted": 0, "reused": 0, "moved": 0, "skipped": 0}
    for _, source, account, row, key, ref in sorted(plan):
        if not row or owner.get(row) != source or not key or not ref:
            counts["skipped"] += 1
            continue
        found = sorted((i for i, t in tx.items() if t[1] == account and t[2] == key), key=lambda i: (isinstance(i, tuple), str(i)))
        if found:
            counts["reused"] += 1
            target = found[0]
        elif source in tx:
            target = (account, key)
            tx[target] = (target, account, key, ref, tx[source][4])
            counts["inserted"] += 1
        else:
            counts["skipped"] += 1
            continue
        if target == source:
            counts["skipped"] += 1
            continue
        owner[row] = target
        counts["moved"] += 1
    return counts, tx, owner


@pytest.mark.parametrize("seed", range(6))
def test_against_the_loop(spark, seed):
    rng = random.Random(seed)
    accounts = ["a", "b"] + [None] * (seed % 2)
    transactions = [(f"t{i}", account, f"k{rng.randrange(9)}", "", f"said{i}") for i in range(6) for account in [rng.choice(accounts)]]
    links = [(f"t{rng.randrange(6)}", f"r{i:02}") for i in range(14)]
    home = {t[0]: t[1] for t in transactions}
    plan = []
    for place in range(40):
        t, r = rng.choice(links)
        t = t if rng.random() < 0.8 else "t1"
        plan.append((place, t, home.get(t, "a"), r if rng.random() < 0.9 else rng.choice(["", None, "r99"]), rng.choice(["", None, *[f"k{k}" for k in range(12)]]), rng.choice(["ref", "ref2", "", None]) if rng.random() < 0.4 else "ref"))
    frame = lambda plan, tx, links: (spark.createDataFrame(plan, PLAN), spark.createDataFrame(tx, "id string, account_id string, dedup_key string, bank_reference_id string, said string"), spark.createDataFrame(links, "transaction_id string, statement_row_id string"))
    out = apply_steps(*frame(plan, transactions, links))
    counts, tx, owner = plain(plan, transactions, links)
    c = out.counts.first()
    assert (c.inserted_transactions, c.reused_transactions, c.moved_statement_links, c.skipped_rows) == tuple(counts.values())
    got = [tuple(r) for r in out.transactions.collect()]
    new = {(r[1], r[2]): r[0] for r in got if r[0].startswith("tx_")}
    name = lambda t: new[t] if isinstance(t, tuple) else t
    assert sorted(got, key=str) == sorted(((name(i), *t[1:]) for i, t in tx.items()), key=str)
    after = {r.statement_row_id: r.transaction_id for r in out.links.collect()}
    assert after == {r: name(t) for r, t in owner.items()}


def test_a_plan_applied_twice(spark):
    """Each row is named once: the second time its owner has changed, and nothing happens."""
    transactions = spark.createDataFrame([("t0", "a", "k", "", "x"), ("t1", "a", "k1", "", "y")], "id string, account_id string, dedup_key string, bank_reference_id string, said string")
    links = spark.createDataFrame([("t0", "r0"), ("t0", "r1"), ("t0", "r2"), ("gone", "r3")], "transaction_id string, statement_row_id string")
    plan = spark.createDataFrame([(1, "t0", "a", "r1", "n1", "ref1"), (2, "t0", "a", "r2", "k1", "ref2"), (3, "gone", "a", "r3", "n3", "ref3")], PLAN)
    once = apply_steps(plan, transactions, links)
    assert tuple(once.counts.first()) == (1, 1, 2, 1)
    twice = apply_steps(plan, once.transactions, once.links)
    assert tuple(twice.counts.first()) == (0, 0, 0, 3)
    assert sorted(twice.transactions.collect()) == sorted(once.transactions.collect()) and sorted(twice.links.collect()) == sorted(once.links.collect())
