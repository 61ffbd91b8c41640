import itertools
import random
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

from ledgerloom.functions.columns import lens, needs_review
from ledgerloom.operators import transfers as T
from ledgerloom.operators.graph import components
from ledgerloom.plans.statements import parsed_money


def best_by_trying(pairs):
    best = (0.0, 0, [])
    for n in range(len(pairs) + 1):
        for chosen in itertools.combinations(pairs.itertuples(), n):
            if len({r.out_id for r in chosen}) == n == len({r.in_id for r in chosen}):
                made = (round(sum(r.score for r in chosen), 9), n, [-x for x in sorted(r.rank for r in chosen)])
                best = max(best, made)
    return sorted(-x for x in best[2])


def test_exact_assignment_against_trying():
    rng = random.Random(0)
    for _ in range(40):
        edges = rng.sample([(f"o{i}", f"i{j}") for i in range(4) for j in range(4)], 8)
        pairs = pd.DataFrame([{"out_id": o, "in_id": i, "score": rng.choice([0.8, 0.85, 0.9]), "rank": k + 1} for k, (o, i) in enumerate(edges)])
        assert sorted(T.exact(pairs)) == best_by_trying(pairs)


def test_greedy_takes_ranks_in_order(spark):
    rng = random.Random(2)
    edges = [(f"l{i % 3}", f"o{i % 3}_{rng.randrange(12)}", f"i{i % 3}_{rng.randrange(12)}") for i in range(150)]
    ranked = [(*e, k) for k, e in enumerate(dict.fromkeys(edges))]
    used, want = set(), set()
    for _, o, i, _ in ranked:
        if not used & {o, i}:
            used |= {o, i}
            want.add((o, i))
    found = T.greedy(spark.createDataFrame(ranked, "label string, out_id string, in_id string, rank int"))
    assert {tuple(r) for r in found.collect()} == want


def ambiguous(first, second, least=None):
    """The cascade of ties, one step after the other."""
    if second is None or (least is not None and second["score"] < least):
        return False, "single"
    if first["score"] - second["score"] >= 0.05:
        return False, "score_gap"
    for name, label in (("ref_match", "bank_ref"), ("hints", "hint_count"), ("overlap", "counterparty"), ("forward", "chronology"), ("n_forward", "account_pair_chronology"), ("lane_n", "lane_prior")):
        if first[name] != second[name]:
            return first[name] < second[name], label
    if second["delta_s"] - first["delta_s"] >= 120:
        return False, "time_delta"
    if first["delta_cents"] != second["delta_cents"]:
        return first["delta_cents"] > second["delta_cents"], "amount_delta"
    return True, "none"


def one_after_the_other(edges):
    """Links by a plain loop over ranks; ``edges`` are viable pairs as dicts, components told by 'label'."""
    key = lambda e: (-e["score"], -e["hints"], -e["ref_match"], -e["overlap"], -e["forward"], -e["n_forward"], -e["lane_n"], e["delta_s"], e["delta_cents"], e["out_id"], e["in_id"])
    edges = sorted(edges, key=key)
    selected = []
    for label in {e["label"] for e in edges}:
        own = [dict(e, rank=k) for k, e in enumerate(e for e in edges if e["label"] == label)]
        outs, ins = {e["out_id"] for e in own}, {e["in_id"] for e in own}
        if len(outs) <= 10 and len(ins) <= 10 and len(own) <= 60:
            ranks = T.exact(pd.DataFrame(own))
            selected += [e for e in own if e["rank"] in ranks]
        else:
            used = set()
            for e in own:
                if not used & {e["out_id"], e["in_id"]}:
                    used |= {e["out_id"], e["in_id"]}
                    selected.append(e)
    used, links = set(), {}
    is_sure = lambda e: e["score"] >= 0.92 and e["hints"] > 0 and e["delta_cents"] == 0 and not e["out_generic"]
    for e in sorted(selected, key=key):
        outs = [x for x in edges if x["out_id"] == e["out_id"] and x["in_id"] not in used]
        ins = [x for x in edges if x["in_id"] == e["in_id"] and x["out_id"] not in used]
        same = lambda x, e=e: (x["out_id"], x["in_id"]) == (e["out_id"], e["in_id"])
        unclear_out = unclear_in = unclear = True
        override = False
        if same(outs[0]) and same(ins[0]):
            next_out, next_in = outs[1] if len(outs) > 1 else None, ins[1] if len(ins) > 1 else None
            unclear_out, unclear_in = ambiguous(outs[0], next_out)[0], ambiguous(ins[0], next_in)[0]
            unclear = ambiguous(outs[0], next_out, 0.92)[0] or ambiguous(ins[0], next_in, 0.92)[0]
            if next_out and next_in:
                alt = next((x for x in edges if x["out_id"] == next_in["out_id"] and x["in_id"] == next_out["in_id"]), None)
                four = [e, next_out, next_in, alt]
                if alt and all(map(is_sure, four)):
                    direct, cross = e["score"] + alt["score"], next_out["score"] + next_in["score"]
                    scores = [x["score"] for x in four]
                    override = direct > cross or (abs(direct - cross) <= 1e-9 and max(scores) - min(scores) <= 1e-9 and all(x["delta_s"] <= 30 for x in four))
        unclear = unclear and not override
        s, even, day = e["score"], e["delta_cents"] == 0, e["delta_s"] <= 86400
        one = s >= 0.74 and even and day and e["out_hint"] != e["in_hint"] and (e["in_lane"] if e["out_hint"] else e["out_lane"])
        ways = [
            s >= 0.92 and e["hints"] > 0,
            0.84 <= s < 0.92 and even and e["hints"] == 2 and day and e["n_pairs"] >= 15,
            s < 0.92 and e["n_pairs"] >= 45 and not unclear_out and not unclear_in and one,
            0.86 <= s < 0.92 and even and e["lane_n"] >= 3 and e["delta_s"] <= max(86400, e["lane_s"]) and (e["out_hits"] or e["out_hint"]) and (e["in_hits"] or e["in_hint"]),
        ]
        auto = any(ways) and not unclear and not (e["out_generic"] and e["in_hint"] and not e["ref_match"])
        if auto or s >= 0.8:
            used |= {e["out_id"], e["in_id"]}
            links[e["out_id"], e["in_id"]] = "auto" if auto else "suggested"
    return links


def test_links_against_a_plain_loop(spark):
    rng = random.Random(11)
    pairs = {}
    for label, n, m in [(f"c{k:02d}", rng.randint(1, 4), rng.randint(1, 4)) for k in range(40)] + [("wide", 13, 12), ("even", 2, 2)]:
        for o in range(n):
            for i in range(m):
                if rng.random() < 0.25 and label != "even":
                    continue
                even = label == "even"
                out_hint, in_hint = even or rng.random() < 0.7, even or rng.random() < 0.7
                pairs[f"{label}_o{o}", f"{label}_i{i}"] = {
                    "label": label, "out_id": f"{label}_o{o}", "in_id": f"{label}_i{i}", "out_account": f"A{rng.randrange(2)}", "in_account": f"B{rng.randrange(2)}",
                    "score": 0.95 if even else rng.choice([0.75, 0.76, 0.8, 0.85, 0.87, 0.9, 0.93, 0.97, 0.99]), "hints": out_hint + in_hint, "ref_match": int(rng.random() < 0.2), "overlap": rng.choice([0, 0, 1]),
                    "forward": int(rng.random() < 0.8), "lane_n": rng.choice([0, 0, 2, 4]), "lane_s": 3600.0, "delta_s": 10.0 if even else float(rng.choice([5, 20, 200, 4000, 90000])), "delta_cents": 0 if even else rng.choice([0, 0, 0, 5]),
                    "out_hint": out_hint, "in_hint": in_hint, "out_lane": rng.random() < 0.5, "in_lane": rng.random() < 0.5, "out_generic": not out_hint and rng.random() < 0.3,
                    "out_hits": rng.choice([0, 1]), "in_hits": rng.choice([0, 1]), "allowed": 10, "same_day": True, "bonus": 0.0, "window_s": 172800.0,
                }
    rows = list(pairs.values())
    one = lambda e: e["score"] >= 0.74 and e["delta_cents"] == 0 and e["delta_s"] <= 86400 and e["out_hint"] != e["in_hint"] and (e["in_lane"] if e["out_hint"] else e["out_lane"])
    lane = lambda e: (e["out_account"], e["in_account"])
    viable = [e for e in rows if e["score"] >= 0.8 or one(e)]
    for e in viable:
        e["n_pairs"] = sum(lane(x) == lane(e) and x["score"] >= 0.74 for x in rows)
        e["n_forward"] = sum(lane(x) == lane(e) and x["forward"] for x in viable)
    # The labels of the rows may be finer than those they were made by.
    above = {}
    def root(x):
        while above.get(x, x) != x:
            x = above[x]
        return x
    for e in viable:
        a, b = root(e["out_id"]), root(e["in_id"])
        above[max(a, b)] = min(a, b)
    want = one_after_the_other([dict(e, label=root(e["out_id"])) for e in viable])
    names = [k for k in rows[0] if k not in ("label", "n_pairs", "n_forward")]
    found = T.links(spark.createDataFrame(pd.DataFrame([{k: e[k] for k in names} for e in rows]))).collect()
    assert {(r["out_id"], r["in_id"]): r["status"] for r in found} == want
    assert {"auto", "suggested"} <= set(want.values())
    assert all(r["rationale"].startswith("amount_match=0.0") and "; component_mode=" in r["rationale"] for r in found)


def test_amounts_within_the_tolerance_have_neighbouring_cells(spark):
    rng = random.Random(3)
    amounts = [*range(1, 900), *(int(10 ** rng.uniform(2.5, 9)) for _ in range(4000)), *range(199_000, 201_000, 7)]
    rows = [(a, a + min(1000, max(1, a // 200))) for a in amounts]
    rows = [(a, b if b - a <= min(1000, max(1, b // 200)) else a) for a, b in rows] + [(b - min(1000, max(1, b // 200)), b) for b in amounts if b > 1]
    got = spark.createDataFrame(rows, "a long, b long").select((T.amount_cell(F.col("b")) - T.amount_cell(F.col("a"))).alias("d")).agg(F.min("d"), F.max("d")).first()
    assert got[0] >= 0 and got[1] <= 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(30) if i != 14], "a string, b string")
    assert dict(map(tuple, components(edges).collect())) == {f"n{i:03d}": "n000" if i < 15 else "n015" for i in range(31)}


def test_candidates_at_the_edges_of_cells(spark):
    row = "id string, account_id string, direction string, currency string, operation_datetime timestamp, posting_datetime timestamp, created_at timestamp, amount decimal(14,2), description_raw string, bank_category string, bank_reference_id string"
    at = lambda s: pd.Timestamp("2024-01-02 23:59:59").to_pydatetime() + pd.Timedelta(seconds=s).to_pytimedelta()
    make = lambda i, acc, d, s, a: (i, acc, d, "RUB", at(s), None, at(0), Decimal(a), None, None, None)
    tx = spark.createDataFrame([make("o", "A", "out", 0, "2000.00"), make("1", "B", "in", 172800, "1990.00"), make("2", "B", "in", 172801, "2000.00"), make("3", "B", "in", -172800, "2010.00"), make("4", "A", "in", 0, "2000.00"), make("5", "B", "in", 0, "2010.06")], row)
    assert {r["in_id"] for r in T.candidates(tx).collect()} == {"1", "3"}


def test_columns_with_nulls(spark):
    row = "meaning string, direction string, bank_category string, bank_reference_id string, amount decimal(14,2), description_raw string, category string, merchant_normalized string"
    df = spark.createDataFrame([(None,) * 8, ("internal_transfer", "out", None, None, None, None, None, None)], row)
    for name in ("internal_only", "high_confidence_transfer_like", "strict_transfer_like", "nonsense"):
        assert [r[0] for r in df.select(lens(name)).collect()] == [False, True]
    assert [r[0] for r in df.select(needs_review()).collect()] == [True, False]


def test_money(spark):
    raw = [("− 1 234,50", -1234.5), ("abc", None), ("a1b2", None), ("12 of 5", None), ("12\u00a0345.60", 12345.6), (None, None), ("+7", 7.0), ("–5,00", -5.0), ("", None), ("200000000000,00", 200000000000.0)]
    df = spark.createDataFrame(raw, "s string, want double")
    assert [None if r[0] is None else float(r[0]) for r in df.select(parsed_money(F.col("s"))).collect()] == [w for _, w in raw]
