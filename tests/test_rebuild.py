import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from ledgerloom.operators import rebuild as rb

DAY = datetime(2024, 1, 1)
TX = "id string, account_id string, created_at timestamp, amount decimal(14,2), currency string, direction string, description_raw string, bank_reference_id string, bank_category string, operation_datetime timestamp, posting_datetime timestamp, source_statement_id string"
SHEETS = "id string, created_at timestamp, account_id string, provider string, account_type string, display string, currency string, period_start timestamp, period_end timestamp, opening_balance decimal(14,2), closing_balance decimal(14,2), reconcile_status string"
TRANSFERS = "id string, transaction_out_id string, transaction_in_id string, status string, rationale string, match_score double, fee_amount double"


def case(seed):
    rng = random.Random(seed)
    accounts = [(f"a{i}", "p", "card", f"d{i}", "RUB", DAY + timedelta(days=i)) for i in range(4)] + [("a9", "p", "card", "d1", "RUB", DAY)]
    sheets = [
        (f"s{i}", DAY + timedelta(days=rng.randrange(4)), rng.choice([None, "a0", "a3", "old"]), "p", "card", f"d{rng.randrange(6)}", "RUB", rng.choice([None, DAY]), DAY, 1, rng.choice([None, 2]), rng.choice(["ok", "mismatch"]))
        for i in range(6)
    ]
    tx, rows, links = [], [], []
    for i in range(30):
        kind = rng.randrange(6) if seed % 2 else i
        tx.append((f"t{i:02}", rng.choice(["a0", "a1", "a2", "old", None]), DAY + timedelta(days=rng.randrange(3)), kind, "RUB", "in", "d", "r", "c", DAY if kind % 2 else None, None, rng.choice([None, None, "s0", "s3"])))
        for _ in range(rng.randrange(3)):
            rows.append((f"r{len(rows):03}", f"s{rng.randrange(6)}", rng.choice(["x", "y", "z", ""])))
            links.append((f"t{i:02}", rows[-1][0]))
    snapshots = [(f"b{i:02}", rng.choice(["a0", "a1", "a9", "lone"]), f"s{rng.randrange(6)}", rng.choice(["statement_opening_balance", "statement_closing_balance"]), DAY, 1) for i in range(8)]
    transfers = [(f"l{i:02}", f"t{rng.randrange(12):02}", f"t{rng.randrange(12, 24):02}", rng.choice(["confirmed", "rejected", "auto", "suggested"]), f"why{i}", rng.choice([None, 0.5, 0.9]), rng.choice([None, 1.0])) for i in range(12)]
    transfers = list({(x[1], x[2]): x for x in transfers}.values())
    return accounts, sheets, tx, rows, links, snapshots, transfers, [("mm", "statement", "s1")]


def plain(accounts, sheets, tx, rows, links, snapshots, transfers, exceptions):
    """Statement by statement over lists, one table after another."""
    made, scanned, linked, gone = {}, 0, 0, set()
    home = {t[0]: t[1] for t in tx}
    fields = {t[0]: t[3:11] for t in tx}
    born = {t[0]: (t[2], t[0]) for t in tx}
    source = {t[0]: t[11] for t in tx}
    sheet_of, text_of = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    held = {i: [r for t, r in links if t == i] for i in home}
    into, left, targets = {}, set(), {}
    for s in sorted(sheets, key=lambda s: (s[1], s[0])):
        scanned += 1
        linked += s[2] is None
        known = sorted((a[5], a[0]) for a in accounts if a[1:5] == s[3:7])
        target = known[0][1] if known else made.setdefault(s[3:7], f"new{len(made)}")
        targets[s[0]] = target
        for t in sorted([t for t in home if source[t] == s[0] or any(sheet_of[r] == s[0] for r in held[t])], key=born.get):
            if home[t] == target:
                continue
            if home[t]:
                left.add(home[t])
            same = sorted([c for c in home if c != t and home[c] == target and fields[c] == fields[t]], key=born.get)
            if not same:
                home[t] = target
                continue
            mine = {text_of[r] for r in held[t]} - {""}
            like = [c for c in same if mine & ({text_of[r] for r in held[c]} - {""})] if len(same) > 1 else []
            c = (like or same)[0]
            held[c] += held[t]
            into[t] = c
            del home[t]
    end = lambda t: end(into[t]) if t in into else t
    return scanned, linked, made, home, {(end(t), r) for t, r in links}, end, targets, left


@pytest.mark.parametrize("seed", range(6))
def test_against_the_loop(spark, seed):
    data = case(seed)
    accounts, sheets, tx, rows, links, snapshots, transfers, exceptions = data
    frame = spark.createDataFrame
    out = rb.rebuild(
        frame([(*s[:9], None if s[9] is None else Decimal(s[9]), None if s[10] is None else Decimal(s[10]), s[11]) for s in sheets], SHEETS),
        frame(accounts, "id string, provider string, account_type string, display string, currency string, created_at timestamp"),
        frame([(*t[:3], Decimal(t[3]), *t[4:]) for t in tx], TX), frame(links, "transaction_id string, statement_row_id string"), frame(rows, "id string, statement_id string, raw_text string"),
        frame(transfers, TRANSFERS), frame([(*s[:5], Decimal(s[5])) for s in snapshots], "id string, account_id string, statement_id string, method string, ts timestamp, balance decimal(14,2)"),
        frame(exceptions, "exception_type string, entity_type string, entity_id string"), "mm",
    )
    scanned, linked, made, home, links_after, end, targets, left = plain(*data)
    new = {r.display: r.id for r in out.accounts.where("id like 'acct%'").collect()}
    names = {made[k]: new[k[2]] for k in made}
    name = lambda a: names.get(a, a)
    assert len(new) == len(made)
    assert {r.id: r.account_id for r in out.transactions.collect()} == {t: name(a) for t, a in home.items()}
    assert {tuple(r) for r in out.links.collect()} == links_after
    assert {r.id: r.account_id for r in out.statements.collect()} == {s: name(a) for s, a in targets.items()}
    pairs = {(end(x[1]), end(x[2])) for x in transfers if end(x[1]) != end(x[2])}
    got = {(r.transaction_out_id, r.transaction_in_id): r for r in out.transfer_links.collect()}
    assert set(got) == pairs
    for (a, b), r in got.items():
        group = [x for x in transfers if (end(x[1]), end(x[2])) == (a, b)]
        assert r.status == max(group, key=lambda x: rb.STATUS_RANK[x[3]])[3]
        assert r.match_score == max((x[5] for x in group if x[5] is not None), default=None)
        assert (r.fee_amount is None) == all(x[6] is None for x in group)
    counts = out.counts.first()
    assert (counts.statements_scanned, counts.statements_linked, counts.accounts_created) == (scanned, linked, len(made))
    assert counts.transactions_merged == len(tx) - len(home) and counts.links_after == len(links_after)
    # Balances: of the statement's account, one for each method and time that moved there, and what was missing.
    balances = out.snapshots.collect()
    assert all(r.account_id == name(targets[r.statement_id]) for r in balances)
    methods = {(s[2], s[3]) for s in snapshots}
    for s in sheets:
        for method, at, value in (("statement_opening_balance", s[7], s[9]), ("statement_closing_balance", s[8], s[10])):
            n = sum((r.statement_id, r.method) == (s[0], method) for r in balances)
            if (s[0], method) not in methods:
                assert n == (at is not None and value is not None)
            else:
                stay = sum(x[2:4] == (s[0], method) and x[1] == name(targets[s[0]]) for x in snapshots)
                assert n == max(1, stay)
    assert counts.exceptions_created == sum(s[11] == "mismatch" and s[0] != "s1" for s in sheets)
    used = set(map(name, targets.values())) | {name(a) for a in home.values()} | {r.account_id for r in balances}
    lost = left | {s[1] for s in snapshots if s[1] != name(targets[s[2]])}
    assert {r.id for r in out.deleted_accounts.collect()} == {a for a in lost if a not in used and a in {x[0] for x in accounts}}


def test_a_chain_of_moves(spark):
    """a merges into b through one statement, and a later statement of a's row takes b along into c's account, where it merges again."""
    row = lambda i, at, created: {"id": i, "account_id": at, "created_at": created, "st_created": None, "st_id": None, "target": None, "raw_text": None, "by_row": None}
    seen = [row("b", "B", 2), row("c", "C", 3), {**row("a", "A", 1), "st_created": 1, "st_id": "s1", "target": "B", "raw_text": "x", "by_row": True}, {**row("a", "A", 1), "st_created": 2, "st_id": "s2", "target": "C", "raw_text": "y", "by_row": True}]
    assert sorted(rb.settle(seen)) == [("a", "c", "C", ["A"]), ("b", "c", "C", ["B"])]
