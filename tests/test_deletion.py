"""Deletions against a plain loop that deletes file after file."""

import random

import pytest

from ledgerloom.operators import deletion

SCHEMAS = {
    "batches": "id string", "files": "id string, batch_id string", "statements": "id string, file_id string", "rows": "id string, statement_id string",
    "links": "transaction_id string, statement_row_id string", "transactions": "id string, amount int", "transfer_links": "id string, transaction_out_id string, transaction_in_id string",
    "snapshots": "id string, statement_id string", "exceptions": "id string, entity_type string, entity_id string", "rules": "id string", "accounts": "id string",
}


def case(seed):
    dice = random.Random(seed)
    pick = lambda letter, n: f"{letter}{dice.randrange(n)}"
    tables = {
        "batches": [(f"b{i}",) for i in range(4)],
        "files": [(f"f{i}", pick("b", 3)) for i in range(5)],
        "statements": [(f"s{i}", pick("f", 5) if i else None) for i in range(9)],
        "rows": [(f"r{i}", pick("s", 9) if i else None) for i in range(30)],
        "links": sorted({(pick("t", 14), pick("r", 30)) for _ in range(34)}) + [("t0", None), (None, "r3")],
        "transactions": [(f"t{i}", i) for i in range(12)] + [(None, 0)],
        "transfer_links": [(f"l{i}", pick("t", 14), pick("t", 14) if i else None) for i in range(10)],
        "snapshots": [(f"n{i}", pick("s", 9)) for i in range(8)],
        "exceptions": [(f"e{i}", kind, pick(letter, n)) for i, (kind, letter, n) in enumerate([("statement", "s", 9), ("transaction", "t", 14), ("import_file", "f", 5), ("transaction", "s", 9)] * 4)],
        "rules": [("u",)],
        "accounts": [("a",)],
    }
    return tables


def delete_file(t, file):
    batch = {f[1] for f in t["files"] if f[0] == file}
    delete_statements(t, [s[0] for s in t["statements"] if s[1] == file])
    t["exceptions"] = [e for e in t["exceptions"] if e[1:] != ("import_file", file)]
    t["files"] = [f for f in t["files"] if f[0] != file]
    t["batches"] = [b for b in t["batches"] if b[0] not in batch or b[0] in {f[1] for f in t["files"]}]


def delete_statements(t, sheets):
    for s in sheets:
        rows = {r[0] for r in t["rows"] if r[1] == s}
        touched = {x for x, r in t["links"] if r in rows}
        t["links"] = [x for x in t["links"] if x[1] not in rows]
        t["rows"] = [r for r in t["rows"] if r[1] != s]
        t["snapshots"] = [n for n in t["snapshots"] if n[1] != s]
        t["statements"] = [x for x in t["statements"] if x[0] != s]
        lost = touched - {x for x, _ in t["links"]} - {None}
        t["transfer_links"] = [x for x in t["transfer_links"] if not {x[1], x[2]} & lost]
        t["exceptions"] = [e for e in t["exceptions"] if e[1:] != ("statement", s) and not (e[1] == "transaction" and e[2] in lost)]
        t["transactions"] = [x for x in t["transactions"] if x[0] not in lost]


def found(tables):
    return {n: sorted((tuple(r) for r in df.collect()), key=str) for n, df in tables.items()}


def in_order(tables):
    return {n: sorted(rows, key=str) for n, rows in tables.items()}


@pytest.mark.parametrize("seed", range(3))
def test_against_a_loop(spark, seed):
    given = case(seed)
    tables = {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in given.items()}
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    # Two files and a statement at once.
    want = {n: list(rows) for n, rows in given.items()}
    delete_file(want, "f1")
    delete_file(want, "f3")
    delete_statements(want, ["s5"])
    columns = lambda rest: {n: df.select(tables[n].columns) for n, df in rest.items()}
    going = deletion.gone(tables, files=ids("f3", "f1", "f1", "f99"), statements=ids("s5", "s99"))
    assert found(columns(deletion.left(tables, going))) == in_order(want)
    assert {r.name: r.n for r in deletion.counts(going).collect()} == {n: len(given[n]) - len(want[n]) for n in going}
    # Batches, one of them without files.
    want = {n: list(rows) for n, rows in given.items()}
    for f in [f[0] for f in given["files"] if f[1] == "b0"]:
        delete_file(want, f)
    want["batches"] = [b for b in want["batches"] if b[0] not in ("b0", "b3")]
    assert found(columns(deletion.left(tables, deletion.gone_with_batches(tables, ids("b0", "b3"))))) == in_order(want)


def test_nothing_and_purge(spark):
    tables = {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in case(7).items()}
    assert all(r.n == 0 for r in deletion.counts(deletion.gone(tables)).collect())
    with pytest.raises(ValueError):
        deletion.purge(tables, "yes")
    had, rest = deletion.purge(tables, "delete-all")
    assert {r.name: r.n for r in had.collect()} == {n: len(rows) for n, rows in case(7).items()}
    assert all(df.count() == 0 and df.schema == tables[n].schema for n, df in rest.items())
