"""Rebuilding a ledger after its statements' accounts were told anew.

Statements are taken by creation. Each belongs to the account of its identity, which is made where there is none;
its transactions move there, or, where the account has an equal one, merge into that: the rows of the merged
one then belong to the other, which a later statement of those rows takes along in turn.

Only transactions that are equal in all fields ever meet, so each set of equals is settled by itself. Sets of one
(nearly all) are settled by expressions over the statements of a transaction; sets of several, if any of them
moves, by a grouped function that holds one set. What comes out is one relation, id to id and account, closed
over all steps; every table is rewritten by one join with it.

Equals agree in amount, texts and both times, so a set is a handful of rows; it is the unit of the fold, and a set of n
transactions costs a task the memory of n short rows. Null account ids of transactions are no account.
"""

from __future__ import annotations

from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.graph import written

IDENTITY = ["provider", "account_type", "display", "currency"]
#: What equal transactions agree in; times may be unknown on both sides.
EQUAL = ["amount", "currency", "direction", "description_raw", "bank_reference_id", "bank_category", "operation_datetime", "posting_datetime"]
STATUS_RANK = {"confirmed": 4, "rejected": 3, "auto": 2, "suggested": 1}
CHANGES = "id string, into string, account_id string, lost array<string>"


class Rebuilt(NamedTuple):
    """The tables after a rebuild, and what became of each transaction and account."""

    statements: DataFrame
    accounts: DataFrame
    transactions: DataFrame
    links: DataFrame
    transfer_links: DataFrame
    snapshots: DataFrame
    exceptions: DataFrame
    changes: DataFrame
    deleted_accounts: DataFrame
    counts: DataFrame


def account_id(*identity: Column) -> Column:
    """The id of a new account, from what it is."""
    return F.concat(F.lit("acct_"), F.substring(F.sha1(F.concat_ws("|", *identity)), 1, 16))


def resolved(statements: DataFrame, accounts: DataFrame) -> DataFrame:
    """Statements with ``target``, the account of their identity, and whether that is new; of several the first made."""
    known = accounts.groupBy(*IDENTITY).agg(F.min_by("id", F.struct("created_at", "id")).alias("known"))
    told = statements.join(known, IDENTITY, "left")
    return told.withColumn("target", F.coalesce("known", account_id(*map(F.col, IDENTITY)))).withColumn("is_new", F.col("known").isNull()).drop("known")


def visits(statements: DataFrame, transactions: DataFrame, links: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, st_created, st_id, target, raw_text, by_row): each statement that holds a transaction, by a row of it or as its source."""
    sheets = statements.select(F.col("id").alias("st_id"), F.col("created_at").alias("st_created"), "target")
    own = rows.select(F.col("id").alias("statement_row_id"), F.col("statement_id").alias("st_id"), "raw_text")
    by_row = links.join(own, "statement_row_id").select(F.col("transaction_id").alias("id"), "st_id", "raw_text", F.lit(True).alias("by_row"))
    by_source = transactions.where("source_statement_id is not null").select("id", F.col("source_statement_id").alias("st_id"), F.lit(None).cast("string").alias("raw_text"), F.lit(False).alias("by_row"))
    return by_row.union(by_source).join(sheets, "st_id").select("id", "st_created", "st_id", "target", "raw_text", "by_row")


def settled_alone(seen: DataFrame) -> DataFrame:
    """Changes of transactions that have no equals: the last statement's account, and the accounts left on the way."""
    places = F.sort_array(F.collect_set(F.struct("st_created", "st_id", "target")))
    told = seen.where("st_id is not null").groupBy("id").agg(F.first("account_id").alias("account_id"), places.alias("at"))
    path = told.withColumn("path", F.concat(F.array("account_id"), F.transform("at", lambda x: x["target"])))
    left = F.filter("path", lambda x, i: x.isNotNull() & (i < F.size("path") - 1) & ~x.eqNullSafe(F.get("path", i + 1)))
    done = path.select("id", F.col("id").alias("into"), F.element_at("path", -1).alias("account_id"), F.array_distinct(left).alias("lost"), F.exists("path", lambda x: ~x.eqNullSafe(F.col("account_id"))).alias("moved"))
    return done.where("moved").drop("moved")


def settle(rows: list[dict[str, Any]]) -> list[tuple[str, str, str | None, list[str]]]:
    """(id, into, account, accounts left) of the equals whose account or id changes, statement by statement."""
    account, born, texts, lost, into = {}, {}, {}, {}, {}
    # Of each statement its account, the transactions that it holds, and those that it holds by a row.
    sheets: dict[tuple[Any, str], tuple[str, set[str], set[str]]] = {}
    for r in rows:
        i = r["id"]
        account[i], born[i] = r["account_id"], (r["created_at"] is None, r["created_at"], i)
        texts.setdefault(i, set())
        lost.setdefault(i, [])
        if r["st_id"] is not None:
            _, held, by_row = sheets.setdefault((r["st_created"], r["st_id"]), (r["target"], set(), set()))
            held.add(i)
            if r["by_row"]:
                by_row.add(i)
            if r["raw_text"]:
                texts[i].add(r["raw_text"])
    before = dict(account)
    for target, held, _ in (sheets[k] for k in sorted(sheets)):
        for i in sorted(held, key=born.get):
            if i not in account or account[i] == target:
                continue
            if account[i] and account[i] not in lost[i]:
                lost[i].append(account[i])
            there = sorted((c for c, a in account.items() if a == target), key=born.get)
            if not there:
                account[i] = target
                continue
            alike = [c for c in there if texts[c] & texts[i]] if len(there) > 1 else []
            c = (alike or there)[0]
            into[i] = c
            texts[c] |= texts[i]
            for _, others, by_row in sheets.values():
                if i in by_row:
                    by_row.add(c)
                    others.add(c)
            del account[i]
    out = []
    for i, was in before.items():
        end = i
        while end in into:
            end = into[end]
        if end != i or account[end] != was or lost[i]:
            out.append((i, end, account[end], lost[i]))
    return out


def _settle_set(rows: pd.DataFrame) -> pd.DataFrame:
    plain = rows.astype(object).where(rows.notna(), None).to_dict("records")
    return pd.DataFrame(settle(plain), columns=["id", "into", "account_id", "lost"])


def changes_of(transactions: DataFrame, seen: DataFrame) -> DataFrame:
    """(id, into, account_id, lost) of every transaction that moves or merges."""
    said = [F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") if c.endswith("datetime") else F.col(c).cast("string"), F.lit("\x00")) for c in EQUAL]
    own = transactions.select("id", "account_id", "created_at", F.sha2(F.concat_ws("\x1f", *said), 256).alias("equals"))
    held = written(own.join(seen, "id", "left"), "visits")
    moves = F.col("st_id").isNotNull() & ~F.col("target").eqNullSafe(F.col("account_id"))
    sets = held.groupBy("equals").agg(F.max(moves).alias("moves"), F.min("id").alias("least"), F.max("id").alias("most")).where("moves")
    alone = held.join(sets.where("least = most").select("equals"), "equals", "left_semi")
    several = held.join(sets.where("least <> most").select("equals"), "equals", "left_semi")
    return written(settled_alone(alone).unionByName(several.groupBy("equals").applyInPandas(_settle_set, CHANGES)), "changes")


def relinked(transfer_links: DataFrame, changes: DataFrame) -> DataFrame:
    """Transfer links between what their ends became; links within one go, of several of a pair one stays.

    That is the one that was between the two already, or else the least id; it has the strongest status with
    that link's rationale, the best score, and its own fee, or the first one that is known.
    """
    end = lambda side: changes.select(F.col("id").alias(side), F.col("into").alias(f"{side}_new"))
    sides = ("transaction_out_id", "transaction_in_id")
    told = transfer_links.join(end(sides[0]), sides[0], "left").join(end(sides[1]), sides[1], "left")
    told = told.withColumn("stood", F.coalesce(F.col(f"{sides[0]}_new") == F.col(sides[0]), F.lit(True)) & F.coalesce(F.col(f"{sides[1]}_new") == F.col(sides[1]), F.lit(True)))
    told = told.withColumns({s: F.coalesce(f"{s}_new", s) for s in sides}).drop(*[f"{s}_new" for s in sides]).where("transaction_out_id <> transaction_in_id or stood")
    first = F.struct((~F.col("stood")).alias("moved"), "id")
    rank = F.coalesce(*[F.when(F.col("status") == s, n) for s, n in STATUS_RANK.items()], F.lit(0))
    strongest = F.struct(rank.alias("rank"), F.col("stood").alias("stood"))
    one = told.groupBy(*sides).agg(
        F.min_by("id", first).alias("id"), F.max_by(F.struct("status", "rationale"), F.struct(strongest, F.when(F.col("stood"), 1).otherwise(0))).alias("kept"),
        F.max("match_score").alias("match_score"), F.min_by("fee_amount", F.when(F.col("fee_amount").isNotNull(), first)).alias("fee_amount"),
    )
    return one.select("id", *sides, "kept.status", "kept.rationale", "match_score", "fee_amount")


def rehomed(snapshots: DataFrame, statements: DataFrame) -> DataFrame:
    """Balances of the statements' accounts; one that moves to where its statement, method and time are known goes. ``left`` is the account it left."""
    own = snapshots.join(statements.select(F.col("id").alias("statement_id"), "target"), "statement_id", "left")
    stays = F.col("target").isNull() | F.col("account_id").eqNullSafe(F.col("target"))
    told = own.withColumns({"stays": stays, "left": F.when(~stays, F.col("account_id")), "account_id": F.coalesce("target", "account_id")}).drop("target")
    key = ["account_id", "statement_id", "method", "ts"]
    first = told.groupBy(*key).agg(F.min(F.struct((~F.col("stays")).alias("moved"), "id")).alias("first"))
    kept = told.join(first, key, "left")
    return kept.withColumn("gone", ~F.col("stays") & (F.col("first.moved").eqNullSafe(F.lit(False)) | (F.col("first.id") != F.col("id")))).drop("first", "stays")


def balances(statements: DataFrame) -> DataFrame:
    """Up to two balances of each statement, of its account, with ids from what they are."""
    one = lambda at, balance, method: F.struct(F.col(at).alias("ts"), F.col(balance).alias("balance"), F.lit(method).alias("method"))
    both = F.array(one("period_start", "opening_balance", "statement_opening_balance"), one("period_end", "closing_balance", "statement_closing_balance"))
    told = statements.select(F.col("id").alias("statement_id"), F.col("target").alias("account_id"), F.explode(both).alias("s")).where("s.ts is not null and s.balance is not null")
    new = F.concat(F.lit("bs_"), F.substring(F.sha1(F.concat_ws("|", "statement_id", "s.method")), 1, 16))
    return told.select(new.alias("id"), "account_id", "statement_id", "s.method", "s.ts", "s.balance")


def rebuild(statements: DataFrame, accounts: DataFrame, transactions: DataFrame, links: DataFrame, rows: DataFrame, transfer_links: DataFrame, snapshots: DataFrame, exceptions: DataFrame, mismatch: str) -> Rebuilt:
    """All tables as a rebuild leaves them. ``mismatch`` is the type of the exceptions of statements that don't add up.

    An account that lost a transaction or a balance goes if in the end no statement, transaction or balance
    has it. A new exception or balance is made only where its statement has none of that kind.
    """
    told = written(resolved(statements, accounts), "resolved")
    made = told.where("is_new").select(F.col("target").alias("id"), *IDENTITY).distinct()
    changes = changes_of(transactions, visits(told, transactions, links, rows))
    after = transactions.join(changes.withColumnRenamed("account_id", "new_account"), "id", "left").where("into is null or into = id")
    after = after.withColumn("account_id", F.coalesce("new_account", "account_id")).drop("new_account", "into", "lost")
    by_id = changes.select(F.col("id").alias("transaction_id"), "into")
    own_links = links.join(by_id, "transaction_id", "left").select(F.coalesce("into", "transaction_id").alias("transaction_id"), "statement_row_id").distinct()
    transfers = relinked(transfer_links, changes)
    placed = written(rehomed(snapshots, told), "balances")
    missing = balances(told).join(placed.where("not gone").select("statement_id", "method").distinct(), ["statement_id", "method"], "left_anti")
    all_balances = placed.where("not gone").drop("gone", "left").unionByName(missing, allowMissingColumns=True)
    stored = exceptions.where((F.col("exception_type") == mismatch) & (F.col("entity_type") == "statement")).select(F.col("entity_id").alias("id"))
    fresh = told.where("reconcile_status = 'mismatch'").join(stored, "id", "left_anti")
    new_exceptions = fresh.select(F.lit(mismatch).alias("exception_type"), F.lit("statement").alias("entity_type"), F.col("id").alias("entity_id"), F.lit("open").alias("status"))
    losers = changes.select(F.explode("lost").alias("id")).union(placed.where("left is not null").select("left")).distinct()
    in_use = told.select("target").union(after.select("account_id")).union(all_balances.select("account_id")).toDF("id").where("id is not null").distinct()
    deleted = losers.join(in_use, "id", "left_anti").join(accounts.select("id"), "id", "left_semi")
    linked = told.where("account_id is null").agg(F.count("*").alias("statements_linked"))
    counts = told.agg(F.count("*").alias("statements_scanned")).join(F.broadcast(linked))  # one row each, here and below
    parts = {
        "accounts_created": made, "snapshots_created": missing, "exceptions_created": new_exceptions, "transactions_moved": changes.where("into = id"), "transactions_merged": changes.where("into <> id"),
        "links_after": own_links, "transfers_after": transfers, "accounts_deleted": deleted,
    }
    for name, part in parts.items():
        counts = counts.join(F.broadcast(part.agg(F.count("*").alias(name))))
    return Rebuilt(
        told.withColumn("account_id", F.col("target")).drop("target", "is_new"), accounts.join(deleted, "id", "left_anti").unionByName(made, allowMissingColumns=True),
        after, own_links, transfers, all_balances, exceptions.unionByName(new_exceptions, allowMissingColumns=True), changes, deleted, counts,
    )
