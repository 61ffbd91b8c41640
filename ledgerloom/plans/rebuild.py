"""The rebuild of a ledger whose statements' accounts were told anew: what it counts and what it changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators.rebuild import Rebuilt, rebuild
from ledgerloom.plans.registry import register
from ledgerloom.sources.ledger import Ledger, duck

#: A ledger to rebuild: statements by file, some without an account yet; transactions of accounts that aren't their
#: statements', some of which have an equal where they go; links of both; balances at an account that ends.
MISMATCH = "reconcile_mismatch"
TABLES = {
    "statements": """select id, timestamp '2024-02-01 00:00:00' as created_at, case when id like '%_ov' then null else account_id end as account_id, 'bank' as provider, 'card' as account_type,
      account_id as display, 'RUB' as currency, case when id like '%_0' then timestamp '2024-01-01 00:00:00' end as period_start, timestamp '2024-01-31 00:00:00' as period_end,
      cast(100 as decimal(14,2)) as opening_balance, case when id like '%_2' then null else cast(90 as decimal(14,2)) end as closing_balance, reconcile_status from {sheets}""",
    "accounts": """select distinct account_id as id, 'bank' as provider, 'card' as account_type, account_id as display, 'RUB' as currency, timestamp '2024-01-01 00:00:00' as created_at from {sheets}
      where id not like '%_ov' or cast(split_part(id, '_', 2) as int) % 2 = 0
      union all select id, 'bank', 'card', id, 'RUB', timestamp '2024-01-01 00:00:00' from (select 'acc_gone' as id union all select 'acc_old') as o""",
    "transactions": """select id, case when e % 9 <> 0 then account_id when e % 97 = 0 or e % 211 = 0 then 'acc_old' else 'acc_gone' end as account_id, created_at, amount, currency, direction, description_raw,
        bank_reference_id, bank_category, coalesce(operation_datetime, created_at) as operation_datetime, posting_datetime, cast(null as string) as source_statement_id
      from (select *, cast(substr(id, 4) as int) as e from {transactions}) as t
      union all select 'c' || id, 'acc_a' || substr(account_id, 5), created_at, amount, currency, direction, description_raw, bank_reference_id, bank_category, coalesce(operation_datetime, created_at), posting_datetime, null
      from {transactions} where cast(substr(id, 4) as int) % 16 = 0 and cast(substr(account_id, 5) as int) % 2 = 0""",
    "links": "select transaction_id, statement_row_id from {links}",
    "rows": "select id, statement_id, raw_text from {statement_rows}",
    "transfer_links": """select id, transaction_out_id, transaction_in_id, status, status as rationale, cast(match_score as double) as match_score, cast(null as double) as fee_amount from {transfer_links}
      union all select 'd' || id, 'c' || transaction_out_id, transaction_in_id, 'rejected', 'copy', 0.9, 1.5 from {transfer_links} where cast(substr(id, 4) as int) % 16 = 0""",
    "snapshots": """select 'b' || id as id, 'acc_gone' as account_id, id as statement_id, 'statement_opening_balance' as method, timestamp '2024-01-01 00:00:00' as ts, cast(100 as decimal(14,2)) as balance
      from {sheets} where id like '%_0' and cast(split_part(id, '_', 2) as int) % 3 = 0""",
    "exceptions": f"select '{MISMATCH}' as exception_type, 'statement' as entity_type, id as entity_id, 'open' as status from {{sheets}} where id like '%_1' and cast(split_part(id, '_', 2) as int) % 2 = 0",
}
_NAMES = ("statements", "accounts", "transactions", "links", "rows", "transfer_links", "snapshots", "exceptions")


def rebuilt(spark: SparkSession, sf_dir: str) -> Rebuilt:
    ledger = Ledger(spark, sf_dir)
    return rebuild(*[ledger.sql(TABLES[n]) for n in _NAMES], MISMATCH)


#: No two transactions of this ledger are equal but for a copy in the account that its original goes to.
SQL_REBUILT = ", ".join(f"{n}_ as ({t})" for n, t in TABLES.items()) + """,
targets as (select s.id, s.account_id, s.reconcile_status, s.period_start, s.period_end, s.opening_balance, s.closing_balance, a.id is null as is_new,
  coalesce(a.id, 'acct_' || substr(sha1('bank|card|' || s.display || '|RUB'), 1, 16)) as target from statements_ s left join accounts_ a using (provider, account_type, display, currency)),
seen as (select l.transaction_id as id, t.target, t.id as st from links_ l join rows_ r on r.id = l.statement_row_id join targets t on t.id = r.statement_id join transactions_ x on x.id = l.transaction_id),
paths as (select id, arg_max(target, st) as last, list(distinct target) as at from seen group by id),
moved as (select p.id, t.account_id as was, p.last, p.at from paths p join transactions_ t using (id) where len(list_filter(p.at, lambda a: a is distinct from t.account_id)) > 0),
changes as (select m.id, coalesce(c.id, m.id) as into_id, m.last as account_id, m.was from moved m left join transactions_ c on c.id = 'c' || m.id and c.account_id = m.last),
ends as (select t.id, coalesce(c.account_id, t.account_id) as account_id from transactions_ t left join changes c using (id) where c.id is null or c.into_id = c.id),
links_after as (select distinct coalesce(c.into_id, l.transaction_id) as id, l.statement_row_id from links_ l left join changes c on c.id = l.transaction_id),
transfers_after as (select coalesce(o.into_id, t.transaction_out_id) as out_id, coalesce(i.into_id, t.transaction_in_id) as in_id, max(match_score) as score, max(fee_amount) as fee,
    arg_max(status, case status when 'confirmed' then 4 when 'rejected' then 3 when 'auto' then 2 else 1 end) as status
  from transfer_links_ t left join changes o on o.id = t.transaction_out_id left join changes i on i.id = t.transaction_in_id group by 1, 2 having out_id <> in_id),
wanted as (select id, 'statement_opening_balance' as method from targets where period_start is not null and opening_balance is not null
  union all select id, 'statement_closing_balance' from targets where period_end is not null and closing_balance is not null),
missing as (select * from wanted w where not exists (select 1 from snapshots_ s where s.statement_id = w.id and s.method = w.method)),
lost as (select was as id from changes union select s.account_id from snapshots_ s join targets t on t.id = s.statement_id where s.account_id <> t.target),
deleted as (select id from lost where id in (select id from accounts_) and id not in (select target from targets) and id not in (select account_id from ends))"""


@register("rebuild_counts", duck(f"""with {SQL_REBUILT} select (select count(*) from targets) as statements_scanned, (select count(*) from targets where account_id is null) as statements_linked,
  (select count(distinct target) from targets where is_new) as accounts_created, (select count(*) from missing) as snapshots_created,
  (select count(*) from targets where reconcile_status = 'mismatch' and id not in (select entity_id from exceptions_)) as exceptions_created,
  (select count(*) from changes where id = into_id) as transactions_moved, (select count(*) from changes where id <> into_id) as transactions_merged, (select count(*) from links_after) as links_after,
  (select count(*) from transfers_after) as transfers_after, (select count(*) from deleted) as accounts_deleted"""))  # fmt: skip
def rebuild_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many statements, accounts, balances, exceptions, transactions and links a rebuild looks at, makes, moves, merges and deletes."""
    return rebuilt(spark, sf_dir).counts


@register("rebuild_transactions", duck(f"with {SQL_REBUILT} select id, account_id from ends"))
def rebuild_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions that are left and the accounts they are in."""
    return rebuilt(spark, sf_dir).transactions.select("id", "account_id")


@register("rebuild_transfers", duck(f"with {SQL_REBUILT} select out_id, in_id, status, score, fee from transfers_after"))
def rebuild_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfer links after the merges, with the strongest status, the best score and a known fee of those that fell together."""
    found = rebuilt(spark, sf_dir).transfer_links
    return found.selectExpr("transaction_out_id as out_id", "transaction_in_id as in_id", "status", "match_score as score", "fee_amount as fee")
