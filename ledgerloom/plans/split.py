"""The plan of splits applied to a ledger in which equal rows of a statement share a transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators.graph import written
from ledgerloom.operators.split import Split, apply_steps
from ledgerloom.plans.imports import SQL_KEYED, keyed
from ledgerloom.plans.registry import register
from ledgerloom.sources.ledger import Ledger, duck

#: Rows with references of their own, each group's transaction being that of its first row; an event's row may be
#: another's by now, and some of the keys are stored already, or named by two steps.
SQL_STEPS = """made as (select statement_row_id, account_id, key, reference, min(statement_row_id) over (partition by statement_id, account_id, currency, direction, amount, op, post, lower(trim(description)), bank_category, raw_text) as first
  from keyed where length(reference) = 24),
plan as (select replace(statement_row_id, 'row_', 'p_') as place, 'tx_' || first as transaction_id, account_id, statement_row_id, key as dedup_key, case when statement_row_id like '%81_c' then '' else reference end as reference from made where statement_row_id <> first
  union all select replace(statement_row_id, 'row_', 'q_'), 'tx_' || first, account_id, statement_row_id || case when statement_row_id like '%61_c' then '_none' else '' end, key, reference from made where statement_row_id like '%61_c' or statement_row_id like '%01_c'
  union all select replace(statement_row_id, 'row_', 'r_'), 'tx_' || first, account_id, first, key, reference from made where statement_row_id like '%81_c'),
transactions as (select distinct 'tx_' || first as id, account_id, 'key_' || first as dedup_key, '' as bank_reference_id, first as said from made union all
  select 'tx_stored_' || statement_row_id, account_id, key, reference, 'stored' from made where statement_row_id like '%41_c' union all select 'tx_other', 'acc_0', 'key_other', '', 'other'),
links as (select case when statement_row_id like '%21_c' then 'tx_other' else 'tx_' || first end as transaction_id, statement_row_id from made)"""


def split(spark: SparkSession, sf_dir: str) -> Split:
    rows = written(keyed(spark, sf_dir), "keyed")
    take = lambda name: spark.sql(f"with {SQL_STEPS.replace('from keyed', 'from {keyed}')} select * from {name}", keyed=rows)
    return apply_steps(take("plan"), take("transactions"), take("links"))


#: A row's steps in order; a step is done if none before it was, and of steps with one key the first makes the clone.
SQL_SPLIT = f"""{SQL_KEYED}, {SQL_STEPS},
told as (select p.*, l.transaction_id as owner, (select min(t.id) from transactions t where t.account_id is not distinct from p.account_id and t.dedup_key = p.dedup_key) as existing,
  exists (select 1 from transactions t where t.id = p.transaction_id) as there from plan p left join links l using (statement_row_id)),
judged as (select *, coalesce(owner = transaction_id and dedup_key <> '' and reference <> '', false) as reaches, coalesce(owner = transaction_id and dedup_key <> '' and reference <> '' and coalesce(existing <> transaction_id, there), false) as moves from told),
ordered as (select *, moves and row_number() over (partition by statement_row_id, moves order by place) = 1 as applied, coalesce(bool_or(moves) over (partition by statement_row_id order by place rows between unbounded preceding and 1 preceding), false) as after from judged),
done as (select *, applied and existing is null and row_number() over (partition by account_id, dedup_key, applied order by place) = 1 as clones from ordered)"""


@register("split_counts", duck(f"""with {SQL_SPLIT} select count(*) filter (where clones) as inserted_transactions, count(*) filter (where (applied and not clones) or (reaches and not moves and existing is not null and not after)) as reused_transactions,
  count(*) filter (where applied) as moved_statement_links, count(*) filter (where not applied) as skipped_rows from done"""))  # fmt: skip
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many transactions are cloned and reused, how many rows move, and how many steps are skipped."""
    return split(spark, sf_dir).counts


@register("split_steps", duck(f"with {SQL_SPLIT} select place, statement_row_id, case when applied then coalesce(existing, 'tx_' || substr(sha256(account_id || '|' || dedup_key), 1, 24)) end as target, case when clones then 'cloned' when applied then 'reused' else 'skipped' end as outcome from done"))
def split_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each step of the plan."""
    return split(spark, sf_dir).steps.select("place", "statement_row_id", "target", "outcome")


@register("split_transactions", duck(f"""with {SQL_SPLIT} select * from transactions union all
select 'tx_' || substr(sha256(d.account_id || '|' || d.dedup_key), 1, 24), d.account_id, d.dedup_key, d.reference, t.said from done d join transactions t on t.id = d.transaction_id where clones"""))  # fmt: skip
def split_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions after, the clones among them."""
    return split(spark, sf_dir).transactions
