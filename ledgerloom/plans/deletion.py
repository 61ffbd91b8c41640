"""Deletions of files, statements and batches as rows of every table, and the purge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import deletion
from ledgerloom.plans.registry import register
from ledgerloom.sources.ledger import Ledger, duck

#: The ledger's tables as a store: balances and exceptions of statements, exceptions of files, a file and a batch of nothing.
TABLES = {
    "batches": "select distinct batch_id as id from {sheets} union all select 'b_none'",
    "files": "select distinct file_id as id, batch_id from {sheets} union all select 'f_none', 'b_1'",
    "statements": "select id, file_id, pdf_path from {sheets}",
    "rows": "select id, statement_id from {statement_rows}",
    "links": "select transaction_id, statement_row_id from {links}",
    "transactions": "select id from {transactions}",
    "transfer_links": "select id, transaction_out_id, transaction_in_id from {transfer_links}",
    "snapshots": "select 'o' || id as id, id as statement_id from {sheets} where id like '%_0' union all select 'c' || id, id from {sheets}",
    "exceptions": """select id, entity_type, entity_id from {exceptions} union all select 'ex_' || id, 'statement', id from {sheets} where id like '%_1'
      union all select distinct 'ex_' || file_id, 'import_file', file_id from {sheets} where file_id like '%1'""",
    "rules": "select id from {rules}",
    "accounts": "select id from {accounts}",
}
_WITH = ", ".join(f"{n}_ as ({t})" for n, t in TABLES.items())
#: Built upon own_files and sheets_, which say what is asked for.
_GONE = """own_rows as (select id from rows_ where statement_id in (select id from sheets_)), own_links as (select * from links_ where statement_row_id in (select id from own_rows)),
lost as (select distinct transaction_id as id from own_links where transaction_id not in (select transaction_id from links_ where statement_row_id not in (select id from own_rows))),
gone as (select 'files' as name, id from own_files union all select 'statements', id from sheets_ union all select 'rows', id from own_rows
  union all select 'links', transaction_id || '/' || statement_row_id from own_links union all select 'transactions', id from transactions_ where id in (select id from lost)
  union all select 'transfer_links', id from transfer_links_ where transaction_out_id in (select id from lost) or transaction_in_id in (select id from lost)
  union all select 'snapshots', id from snapshots_ where statement_id in (select id from sheets_)
  union all select 'exceptions', id from exceptions_ where (entity_type = 'statement' and entity_id in (select id from sheets_)) or (entity_type = 'transaction' and entity_id in (select id from lost))
    or (entity_type = 'import_file' and entity_id in (select id from own_files))"""
_EMPTIED = " union all select 'batches', b.id from batches_ b where id in (select batch_id from files_ where id in (select id from own_files)) and id not in (select batch_id from files_ where id not in (select id from own_files)))"
_KEY = {**dict.fromkeys(deletion.KEYS, "id"), "links": "transaction_id || '/' || statement_row_id"}


def store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    ledger = Ledger(spark, sf_dir)
    return {name: ledger.sql(text) for name, text in TABLES.items()}


def ids(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "id string")


def named(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, id) of the rows of all tables."""
    one = lambda name, rows: rows.select(F.lit(name).alias("name"), F.concat_ws("/", *deletion.KEYS[name]).alias("id"))
    return reduce(DataFrame.union, [one(name, rows) for name, rows in tables.items()])


@register("delete_files", duck(f"with {_WITH}, own_files as (select id from files_ where id in ('f_1', 'f_3', 'f_7', 'f_11')), sheets_ as (select id from statements_ where file_id in (select id from own_files)), {_GONE}{_EMPTIED} select name, id from gone"))
def delete_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that goes with four files; three of them are all that their batch has."""
    return named(deletion.gone(store(spark, sf_dir), files=ids(spark, "f_1", "f_3", "f_7", "f_11", "f_unknown")))


@register("delete_statements", duck(f"with {_WITH}, own_files as (select id from files_ where false), sheets_ as (select id from statements_ where id in ('st_2_1', 'st_2_ov')), {_GONE}) select name, id from gone"))
def delete_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(deletion.gone(store(spark, sf_dir), statements=ids(spark, "st_2_1", "st_2_ov")))


_BATCHES = f"with {_WITH}, own_files as (select id from files_ where batch_id = 'b_1'), sheets_ as (select id from statements_ where file_id in (select id from own_files)), {_GONE} union all select 'batches', id from batches_ where id in ('b_1', 'b_none'))"
_ALL = " union all ".join(f"select '{n}' as name, {k} as id from {n}_" for n, k in _KEY.items())


@register("left_after_batches", duck(f"{_BATCHES} select name, count(*) as n, min(id) as first_id, max(id) as last_id from ({_ALL}) a where not exists (select 1 from gone g where g.name = a.name and g.id = a.id) group by 1"))
def left_after_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every table holds after a batch with files and one without any are deleted."""
    tables = store(spark, sf_dir)
    rest = deletion.left(tables, deletion.gone_with_batches(tables, ids(spark, "b_1", "b_none")))
    return named(rest).groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@register("purge_all", duck(f"with {_WITH} " + " union all ".join(f"select '{n}' as name, count(*) as n, 0::bigint as n_left from {n}_" for n in TABLES)))
def purge_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table before a purge and after it."""
    had, rest = deletion.purge(store(spark, sf_dir), deletion.PURGE_TOKEN)
    return had.join(deletion.counts(rest).withColumnRenamed("n", "n_left"), "name")
