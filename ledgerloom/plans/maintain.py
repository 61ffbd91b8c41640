"""Rules, guardrails, imports, deletions and the reading of statement texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.registry import register
from ledgerloom.sources.ledger import Ledger, duck

@register("source_key", duck("select id, coalesce(nullif(regexp_extract(lower(pdf_path), '(all_[^/]*\\.pdf)$', 1), ''), regexp_replace(lower(pdf_path), '^.*/', '')) as source from {statements}"))
def source_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.lower("pdf_path")
    found = F.regexp_extract(path, r"(all_[^/]*\.pdf)$", 1)
    return Ledger(spark, sf_dir).statements.select("id", F.coalesce(F.nullif(found, F.lit("")), F.regexp_replace(path, "^.*/", "")).alias("source"))


SQL_ORPHANS = """gone as (select id from {statement_rows} where statement_id = 'st_1_0'),
touched as (select distinct transaction_id as id from {links} where statement_row_id in (select id from gone)),
kept as (select distinct transaction_id as id from {links} where statement_row_id not in (select id from gone)),
orphans as (select id from touched where id not in (select id from kept))"""


def orphans(ledger: Ledger, statement: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of a statement, its links, and the transactions that no other row holds."""
    gone = ledger.statement_rows.where(F.col("statement_id") == statement).select(F.col("id").alias("statement_row_id"))
    links = ledger.links.join(gone, "statement_row_id", "left_semi")
    kept = ledger.links.join(gone, "statement_row_id", "left_anti").select("transaction_id")
    return gone, links, links.select("transaction_id").distinct().join(kept, "transaction_id", "left_anti")


@register("orphan_tx", duck(f"with {SQL_ORPHANS} select id from orphans"))
def orphan_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(Ledger(spark, sf_dir), "st_1_0")[2].withColumnRenamed("transaction_id", "id")


@register("delete_statement_counts", duck(f"""with {SQL_ORPHANS} select (select count(*) from gone) as n_rows, (select count(*) from {{links}} where statement_row_id in (select id from gone)) as n_links,
  (select count(*) from orphans) as n_tx, (select count(*) from {{transfer_links}} where transaction_out_id in (select id from orphans) or transaction_in_id in (select id from orphans)) as n_transfers"""))  # fmt: skip
def delete_statement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes with a statement; transactions that other statements hold stay."""
    ledger = Ledger(spark, sf_dir)
    gone, links, alone = orphans(ledger, "st_1_0")
    sides = ledger.transfer_links.select("id", F.explode(F.array("transaction_out_id", "transaction_in_id")).alias("transaction_id"))
    transfers = sides.join(alone, "transaction_id", "left_semi").select("id").distinct()
    out = gone.agg(F.count("*").alias("n_rows"))
    for name, part in (("n_links", links), ("n_tx", alone), ("n_transfers", transfers)):
        out = out.join(F.broadcast(part.agg(F.count("*").alias(name))))  # one row each
    return out


@register("purge_counts", duck("select 'transactions' as name, count(*) as n from {transactions} union all select 'links', count(*) from {links} union all select 'transfer_links', count(*) from {transfer_links} union all select 'statements', count(*) from {statements}"))
def purge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger(spark, sf_dir)
    names = ("transactions", "links", "transfer_links", "statements")
    parts = [getattr(ledger, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])
