"""Accounts of transactions, merging of links, labelled rows against own ones, and the review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.columns import cents
from ledgerloom.plans.registry import register
from ledgerloom.sources.ledger import Ledger, duck


@register("tx_account", duck("""select t.id, coalesce(nullif(case when t.id like '%7' then '' else t.account_id end, ''), min(s.account_id)) as account
from {transactions} t left join {links} l on l.transaction_id = t.id left join {statement_rows} r on r.id = l.statement_row_id left join {sheets} s on s.id = r.statement_id group by t.id, t.account_id"""))  # fmt: skip
def tx_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction's own account, or where it has none the least account of its statements."""
    ledger = Ledger(spark, sf_dir)
    sheets = ledger.sheets.select(F.col("id").alias("statement_id"), F.col("account_id").alias("sheet_account"))
    rows = ledger.statement_rows.select(F.col("id").alias("statement_row_id"), "statement_id").join(sheets, "statement_id")
    derived = ledger.links.join(rows, "statement_row_id").groupBy(F.col("transaction_id").alias("id")).agg(F.min("sheet_account").alias("derived"))
    own = F.when(~F.col("id").endswith("7"), F.nullif("account_id", F.lit("")))
    return ledger.transactions.join(derived, "id", "left").select("id", F.coalesce(own, "derived").alias("account"))


@register("row_fingerprint", duck("""select id, sha256('row-v1|' || lower(trim(currency)) || '|' || lower(trim(direction)) || '|' || (abs(amount) * 100)::bigint || '|' || strftime(operation_date, '%Y-%m-%dT%H:%M:%S')
  || '|' || lower(trim(regexp_replace(raw_text, '\\s+', ' ', 'g')))) as print from {statement_rows}"""))  # fmt: skip
def row_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.lit("row-v1"), F.lower(F.trim("currency")), F.lower(F.trim("direction")), F.abs(cents(F.col("amount"))).cast("string"), F.date_format("operation_date", "yyyy-MM-dd'T'HH:mm:ss"), F.lower(F.trim(F.regexp_replace("raw_text", r"\s+", " ")))]
    return Ledger(spark, sf_dir).statement_rows.select("id", F.sha2(F.concat_ws("|", *parts), 256).alias("print"))


SQL_STATUS = "case status when 'confirmed' then 4 when 'rejected' then 3 when 'auto' then 2 else 1 end"


@register("remap_links", duck(f"""with moved as (select case when right(transaction_out_id, 1) = '0' then left(transaction_out_id, length(transaction_out_id) - 2) || '00' else transaction_out_id end as out_id,
  transaction_in_id as in_id, status, match_score, {SQL_STATUS} as rank, id from {{transfer_links}})
select out_id, in_id, arg_max(status, (rank, id)) as status, max(match_score) as score, count(*) as n from moved where out_id <> in_id group by 1, 2"""))  # fmt: skip
def remap_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links after transactions were merged: of links of one pair the strongest status and the best score stay."""
    out = F.col("transaction_out_id")
    merged = F.when(out.endswith("0"), F.concat(F.left(out, F.length(out) - 2), F.lit("00"))).otherwise(out)
    rank = F.when(F.col("status") == "confirmed", 4).when(F.col("status") == "rejected", 3).when(F.col("status") == "auto", 2).otherwise(1)
    pairs = Ledger(spark, sf_dir).transfer_links.select(merged.alias("out_id"), F.col("transaction_in_id").alias("in_id"), "status", "match_score", rank.alias("rank"), "id").where("out_id <> in_id")
    return pairs.groupBy("out_id", "in_id").agg(F.max_by("status", F.struct("rank", "id")).alias("status"), F.max("match_score").alias("score"), F.count("*").alias("n"))


@register("statement_tx", duck("""select distinct t.id from {transactions} t join {links} l on l.transaction_id = t.id join {statement_rows} r on r.id = l.statement_row_id where r.statement_id = 'st_2_ov'"""))
def statement_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger(spark, sf_dir)
    rows = ledger.statement_rows.where("statement_id = 'st_2_ov'").select(F.col("id").alias("statement_row_id"))
    ids = ledger.links.join(rows, "statement_row_id", "left_semi").select(F.col("transaction_id").alias("id"))
    return ledger.transactions.join(ids, "id", "left_semi").select("id")
