"""Searching, filtering, ordering and paging the ledger, and what needs review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.columns import blank, ledger_time, money, needs_review, text
from ledgerloom.plans.registry import register
from ledgerloom.sources.ledger import Ledger, duck


@register("scan_ledger", duck("select account_id, currency, count(*) as n_tx, sum(amount)::decimal(20,2) as total, min(created_at) as first_at, max(created_at) as last_at from {transactions} group by all"))
def scan_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = Ledger(spark, sf_dir).transactions
    return tx.groupBy("account_id", "currency").agg(F.count("*").alias("n_tx"), money(F.sum("amount")).alias("total"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@register("ledger_range", duck("select id, operation_datetime, amount from {transactions} where operation_datetime >= timestamp '2024-01-05' and operation_datetime <= timestamp '2024-01-12'"))
def ledger_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the time of operation alone: rows without one are out of any range."""
    at = F.col("operation_datetime")
    return Ledger(spark, sf_dir).transactions.where((at >= F.lit("2024-01-05").cast("timestamp_ntz")) & (at <= F.lit("2024-01-12").cast("timestamp_ntz"))).select("id", "operation_datetime", "amount")


@register("ledger_filters", duck("select id, account_id, amount from {transactions} where account_id = 'acc_3' and direction = 'out' and currency = 'RUB' and meaning = 'spend' and review_status = 'reviewed'"))
def ledger_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"account_id": "acc_3", "direction": "out", "currency": "RUB", "meaning": "spend", "review_status": "reviewed"}
    tx = Ledger(spark, sf_dir).transactions
    for name, value in wanted.items():
        tx = tx.where(F.col(name) == value)
    return tx.select("id", "account_id", "amount")


SEARCHED = ("description_raw", "merchant_normalized", "bank_category", "bank_reference_id")


@register("ledger_search", duck("select id, description_raw from {transactions} where " + " or ".join(f"{c} ilike '%m_rchant 1%'" for c in SEARCHED)))
def ledger_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any of four columns, in either case; % and _ in the search are wild cards."""
    tx = Ledger(spark, sf_dir).transactions
    hit = F.lit(False)
    for name in SEARCHED:
        hit = hit | F.col(name).ilike("%m_rchant 1%")
    return tx.where(hit).select("id", "description_raw")


@register("category_empty", duck("select length(trim(coalesce(category, ''))) = 0 as empty, count(*) as n_tx from {transactions} group by 1"))
def category_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ledger(spark, sf_dir).transactions.groupBy(blank("category").alias("empty")).agg(F.count("*").alias("n_tx"))


@register("tags_any", duck("select id, tag_list from {transactions} where list_has_any(string_split(coalesce(tag_list, ''), ','), ['work', 'trip'])"))
def tags_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ledger(spark, sf_dir).transactions.where(F.arrays_overlap(F.split(text("tag_list"), ","), F.array(F.lit("work"), F.lit("trip")))).select("id", "tag_list")


SQL_REVIEW = """(length(trim(coalesce(category, ''))) = 0 and lower(trim(meaning)) not in ('internal_transfer', 'external_transfer') and lower(trim(bank_category)) <> 'transfer'
  and not (direction = 'out' and trim(merchant_normalized) <> '' and bank_category <> 'transfer')
  and not (direction = 'out' and meaning in ('spend', 'fee') and (trim(merchant_normalized) <> '' or (bank_category <> '' and bank_category <> 'transfer')))
  and not (direction = 'in' and meaning in ('income', 'refund', 'cashback', 'interest') and (trim(merchant_normalized) <> '' or (bank_category <> '' and bank_category <> 'transfer'))))"""


@register("needs_review", duck(f"select id, meaning, category from {{transactions}} where {SQL_REVIEW}"))
def needs_review_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ledger(spark, sf_dir).transactions.where(needs_review()).select("id", "meaning", "category")


@register("review_reasons", duck(f"select direction, case when {SQL_REVIEW} then 'uncategorized' else '' end as reasons, count(*) as n_tx from {{transactions}} group by all"))
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = F.array_join(F.when(needs_review(), F.array(F.lit("uncategorized"))).otherwise(F.array()), ",")
    return Ledger(spark, sf_dir).transactions.groupBy("direction", reasons.alias("reasons")).agg(F.count("*").alias("n_tx"))


ORDER = "coalesce(operation_datetime, posting_datetime, created_at) desc nulls last, case when timestamp_precision in ('date_only', 'unknown') then id else '' end desc, created_at desc nulls last, id desc"


def ordered(tx: DataFrame) -> DataFrame:
    """Newest first; rows that only have a date are told apart by their place, here their id."""
    place = F.when(F.col("timestamp_precision").isin("date_only", "unknown"), F.col("id")).otherwise("")
    return tx.orderBy(ledger_time().desc_nulls_last(), place.desc(), F.col("created_at").desc_nulls_last(), F.col("id").desc())


@register("ledger_order", duck(f"select id, amount from {{transactions}} order by {ORDER} limit 500"))
def ledger_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(Ledger(spark, sf_dir).transactions).limit(500).select("id", "amount")


@register("ledger_page", duck(f"select id, amount, (select count(*) from {{transactions}}) as n_all from {{transactions}} order by {ORDER} limit 50 offset 100"))
def ledger_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = Ledger(spark, sf_dir).transactions
    count = tx.agg(F.count("*").alias("n_all"))
    return ordered(tx).offset(100).limit(50).select("id", "amount").join(F.broadcast(count))  # one row


@register("exceptions_open", duck("select id, exception_type, coalesce(json_extract_string(payload, '$.k'), '') as k from {exceptions} where status = 'open'"))
def exceptions_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ledger(spark, sf_dir).exceptions.where("status = 'open'").select("id", "exception_type", F.coalesce(F.get_json_object("payload", "$.k"), F.lit("")).alias("k"))


@register("statement_rows_page", duck("select id, row_index, raw_text from {statement_rows} where statement_id = 'st_1_ov' order by row_index, id limit 200"))
def statement_rows_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ledger(spark, sf_dir).statement_rows.where("statement_id = 'st_1_ov'").orderBy("row_index", "id").limit(200).select("id", "row_index", "raw_text")


@register("links_ordered", duck("""select l.id, l.status, greatest(coalesce(o.operation_datetime, o.created_at), coalesce(i.operation_datetime, i.created_at)) as happened_at
from {transfer_links} l left join {transactions} o on o.id = l.transaction_out_id left join {transactions} i on i.id = l.transaction_in_id"""))  # fmt: skip
def links_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger(spark, sf_dir)
    end = lambda side: ledger.transactions.select(F.col("id").alias(f"transaction_{side}_id"), F.coalesce("operation_datetime", "created_at").alias(f"{side}_at"))
    both = ledger.transfer_links.join(end("out"), "transaction_out_id", "left").join(end("in"), "transaction_in_id", "left")
    return both.select("id", "status", F.greatest("out_at", "in_at").alias("happened_at")).orderBy(F.desc_nulls_last("happened_at"), F.desc("id"))


@register("links_page", duck("""select l.id, l.status, coalesce(greatest(coalesce(o.operation_datetime, o.posting_datetime, o.created_at), coalesce(i.operation_datetime, i.posting_datetime, i.created_at)), l.created_at) as happened_at
from {transfer_links} l left join {transactions} o on o.id = l.transaction_out_id left join {transactions} i on i.id = l.transaction_in_id
order by 3 desc, case when coalesce(o.timestamp_precision, 'unknown') in ('date_only', 'unknown') or coalesce(i.timestamp_precision, 'unknown') in ('date_only', 'unknown')
  then greatest(coalesce(o.id, ''), coalesce(i.id, '')) else '' end desc, l.created_at desc, l.id desc limit 200"""))  # fmt: skip
def links_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of links, newest first by the later of their ends; where an end only has a date, by the greater of their places, here their ids."""
    ledger = Ledger(spark, sf_dir)
    dated = F.coalesce("timestamp_precision", F.lit("unknown")).isin("date_only", "unknown")
    end = lambda side: ledger.transactions.select(F.col("id").alias(f"transaction_{side}_id"), ledger_time().alias(f"{side}_at"), dated.alias(f"{side}_dated"), F.col("id").alias(f"{side}_place"))
    both = ledger.transfer_links.join(end("out"), "transaction_out_id", "left").join(end("in"), "transaction_in_id", "left")
    missing, nowhere = F.lit(True), F.lit("")
    loose = F.coalesce("out_dated", missing) | F.coalesce("in_dated", missing)
    place = F.when(loose, F.greatest(F.coalesce("out_place", nowhere), F.coalesce("in_place", nowhere))).otherwise(nowhere)
    happened = F.coalesce(F.greatest("out_at", "in_at"), "created_at").alias("happened_at")
    page = both.select("id", "status", happened, place.alias("place"), "created_at").orderBy(F.desc("happened_at"), F.desc("place"), F.desc("created_at"), F.desc("id")).limit(200)
    return page.select("id", "status", "happened_at")
