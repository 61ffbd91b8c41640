"""Cash flow by month, category, kind of income and merchant, through three lenses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import blank, event_time, lens, money, text, total
from ledgerloom.plans.registry import register
from ledgerloom.sources.ledger import Ledger, duck

LENSES = {"internal_only": "monthly_flow", "high_confidence_transfer_like": "monthly_flow_high_conf", "strict_transfer_like": "monthly_flow_strict"}

DESC = "lower(coalesce(description_raw, ''))"
MARKED = "coalesce(meaning, '') in ('internal_transfer', 'external_transfer')"
SQL_LENS = {
    "internal_only": "coalesce(meaning, '') = 'internal_transfer'",
    "high_confidence_transfer_like": f"""({MARKED} or (lower(coalesce(bank_category, '')) = 'transfer' and coalesce(bank_reference_id, '') <> ''
      and ((direction = 'in' and amount >= 185 and ({DESC} like '%перевод сбп%' or {DESC} like '%через сбп%' or {DESC} like '%зачисление к/с%' or {DESC} like '%отправитель:%'))
        or (direction <> 'in' and amount >= 50 and {DESC} like '%перевод для%'))))""",
    "strict_transfer_like": f"""({MARKED} or {DESC} like '%списание к/с%' or {DESC} like '%зачисление к/с%'
      or (regexp_matches({DESC}, 'перевод|между своими|собственн|transfer|between accounts|p2p|платеж сбп')
        and not (({DESC} like '%перевод денежных средств%' and {DESC} like '%интернет-банк%')
          or ({DESC} like '%комиссия за оказание услуги "перевод с карты на карту"%' and {DESC} like '%sankt-pe, sankt-peterburg, ru%'))))""",
    "strict_list": f"""(coalesce(meaning, '') = 'external_transfer' or lower(coalesce(bank_category, '')) = 'transfer'
      or regexp_matches({DESC}, 'перевод|сбп|sbp|между своими|собственн|transfer|between accounts|p2p'))""",
}


def flow(tx: DataFrame, without: Column) -> DataFrame:
    """Months with the number of transactions, what came in, what went out, and the difference."""
    rows = tx.where(~without).select(F.date_format(F.date_trunc("month", event_time()), "yyyy-MM").alias("period"), "direction", "amount")
    out = rows.groupBy("period").agg(F.count("*").alias("n_tx"), total(F.col("amount"), F.col("direction") == "in").alias("income"), total(F.col("amount"), F.col("direction") == "out").alias("spend"))
    return out.withColumn("net", money(F.col("income") - F.col("spend")))


def sql_flow(name: str) -> str:
    return duck(f"""
select strftime(date_trunc('month', coalesce(operation_datetime, created_at)), '%Y-%m') as period, count(*) as n_tx,
  coalesce(sum(amount) filter (where direction = 'in'), 0)::decimal(20,2) as income, coalesce(sum(amount) filter (where direction = 'out'), 0)::decimal(20,2) as spend,
  (coalesce(sum(amount) filter (where direction = 'in'), 0) - coalesce(sum(amount) filter (where direction = 'out'), 0))::decimal(20,2) as net
from {{transactions}} where not {SQL_LENS[name]} group by 1""")


def _register_lens(name: str, key: str) -> None:
    @register(key, sql_flow(name))
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flow(Ledger(spark, sf_dir).transactions, lens(name))

    short = {"internal_only": "lens_internal", "high_confidence_transfer_like": "lens_high_conf", "strict_transfer_like": "lens_strict", "strict_list": "lens_strict_list"}[name]

    @register(short, duck(f"select id, meaning, amount from {{transactions}} where {SQL_LENS[name]}"))
    def left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Ledger(spark, sf_dir).transactions.where(lens(name)).select("id", "meaning", "amount")


for _name, _key in (LENSES | {"strict_list": "monthly_flow_strict_list"}).items():
    _register_lens(_name, _key)


def top(tx: DataFrame, label: Column, direction: str, k: int, name: str) -> DataFrame:
    """The k labels with the largest sums of absolute amounts; ties go by label."""
    rows = tx.where(~lens("internal_only") & (F.col("direction") == direction)).select(label.alias(name), F.abs("amount").alias("amount"))
    sums = rows.groupBy(name).agg(F.count("*").alias("n_tx"), money(F.sum("amount")).alias("total"))
    return sums.orderBy(F.desc("total"), name).limit(k)


def sql_top(label: str, direction: str, k: int, name: str) -> str:
    return duck(f"""select {label} as {name}, count(*) as n_tx, sum(abs(amount))::decimal(20,2) as total from {{transactions}}
where coalesce(meaning, '') <> 'internal_transfer' and direction = '{direction}' group by 1 order by total desc, 1 limit {k}""")


@register("spend_mix", sql_top("coalesce(nullif(trim(category), ''), 'Uncategorized')", "out", 25, "category"))
def spend_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(blank("category"), "Uncategorized").otherwise(F.trim("category"))
    return top(Ledger(spark, sf_dir).transactions, label, "out", 25, "category")


MERCHANT = "coalesce(nullif(trim(merchant_normalized), ''), nullif(trim(bank_category), ''), 'Unknown')"


@register("top_merchants", sql_top(MERCHANT, "out", 30, "merchant"))
def top_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = lambda c: F.when(~blank(c), F.trim(c))
    return top(Ledger(spark, sf_dir).transactions, F.coalesce(full("merchant_normalized"), full("bank_category"), F.lit("Unknown")), "out", 30, "merchant")


@register("income_breakdown", sql_top("case when lower(trim(meaning)) in ('salary', 'interest', 'cashback', 'refund') then lower(meaning) else 'other' end", "in", 10, "kind"))
def income_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.lower(F.trim(text("meaning"))).isin("salary", "interest", "cashback", "refund"), F.lower("meaning")).otherwise("other")
    return top(Ledger(spark, sf_dir).transactions, kind, "in", 10, "kind")


@register("month_delta", f"""with flow as ({sql_flow('internal_only')})
select period, net, (net - lag(net) over w)::decimal(20,2) as delta,
  case when lag(net) over w > 0 then round((net - lag(net) over w)::double / lag(net) over w, 6) end as share from flow window w as (order by period)""")  # fmt: skip
def month_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One row for each month: a window over all of them is small whatever the ledger.
    before = F.lag("net").over(Window.orderBy("period"))
    out = flow(Ledger(spark, sf_dir).transactions, lens("internal_only")).withColumn("before", before)
    share = F.when(F.col("before") > 0, F.round((F.col("net") - F.col("before")).cast("double") / F.col("before").cast("double"), 6))
    return out.select("period", "net", money(F.col("net") - F.col("before")).alias("delta"), share.alias("share"))
