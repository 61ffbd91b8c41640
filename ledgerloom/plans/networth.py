"""Balances over time: the latest of each account, and totals raw and by day, week and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import money
from ledgerloom.operators.asof import asof_join
from ledgerloom.plans.registry import register
from ledgerloom.sources.ledger import Ledger, duck

PRIORITY = {"statement_opening_balance": 0, "statement_closing_balance": 2}
SQL_PRIORITY = "case method when 'statement_opening_balance' then 0 when 'statement_closing_balance' then 2 else 1 end"


def priority() -> Column:
    out = F.lit(1)
    for method, rank in PRIORITY.items():
        out = F.when(F.col("method") == method, rank).otherwise(out)
    return out


def last_of(snapshots: DataFrame, *by: str) -> DataFrame:
    """The snapshot of each group that counts: the latest, then by method, then by statement."""
    order = F.struct("ts", priority(), "statement_id")
    groups = snapshots.groupBy(*by)
    if "ts" in by:
        return groups.agg(F.max_by("balance", order).alias("balance"))
    return groups.agg(F.max_by(F.struct("ts", "balance"), order).alias("s")).select(*by, "s.ts", "s.balance")


SQL_LATEST = f"select account_id, currency, ts, balance from {{balance_snapshots}} qualify row_number() over (partition by account_id order by ts desc, {SQL_PRIORITY} desc, statement_id desc) = 1"


@register("net_worth_current", duck(SQL_LATEST))
def net_worth_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_of(Ledger(spark, sf_dir).balance_snapshots, "account_id", "currency").withColumn("balance", F.col("balance").cast("decimal(15,2)"))


@register("net_worth_totals", duck(f"select currency, count(*) as n_accounts, sum(balance)::decimal(20,2) as total from ({SQL_LATEST}) group by 1"))
def net_worth_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net_worth_current(spark, sf_dir).groupBy("currency").agg(F.count("*").alias("n_accounts"), money(F.sum("balance")).alias("total"))


@register("balance_share", duck(f"select account_id, balance, round(balance::double / sum(balance::double) over (partition by currency), 6) as share from ({SQL_LATEST})"))
def balance_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = net_worth_current(spark, sf_dir)
    whole = now.groupBy("currency").agg(F.sum("balance").alias("whole"))
    return now.join(whole, "currency").select("account_id", "balance", F.round(F.col("balance").cast("double") / F.col("whole").cast("double"), 6).alias("share"))


@register("asof_balance", duck(f"""select account_id, ts, balance from {{balance_snapshots}} where ts <= timestamp '1998-06-15'
qualify row_number() over (partition by account_id order by ts desc, {SQL_PRIORITY} desc, statement_id desc) = 1"""))  # fmt: skip
def asof_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last balance known at a time, for each account."""
    known = Ledger(spark, sf_dir).balance_snapshots.where(F.col("ts") <= F.lit("1998-06-15").cast("timestamp_ntz"))
    return last_of(known, "account_id").withColumn("balance", F.col("balance").cast("decimal(15,2)"))


def changes(snapshots: DataFrame) -> DataFrame:
    """By currency and time: by how much the total changes, and how many accounts are first seen.

    Balances become differences within an account, so that the running total over all accounts is a
    sum of differences: the wide window sees one row for each time, not for each snapshot.
    """
    each = last_of(snapshots, "account_id", "currency", "ts")
    account = Window.partitionBy("account_id", "currency").orderBy("ts")
    step = each.withColumn("before", F.lag("balance").over(account))
    delta = F.col("balance") - F.coalesce("before", F.lit(0).cast("decimal(15,2)"))
    return step.groupBy("currency", "ts").agg(F.sum(delta).alias("delta"), F.count_if(F.col("before").isNull()).alias("new"))


def running(points: DataFrame) -> DataFrame:
    """Totals so far, over the days of a currency and then over the times of a day: no task holds all times of a currency."""
    own = points.withColumn("day", F.date_trunc("day", "ts"))
    before = Window.partitionBy("currency").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = own.groupBy("currency", "day").agg(F.sum("delta").alias("delta"), F.sum("new").alias("new"))
    sofar = days.select("currency", "day", F.sum("delta").over(before).alias("total_before"), F.sum("new").over(before).alias("known_before"))
    time = Window.partitionBy("currency", "day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0)
    total = F.sum("delta").over(time) + F.coalesce("total_before", zero)
    known = F.sum("new").over(time) + F.coalesce("known_before", zero)
    return own.join(sofar, ["currency", "day"]).select("currency", "ts", money(total).alias("total"), known.cast("bigint").alias("n_known"))


SQL_RAW = f"""
select currency, ts, (sum(delta) over w)::decimal(20,2) as total, (sum(fresh) over w)::bigint as n_known from (
  select currency, ts, sum(balance - coalesce(before, 0)) as delta, count(*) filter (where before is null) as fresh from (
    select *, lag(balance) over (partition by account_id, currency order by ts) as before from (
      select account_id, currency, ts, balance from {{balance_snapshots}}
      qualify row_number() over (partition by account_id, ts order by {SQL_PRIORITY} desc, statement_id desc) = 1)) group by all)
window w as (partition by currency order by ts)"""


@register("net_worth_raw", duck(SQL_RAW))
def net_worth_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running(changes(Ledger(spark, sf_dir).balance_snapshots))


def at_time(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def timeline(snapshots: DataFrame, unit: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(currency, bucket, at, total, n_known) for each day, week or month, carried forward where nothing changed.

    The buckets go from ``start``, or the first snapshot, to ``end``, or the last; what is known at the start is in the
    first. ``at`` is the last microsecond of a bucket, or the end. A currency without snapshots up to the end has no rows.
    """
    floor = lambda time: F.date_trunc(unit, time).cast("timestamp_ntz")
    steps = changes(snapshots if end is None else snapshots.where(F.col("ts") <= at_time(end)))
    first = F.min("ts") if start is None else at_time(start)
    last = F.max("ts") if end is None else at_time(end)
    # Without an end the last point is the last snapshot, or the start where all snapshots are earlier.
    bounds = steps.groupBy("currency").agg(first.alias("first"), (last if start is None else F.greatest(last, first)).alias("last"))
    grid = bounds.select("currency", "last", F.explode(F.sequence(floor(F.col("first")), floor(F.col("last")), F.expr(f"interval 1 {unit}"))).alias("bucket"))
    bucket = floor(F.col("ts")) if start is None else F.greatest(floor(F.col("ts")), floor(at_time(start)))
    moved = steps.groupBy("currency", bucket.alias("bucket")).agg(F.sum("delta").alias("delta"), F.sum("new").alias("new"))
    so_far = Window.partitionBy("currency").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(moved, ["currency", "bucket"], "left").select(
        "currency",
        F.date_format("bucket", "yyyy-MM-dd").alias("bucket"),
        F.least("last", F.col("bucket") + F.expr(f"interval 1 {unit}") - F.expr("interval 1 microsecond")).alias("at"),
        money(F.coalesce(F.sum("delta").over(so_far), F.lit(0))).alias("total"),
        F.coalesce(F.sum("new").over(so_far), F.lit(0)).cast("bigint").alias("n_known"),
    )


def _register_timeline(unit: str) -> None:
    sql = f"""with raw as ({SQL_RAW}), grid as (
  select currency, unnest(generate_series(date_trunc('{unit}', min(ts))::timestamp, date_trunc('{unit}', max(ts))::timestamp, interval 1 {unit})) as bucket from raw group by 1)
select g.currency, strftime(g.bucket, '%Y-%m-%d') as bucket, arg_max(r.total, r.ts) as total, arg_max(r.n_known, r.ts) as n_known
from grid g join raw r on r.currency = g.currency and r.ts < g.bucket + interval 1 {unit} group by 1, 2"""

    @register(f"net_worth_{unit}", duck(sql))
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return timeline(Ledger(spark, sf_dir).balance_snapshots, unit).drop("at")


for _unit in ("day", "week", "month"):
    _register_timeline(_unit)

SQL_INCLUDED = "select id, currency, provider, account_type from {accounts} where include_in_net_worth"


@register("net_worth_accounts", duck(f"select a.id as account_id, a.provider, a.account_type, a.currency, l.ts as as_of, l.balance from ({SQL_INCLUDED}) a left join ({SQL_LATEST}) l on l.account_id = a.id and l.currency = a.currency"))
def net_worth_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accounts that count, with their latest balance or none."""
    ledger = Ledger(spark, sf_dir)
    mine = ledger.accounts.where("include_in_net_worth").select(F.col("id").alias("account_id"), "provider", "account_type", "currency")
    return mine.join(last_of(ledger.balance_snapshots, "account_id", "currency"), ["account_id", "currency"], "left").select(*mine.columns, F.col("ts").alias("as_of"), "balance")


@register("net_worth_included", duck(f"""select a.currency, count(*) as n_accounts, count(l.balance) as n_known, sum(l.balance)::decimal(20,2) as total
from ({SQL_INCLUDED}) a left join ({SQL_LATEST}) l on l.account_id = a.id and l.currency = a.currency group by 1"""))  # fmt: skip
def net_worth_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the accounts that count; an account without a balance is counted and adds nothing."""
    return net_worth_accounts(spark, sf_dir).groupBy("currency").agg(F.count("*").alias("n_accounts"), F.count("balance").alias("n_known"), money(F.sum("balance")).alias("total"))


def included(ledger: Ledger) -> tuple[DataFrame, DataFrame]:
    """The snapshots of the accounts that count, and how many these are by currency."""
    mine = ledger.accounts.where("include_in_net_worth").select(F.col("id").alias("account_id"), "currency")
    return ledger.balance_snapshots.join(mine, ["account_id", "currency"], "left_semi"), mine.groupBy("currency").agg(F.count("*").alias("n_accounts"))


def raw_between(snapshots: DataFrame, start: str, end: str) -> DataFrame:
    """A point at the start, where anything is known by then, and one for each time of a change from the start to the end."""
    steps = changes(snapshots.where(F.col("ts") <= at_time(end)))
    seed = steps.where(F.col("ts") <= at_time(start)).groupBy("currency").agg(at_time(start).alias("ts"), money(F.sum("delta")).alias("total"), F.sum("new").cast("bigint").alias("n_known"))
    return seed.unionByName(running(steps).where(F.col("ts") >= at_time(start)))


START, END = "1995-03-15 12:00:00", "1998-06-15 00:00:00"
#: Balances at given points, straight from their definition: of each account that counts the last one known then.
SQL_AT = f"""with mine as ({SQL_INCLUDED}), known as (
  select b.account_id, b.currency, b.ts, b.balance from {{balance_snapshots}} b join mine m on m.id = b.account_id and m.currency = b.currency
  qualify row_number() over (partition by b.account_id, b.ts order by {SQL_PRIORITY} desc, statement_id desc) = 1),
points as (@points@), each as (select p.currency, p.at, p.kind, m.id from points p join mine m on m.currency = p.currency)
select e.currency, e.at, sum(k.balance)::decimal(20,2) as total, count(k.balance) as n_known, count(*) as n_accounts
from each e asof left join known k on k.account_id = e.id and k.ts <= e.at group by e.currency, e.at, e.kind"""


def sql_at(points: str) -> str:
    return duck(SQL_AT.replace("@points@", points))


@register("net_worth_raw_scoped", sql_at(f"""select distinct currency, ts as at, 1 as kind from known where ts between timestamp '{START}' and timestamp '{END}'
  union all select distinct currency, timestamp '{START}', 0 from known where ts <= timestamp '{START}'"""))  # fmt: skip
def net_worth_raw_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of the accounts that count between two times, beginning with what is known at the first."""
    own, size = included(Ledger(spark, sf_dir))
    return raw_between(own, START, END).withColumnRenamed("ts", "at").join(size, "currency")


def _register_scoped(unit: str) -> None:
    sql = sql_at(f"""select currency, least(timestamp '{END}', bucket + interval 1 {unit} - interval 1 microsecond) as at, 1 as kind from (
  select currency, unnest(generate_series(date_trunc('{unit}', timestamp '{START}')::timestamp, timestamp '{END}', interval 1 {unit})) as bucket from (select distinct currency from known where ts <= timestamp '{END}'))""")

    @register(f"net_worth_{unit}_scoped", sql)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own, size = included(Ledger(spark, sf_dir))
        return timeline(own, unit, START, END).drop("bucket").join(size, "currency")


for _unit in ("day", "week", "month"):
    _register_scoped(_unit)

SQL_RECONCILE = """select id, case when opening_balance is null or closing_balance is null then 'unknown'
  when abs(opening_balance + coalesce(total_credits, 0) - coalesce(total_debits, 0) - closing_balance) <= 0.01 then 'ok' else 'mismatch' end as status,
  (opening_balance + coalesce(total_credits, 0) - coalesce(total_debits, 0) - closing_balance)::decimal(20,2) as delta from {statements}"""


def reconciled(statements: DataFrame) -> DataFrame:
    """Opening balance and totals against the closing balance; without either balance nothing is known."""
    zero = F.lit(0).cast("decimal(14,2)")
    delta = F.col("opening_balance") + F.coalesce("total_credits", zero) - F.coalesce("total_debits", zero) - F.col("closing_balance")
    status = F.when(delta.isNull(), "unknown").when(F.abs(delta) <= F.lit("0.01").cast("decimal(14,2)"), "ok").otherwise("mismatch")
    return statements.select("id", status.alias("status"), money(delta).alias("delta"))


@register("reconcile", duck(SQL_RECONCILE))
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciled(Ledger(spark, sf_dir).statements)


@register("balance_confidence", duck(f"select status, count(*) as n, max(round(least(1, greatest(0, 0.5::double * case status when 'ok' then 1.0::double when 'mismatch' then 0.3::double else 0.7::double end)), 4)) as confidence from ({SQL_RECONCILE}) group by 1"))
def balance_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = F.when(F.col("status") == "ok", 1.0).when(F.col("status") == "mismatch", 0.3).otherwise(0.7)
    sure = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.5) * factor)), 4)
    return reconcile(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.max(sure).alias("confidence"))


def mismatches(statements: DataFrame, stored: DataFrame) -> DataFrame:
    """Exceptions of statements that don't add up and have no such exception yet, whatever became of it."""
    known = stored.where("exception_type = 'reconcile_mismatch' and entity_type = 'statement'").select(F.col("entity_id").alias("id"))
    wrong = reconciled(statements).where("status = 'mismatch'").join(known, "id", "left_anti")
    return wrong.select(F.lit("reconcile_mismatch").alias("exception_type"), F.col("id").alias("entity_id"), "delta")


@register("reconcile_exceptions", duck(f"""select 'reconcile_mismatch' as exception_type, id as entity_id, delta from ({SQL_RECONCILE}) where status = 'mismatch' and id not like '%7'"""))
def reconcile_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Here every statement whose id ends with 7 has its exception already."""
    ledger = Ledger(spark, sf_dir)
    told = ledger.statements.where("id like '%7'").select(F.lit("reconcile_mismatch").alias("exception_type"), F.lit("statement").alias("entity_type"), F.col("id").alias("entity_id"))
    return mismatches(ledger.statements, ledger.exceptions.select("exception_type", "entity_type", "entity_id").union(told))


@register("stale_accounts", duck(f"select a.id as account_id, coalesce(date_diff('day', l.ts::date, date '2001-09-15') > 30, true) as stale from {{accounts}} a left join ({SQL_LATEST}) l on l.account_id = a.id"))
def stale_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts whose latest balance is more than 30 days before a given day, and those without any."""
    old = F.date_diff(F.lit("2001-09-15").cast("date"), F.col("ts").cast("date")) > 30
    ids = Ledger(spark, sf_dir).accounts.select(F.col("id").alias("account_id"))
    return ids.join(net_worth_current(spark, sf_dir), "account_id", "left").select("account_id", F.coalesce(old, F.lit(True)).alias("stale"))


SQL_POINTS = f"select account_id, ts, arg_max(balance, ({SQL_PRIORITY}, statement_id)) as balance from {{balance_snapshots}} group by all"


@register("balance_movement", duck(f"""with points as ({SQL_POINTS}), told as (select *, lag(balance) over w as prior, lag(ts) over w as prior_ts from points window w as (partition by account_id order by ts))
select account_id, ts, balance, prior_ts, (balance - prior)::decimal(20,2) as movement from told qualify row_number() over (partition by account_id order by ts desc) = 1"""))  # fmt: skip
def balance_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last balance of each account less the one before it; nothing where there is only one."""
    points = last_of(Ledger(spark, sf_dir).balance_snapshots, "account_id", "ts").select("account_id", "ts", "balance")
    last = points.groupBy("account_id").agg(F.max("ts").alias("ts"), F.max_by("balance", "ts").alias("balance"))
    prior = points.join(last.select("account_id", F.col("ts").alias("last_ts")), "account_id").where("ts < last_ts")
    prior = prior.groupBy("account_id").agg(F.max("ts").alias("prior_ts"), F.max_by("balance", "ts").alias("prior"))
    return last.join(prior, "account_id", "left").select("account_id", "ts", "balance", "prior_ts", money(F.col("balance") - F.col("prior")).alias("movement"))


@register("balance_asof", duck(f"""with points as ({SQL_POINTS}), probes as (select id, account_id, opening_date as ts from (select id, account_id, period_start - interval 1 day as opening_date from {{statements}}) s)
select p.id, p.account_id, b.ts as known_at, b.balance from probes p asof left join points b on b.account_id = p.account_id and p.ts >= b.ts"""))  # fmt: skip
def balance_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of each statement's account on the day before the statement begins."""
    ledger = Ledger(spark, sf_dir)
    points = last_of(ledger.balance_snapshots, "account_id", "ts").select("account_id", "ts", "balance", F.col("ts").alias("known_at"))
    probes = ledger.statements.select("id", "account_id", F.expr("period_start - interval 1 day").alias("ts"))
    return asof_join(probes, points, ["account_id"], "ts").select("id", "account_id", "found.known_at", "found.balance")
