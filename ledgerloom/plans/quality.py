"""Integrity of links, metrics of canonical rows, and reconciliation with labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.columns import lens, money, total
from ledgerloom.plans.cashflow import SQL_LENS
from ledgerloom.plans.registry import register
from ledgerloom.sources.ledger import Ledger, duck


SQL_CORE = """tx as (select count(*) as n_tx, count(*) filter (where direction = 'out') as n_out, count(*) filter (where direction = 'in') as n_in, coalesce(sum(amount) filter (where direction = 'out'), 0)::decimal(20,2) as gross_out,
  coalesce(sum(amount) filter (where direction = 'in'), 0)::decimal(20,2) as gross_in, count(*) filter (where coalesce(meaning, '') = 'internal_transfer') as n_internal,
  count(*) filter (where coalesce(meaning, '') <> 'internal_transfer' and direction = 'out') as n_spend, count(*) filter (where coalesce(meaning, '') <> 'internal_transfer' and direction = 'in') as n_income,
  coalesce(sum(amount) filter (where coalesce(meaning, '') <> 'internal_transfer' and direction = 'out'), 0)::decimal(20,2) as spend, coalesce(sum(amount) filter (where coalesce(meaning, '') <> 'internal_transfer' and direction = 'in'), 0)::decimal(20,2) as income from {transactions}),
lk as (select count(*) filter (where l.status = 'auto') as n_auto, count(*) filter (where l.status = 'suggested') as n_suggested, count(*) filter (where l.status = 'confirmed') as n_confirmed, count(*) filter (where l.status = 'rejected') as n_rejected,
  count(*) filter (where o.id is null or i.id is null) as n_orphans from {transfer_links} l left join {transactions} o on o.id = l.transaction_out_id left join {transactions} i on i.id = l.transaction_in_id),
un as (select count(*) as n_unresolved, coalesce(sum(amount) filter (where direction = 'out'), 0)::decimal(20,2) as unresolved_out, coalesce(sum(amount) filter (where direction = 'in'), 0)::decimal(20,2) as unresolved_in from {transactions}
  where id in (select unnest([transaction_out_id, transaction_in_id]) from {transfer_links} where status = 'suggested')),
core as (select *, (unresolved_in - unresolved_out)::decimal(20,2) as net_impact, (unresolved_in + unresolved_out)::decimal(20,2) as gross_impact from tx, lk, un)"""


def core(ledger: Ledger) -> DataFrame:
    """Eighteen measures of transactions and links, and what unresolved links may change; one row."""
    out, into, own = F.col("direction") == "out", F.col("direction") == "in", ~lens("internal_only")
    tx = ledger.transactions.agg(
        F.count("*").alias("n_tx"), F.count_if(out).alias("n_out"), F.count_if(into).alias("n_in"), total(F.col("amount"), out).alias("gross_out"), total(F.col("amount"), into).alias("gross_in"), F.count_if(~own).alias("n_internal"),
        F.count_if(own & out).alias("n_spend"), F.count_if(own & into).alias("n_income"), total(F.col("amount"), own & out).alias("spend"), total(F.col("amount"), own & into).alias("income"),
    )
    end = lambda side: ledger.transactions.select(F.col("id").alias(f"transaction_{side}_id"), F.lit(1).alias(side))
    links = ledger.transfer_links.join(end("out"), "transaction_out_id", "left").join(end("in"), "transaction_in_id", "left")
    counts = links.agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("auto", "suggested", "confirmed", "rejected")], F.count_if(F.col("out").isNull() | F.col("in").isNull()).alias("n_orphans"))
    ids = ledger.transfer_links.where("status = 'suggested'").select(F.explode(F.array("transaction_out_id", "transaction_in_id")).alias("id"))
    unresolved = ledger.transactions.join(ids, "id", "left_semi").agg(F.count("*").alias("n_unresolved"), total(F.col("amount"), out).alias("unresolved_out"), total(F.col("amount"), into).alias("unresolved_in"))
    all_ = tx.join(F.broadcast(counts)).join(F.broadcast(unresolved))  # aggregates of one row each
    return all_.withColumns({"net_impact": money(F.col("unresolved_in") - F.col("unresolved_out")), "gross_impact": money(F.col("unresolved_in") + F.col("unresolved_out"))})


@register("core_metrics", duck(f"with {SQL_CORE} select * from core"))
def core_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core(Ledger(spark, sf_dir))


SQL_INTEGRITY = """integrity as (select (select count(*) from {links} where transaction_id not in (select id from {transactions})) as links_without_tx, (select count(*) from {links} where statement_row_id not in (select id from {statement_rows})) as links_without_row,
  (select count(*) from {statement_rows} where id not in (select statement_row_id from {links})) as rows_left, (select count(*) from {transactions} where id not in (select transaction_id from {links})) as tx_left,
  (select count(*) from {sheets} where coalesce(reconcile_status, '') = 'mismatch') as n_mismatch)"""


def integrity(ledger: Ledger) -> DataFrame:
    """Links without a side, rows and transactions without a link, statements that don't add up; one row."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    tx, rows = ledger.transactions.select(F.col("id").alias("transaction_id")), ledger.statement_rows.select(F.col("id").alias("statement_row_id"))
    out = count(ledger.links.join(tx, "transaction_id", "left_anti"), "links_without_tx")
    for one_row in (
        count(ledger.links.join(rows, "statement_row_id", "left_anti"), "links_without_row"),
        count(rows.join(ledger.links, "statement_row_id", "left_anti"), "rows_left"),
        count(tx.join(ledger.links, "transaction_id", "left_anti"), "tx_left"),
        count(ledger.sheets.where("reconcile_status = 'mismatch'"), "n_mismatch"),
    ):
        out = out.join(F.broadcast(one_row))
    return out


@register("link_integrity", duck(f"with {SQL_INTEGRITY} select * from integrity"))
def link_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity(Ledger(spark, sf_dir))


@register("unresolved_impact", duck("""
with ids as (select transaction_out_id as id from {transfer_links} where status = 'suggested' union select transaction_in_id from {transfer_links} where status = 'suggested')
select direction, count(*) as n_tx, sum(amount)::decimal(20,2) as impact from {transactions} where id in (select id from ids) group by direction"""))  # fmt: skip
def unresolved_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger(spark, sf_dir)
    open_links = ledger.transfer_links.where("status = 'suggested'")
    ids = open_links.select(F.explode(F.array("transaction_out_id", "transaction_in_id")).alias("id"))
    return ledger.transactions.join(ids, "id", "left_semi").groupBy("direction").agg(F.count("*").alias("n_tx"), money(F.sum("amount")).alias("impact"))


@register("orphan_links", duck("""
select count(*) filter (where o.id is null) as missing_out, count(*) filter (where i.id is null) as missing_in, count(*) as n_links
from {transfer_links} l left join {transactions} o on o.id = l.transaction_out_id left join {transactions} i on i.id = l.transaction_in_id"""))  # fmt: skip
def orphan_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger(spark, sf_dir)
    end = lambda side: ledger.transactions.select(F.col("id").alias(f"transaction_{side}_id"), F.lit(1).alias(side))
    both = ledger.transfer_links.join(end("out"), "transaction_out_id", "left").join(end("in"), "transaction_in_id", "left")
    return both.agg(F.count_if(F.col("out").isNull()).alias("missing_out"), F.count_if(F.col("in").isNull()).alias("missing_in"), F.count("*").alias("n_links"))


@register("unlinked_rows", duck("select id, statement_id from {statement_rows} where id not in (select statement_row_id from {links})"))
def unlinked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger(spark, sf_dir)
    return ledger.statement_rows.join(ledger.links.select(F.col("statement_row_id").alias("id")), "id", "left_anti").select("id", "statement_id")


@register("unlinked_tx", duck("select id, amount from {transactions} where id not in (select transaction_id from {links})"))
def unlinked_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger(spark, sf_dir)
    return ledger.transactions.join(ledger.links.select(F.col("transaction_id").alias("id")), "id", "left_anti").select("id", "amount")


@register("provenance_join", duck("""select r.statement_id, count(distinct t.id) as n_tx, count(*) as n_links, sum(t.amount)::decimal(20,2) as total
from {transactions} t join {links} l on l.transaction_id = t.id join {statement_rows} r on r.id = l.statement_row_id group by 1"""))  # fmt: skip
def provenance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(Ledger(spark, sf_dir)).groupBy("statement_id").agg(F.countDistinct("id").alias("n_tx"), F.count("*").alias("n_links"), money(F.sum("amount")).alias("total"))


def linked(ledger: Ledger) -> DataFrame:
    """Transactions with the statement rows they come from."""
    rows = ledger.statement_rows.select(F.col("id").alias("statement_row_id"), "statement_id", "raw_text", "row_index", F.col("amount").alias("row_amount"))
    return ledger.links.withColumnRenamed("transaction_id", "id").join(ledger.transactions, "id").join(rows, "statement_row_id")


@register("links_by_status", duck("""select status, count(*) as n from {transfer_links}
where transaction_out_id in (select id from {transactions}) and transaction_in_id in (select id from {transactions}) group by 1"""))  # fmt: skip
def links_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger(spark, sf_dir)
    ids = lambda side: ledger.transactions.select(F.col("id").alias(f"transaction_{side}_id"))
    scoped = ledger.transfer_links.join(ids("out"), "transaction_out_id", "left_semi").join(ids("in"), "transaction_in_id", "left_semi")
    return scoped.groupBy("status").agg(F.count("*").alias("n"))


@register("rows_per_file", duck("""select coalesce(statement_id, '*') as file, count(*) as n_rows, coalesce(sum(amount) filter (where direction = 'in'), 0)::decimal(20,2) as income,
coalesce(sum(amount) filter (where direction = 'out'), 0)::decimal(20,2) as spend from {statement_rows} group by rollup(statement_id)"""))  # fmt: skip
def rows_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Ledger(spark, sf_dir).statement_rows
    sums = rows.rollup("statement_id").agg(F.count("*").alias("n_rows"), total(F.col("amount"), F.col("direction") == "in").alias("income"), total(F.col("amount"), F.col("direction") == "out").alias("spend"))
    return sums.select(F.coalesce("statement_id", F.lit("*")).alias("file"), "n_rows", "income", "spend")


SQL_LENSES = " union all ".join(
    f"""select '{name}' as lens, count(*) as n_tx, coalesce(sum(amount) filter (where direction = 'in'), 0)::decimal(20,2) as income,
    coalesce(sum(amount) filter (where direction = 'out'), 0)::decimal(20,2) as spend from scoped where not {SQL_LENS[name]}"""
    for name in ("internal_only", "high_confidence_transfer_like", "strict_transfer_like")
)


@register("lens_metrics", duck(f"with scoped as (select distinct t.* from {{transactions}} t join {{links}} l on l.transaction_id = t.id) {SQL_LENSES}"))
def lens_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass: each transaction is exploded into the lenses that keep it."""
    ledger = Ledger(spark, sf_dir)
    scoped = ledger.transactions.join(ledger.links.select(F.col("transaction_id").alias("id")), "id", "left_semi")
    names = ("internal_only", "high_confidence_transfer_like", "strict_transfer_like")
    kept = F.filter(F.array(*[F.when(~lens(n), n) for n in names]), lambda x: x.isNotNull())
    rows = scoped.select("direction", "amount", F.explode(kept).alias("lens"))
    return rows.groupBy("lens").agg(F.count("*").alias("n_tx"), total(F.col("amount"), F.col("direction") == "in").alias("income"), total(F.col("amount"), F.col("direction") == "out").alias("spend"))


SQL_COLLAPSED = """select l.transaction_id, count(*) as n_rows, count(distinct r.statement_id) as n_statements,
  count(distinct sha256(lower(trim(regexp_replace(r.raw_text, '\\s+', ' ', 'g'))) || '|' || abs(r.amount)::varchar || '|' || r.direction)) as n_prints
from {links} l join {statement_rows} r on r.id = l.statement_row_id group by 1 having count(*) > 1"""


@register("collapsed_tx", duck(SQL_COLLAPSED))
def collapsed_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions that several rows were merged into, with the distinct statements and row fingerprints."""
    ledger = Ledger(spark, sf_dir)
    print_ = F.sha2(F.concat_ws("|", F.lower(F.trim(F.regexp_replace("raw_text", r"\s+", " "))), F.abs("amount").cast("string"), "direction"), 256)
    rows = ledger.statement_rows.select(F.col("id").alias("statement_row_id"), "statement_id", print_.alias("print"))
    groups = ledger.links.join(rows, "statement_row_id").groupBy("transaction_id")
    return groups.agg(F.count("*").alias("n_rows"), F.countDistinct("statement_id").alias("n_statements"), F.countDistinct("print").alias("n_prints")).where("n_rows > 1")


@register("collapse_class", duck(f"""select case when n_statements > 1 and n_prints = 1 then 'expected_overlap_dedupe' when n_statements > 1 then 'cross_statement_variance_merge'
  when n_prints = 1 then 'same_statement_duplicate_collapse' else 'same_statement_variance_merge' end as kind, count(*) as n_tx from ({SQL_COLLAPSED}) group by 1"""))  # fmt: skip
def collapse_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    across, alike = F.col("n_statements") > 1, F.col("n_prints") == 1
    kind = F.when(across & alike, "expected_overlap_dedupe").when(across, "cross_statement_variance_merge").when(alike, "same_statement_duplicate_collapse").otherwise("same_statement_variance_merge")
    return collapsed_tx(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("n_tx"))


@register("per_file_mismatch", duck("""
with own as (select 'all_' || upper(right(replace(pdf_path, '.pdf', ''), 1)) || '.pdf' as file, count(*) as n from {statements} group by 1),
told as (select source_file as file, count(*) as n from {reference_rows} group by 1)
select coalesce(own.file, told.file) as file, coalesce(own.n, 0) as n_own, coalesce(told.n, 0) as n_told, coalesce(own.n, 0) - coalesce(told.n, 0) as gap from own full join told on own.file = told.file"""))  # fmt: skip
def per_file_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of either side; what one side lacks counts as nothing."""
    ledger = Ledger(spark, sf_dir)
    file = F.concat(F.lit("all_"), F.upper(F.substring(F.regexp_replace("pdf_path", r"\.pdf$", ""), -1, 1)), F.lit(".pdf"))
    own = ledger.statements.groupBy(file.alias("file")).agg(F.count("*").alias("n_own"))
    told = ledger.reference_rows.groupBy(F.col("source_file").alias("file")).agg(F.count("*").alias("n_told"))
    return own.join(told, "file", "full").na.fill(0, ["n_own", "n_told"]).withColumn("gap", F.col("n_own") - F.col("n_told"))


# Flags in their order, and which of them are incidents.
FLAGS = (
    ("suggested_transfer_links_pending", "n_suggested > 0"), ("orphan_transfer_links", "n_orphans > 0"), ("orphan_statement_links", "links_without_tx + links_without_row > 0"),
    ("statement_reconciliation_mismatch", "n_mismatch > 0"), ("statement_rows_unlinked", "rows_left > 0"),
)
CRITICAL = ("orphan_transfer_links", "orphan_statement_links")


@register("quality_status", duck(f"""with {SQL_CORE}, {SQL_INTEGRITY}, f as (select list_filter([{', '.join(f"case when {when} then '{name}' end" for name, when in FLAGS)}], lambda x: x is not null) as flags from core, integrity)
select array_to_string(flags, ',') as flags, case when list_has_any(flags, {list(CRITICAL)}) then 'critical' when len(flags) > 0 then 'warning' else 'ok' end as status,
  len(flags) - (list_contains(flags, 'orphan_transfer_links') and list_contains(flags, 'orphan_statement_links'))::int as n_recommendations from f"""))  # fmt: skip
def quality_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags, what they amount to, and how many things there are to do (both kinds of orphans are one)."""
    ledger = Ledger(spark, sf_dir)
    flags = F.array_compact(F.array(*[F.when(F.expr(when), F.lit(name)) for name, when in FLAGS]))
    told = core(ledger).join(F.broadcast(integrity(ledger))).select(flags.alias("flags"))  # one row each
    incident = F.arrays_overlap("flags", F.array(*map(F.lit, CRITICAL)))
    both = (F.size(F.array_intersect("flags", F.array(*map(F.lit, CRITICAL)))) == 2).cast("int")
    return told.select(F.array_join("flags", ",").alias("flags"), F.when(incident, "critical").when(F.size("flags") > 0, "warning").otherwise("ok").alias("status"), (F.size("flags") - both).alias("n_recommendations"))
