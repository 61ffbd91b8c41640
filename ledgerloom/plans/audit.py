"""Audit: balances from statements, lenses row by row, tiers and gaps against labelled rows, collapses, plans of repair, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import HIGH_IN, HIGH_LEAST_IN, HIGH_LEAST_OUT, HIGH_OUT, TRANSFERS, cents, event_time, folded, lens, money, text, total
from ledgerloom.plans.cashflow import SQL_LENS
from ledgerloom.plans.quality import core, integrity
from ledgerloom.plans.registry import register
from ledgerloom.plans.rules import guarded, sql_guard
from ledgerloom.plans.statements import SQL_SPACED, merchant_label, sql_counterparty, sql_merchant
from ledgerloom.sources.ledger import Ledger, duck

LENSES = ("internal_only", "high_confidence_transfer_like", "strict_transfer_like")


def source_key(path: Column) -> Column:
    """The name under which a file is known on both sides: what an export is called, else its base name."""
    low = F.replace(F.lower(F.trim(F.coalesce(path, F.lit("")))), F.lit("\\"), F.lit("/"))
    return F.coalesce(F.nullif(F.regexp_extract(low, r"(all_[^/]+\.pdf)$", 1), F.lit("")), F.regexp_replace(low, "^.*/", ""))


SQL_SOURCE = "coalesce(nullif(regexp_extract(lower({0}), '(all_[^/]+\\.pdf)$', 1), ''), regexp_replace(lower({0}), '^.*/', ''))"


def high_confidence_row() -> Column:
    """The high-confidence lens as the audit reads it: by the amount's size, and phrases anywhere in the trimmed text."""
    into, amount, said = folded("direction") == "in", F.abs(F.coalesce(F.col("amount"), F.lit(0).cast("decimal(14,2)"))), folded("description_raw")
    named = lambda patterns: F.greatest(*[said.contains(p.strip("%").strip()) for p in patterns], F.lit(False))
    enough = F.when(into, (amount >= F.lit(HIGH_LEAST_IN).cast("decimal(14,2)")) & named(HIGH_IN)).otherwise((amount >= F.lit(HIGH_LEAST_OUT).cast("decimal(14,2)")) & named(HIGH_OUT))
    return folded("meaning").isin(*TRANSFERS) | ((folded("bank_category") == "transfer") & (F.trim(text("bank_reference_id")) != "") & enough)


SQL_HIGH = (
    "(lower(trim(coalesce(meaning, ''))) in ('internal_transfer', 'external_transfer') or (lower(trim(coalesce(bank_category, ''))) = 'transfer' and trim(coalesce(bank_reference_id, '')) <> '' and case when direction = 'in' "
    "then abs(amount) >= 185 and regexp_matches(lower(coalesce(description_raw, '')), 'перевод сбп|через сбп|зачисление к/с|отправитель:') else abs(amount) >= 50 and contains(lower(coalesce(description_raw, '')), 'перевод для') end))"
)


@register("lens_high_conf_rowwise", duck(f"select id from (select * replace (-amount as amount) from {{transactions}}) where {SQL_HIGH}"))
def lens_high_conf_rowwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over amounts with a sign, which this reading of the lens doesn't mind."""
    signed = Ledger(spark, sf_dir).transactions.withColumn("amount", -F.col("amount"))
    return signed.where(high_confidence_row()).select("id")


@register("scope_basename", duck("select id from {sheets} where regexp_matches(lower(regexp_replace(pdf_path, '^.*/', '')), '^all_[^/]+\\.pdf$')"))
def scope_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ledger(spark, sf_dir).sheets.where(F.lower(F.regexp_replace("pdf_path", "^.*/", "")).rlike(r"^all_[^/]+\.pdf$")).select("id")


SQL_SHEET_ROWS = "scoped as (select distinct t.*, lower(regexp_replace(s.pdf_path, '^.*/', '')) as file from {transactions} t join {links} l on l.transaction_id = t.id join {statement_rows} r on r.id = l.statement_row_id join {sheets} s on s.id = r.statement_id)"


def per_file(ledger: Ledger) -> DataFrame:
    """(id, file) of each transaction and file that holds a row of it."""
    files = ledger.sheets.select(F.col("id").alias("statement_id"), F.lower(F.regexp_replace("pdf_path", "^.*/", "")).alias("file"))
    rows = ledger.statement_rows.select(F.col("id").alias("statement_row_id"), "statement_id").join(files, "statement_id")
    return ledger.links.join(rows, "statement_row_id").select(F.col("transaction_id").alias("id"), "file").distinct()


SUMS = "count(*) as n_tx, coalesce(sum(amount) filter (where direction = 'in'), 0)::decimal(20,2) as income, coalesce(sum(amount) filter (where direction = 'out'), 0)::decimal(20,2) as spend"


def sums() -> list[Column]:
    return [F.count("*").alias("n_tx"), total(F.col("amount"), F.col("direction") == "in").alias("income"), total(F.col("amount"), F.col("direction") == "out").alias("spend")]


def lens_sums(ledger: Ledger) -> DataFrame:
    kept = F.filter(F.array(*[F.when(~lens(n), n) for n in LENSES]), lambda x: x.isNotNull())
    rows = ledger.transactions.join(per_file(ledger), "id").select("file", "direction", "amount", F.explode(kept).alias("lens"))
    return rows.groupBy("file", "lens").agg(*sums())


@register("lens_metrics_per_file", duck(f"with {SQL_SHEET_ROWS} " + " union all ".join(f"select file, '{n}' as lens, {SUMS} from scoped where not {SQL_LENS[n]} group by all" for n in LENSES)))
def lens_metrics_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens_sums(Ledger(spark, sf_dir))


def told(amount: Column) -> list[Column]:
    return [F.count("*").alias("n_tx"), total(amount, amount > 0).alias("income"), total(-amount, amount < 0).alias("spend")]


TIERS = ("gross", "tier_b", "tier_c", "all_transfers", "high", "medium")


def in_tiers(rows: DataFrame) -> DataFrame:
    """Labelled rows by the tiers that hold them: all, without sure transfers, without any, and kinds of transfers."""
    transfer, sure = F.lower(F.trim("is_transfer")).isin("1", "true", "t", "yes", "y"), F.lower(F.trim("transfer_confidence"))
    flags = (F.lit(True), ~(transfer & (sure == "high")), ~transfer, transfer, transfer & (sure == "high"), transfer & (sure == "medium"))
    held = F.filter(F.array(*[F.when(f, F.lit(n)) for f, n in zip(flags, TIERS, strict=True)]), lambda x: x.isNotNull())
    return rows.withColumn("tier", F.explode(held))


SQL_TIERS = """tiered as (select *, unnest(list_filter(['gross', case when not (t and lower(trim(transfer_confidence)) = 'high') then 'tier_b' end, case when not t then 'tier_c' end, case when t then 'all_transfers' end,
  case when t and lower(trim(transfer_confidence)) = 'high' then 'high' end, case when t and lower(trim(transfer_confidence)) = 'medium' then 'medium' end], lambda x: x is not null)) as tier
  from (select *, lower(trim(is_transfer)) in ('1', 'true', 't', 'yes', 'y') as t from {reference_rows}))"""
TOLD = "count(*) as n_tx, coalesce(sum(amount_rub) filter (where amount_rub > 0), 0)::decimal(20,2) as income, coalesce(sum(-amount_rub) filter (where amount_rub < 0), 0)::decimal(20,2) as spend"


@register("reference_tiers", duck(f"with {SQL_TIERS} select coalesce(lower(source_file), '*') as file, tier, {TOLD}, min(operation_date) as first_at, max(operation_date) as last_at from tiered group by grouping sets ((tier), (tier, lower(source_file)))"))
def reference_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of labelled rows by tier, of each file and of all."""
    rows = in_tiers(Ledger(spark, sf_dir).reference_rows).withColumn("file", F.lower("source_file"))
    out = rows.groupingSets([[F.col("tier")], [F.col("tier"), F.col("file")]], F.col("tier"), F.col("file"))
    out = out.agg(*told(F.col("amount_rub")), F.min("operation_date").alias("first_at"), F.max("operation_date").alias("last_at"))
    return out.withColumn("file", F.coalesce("file", F.lit("*")))


PAIRED = (("internal_only", "gross"), ("high_confidence_transfer_like", "tier_b"), ("strict_transfer_like", "tier_c"))


@register("tier_gaps", duck(f"with {SQL_SHEET_ROWS}, {SQL_TIERS}, own as (" + " union all ".join(f"select file, '{t}' as tier, {SUMS} from scoped where not {SQL_LENS[n]} group by all" for n, t in PAIRED) + f"""),
told as (select lower(source_file) as file, tier, {TOLD} from tiered where tier in ('gross', 'tier_b', 'tier_c') group by all),
gaps as (select file, tier, coalesce(own.n_tx, 0) - coalesce(told.n_tx, 0) as n_gap, (coalesce(own.income, 0) - coalesce(told.income, 0))::decimal(20,2) as income_gap, (coalesce(own.spend, 0) - coalesce(told.spend, 0))::decimal(20,2) as spend_gap from own full join told using (file, tier))
select *, (income_gap - spend_gap)::decimal(20,2) as net_gap from gaps where n_gap <> 0 or income_gap <> 0 or spend_gap <> 0"""))  # fmt: skip
def tier_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files on which a lens and the tier that it stands for differ; what one side lacks counts as nothing."""
    ledger = Ledger(spark, sf_dir)
    tier = F.coalesce(*[F.when(F.col("lens") == n, t) for n, t in PAIRED])
    own = lens_sums(ledger).select("file", tier.alias("tier"), *[F.col(c).alias(f"own_{c}") for c in ("n_tx", "income", "spend")])
    rows = in_tiers(ledger.reference_rows).where(F.col("tier").isin("gross", "tier_b", "tier_c"))
    theirs = rows.groupBy(F.lower("source_file").alias("file"), "tier").agg(*told(F.col("amount_rub")))
    gap = lambda c: F.coalesce(f"own_{c}", F.lit(0)) - F.coalesce(c, F.lit(0))
    both = own.join(theirs, ["file", "tier"], "full").select("file", "tier", gap("n_tx").alias("n_gap"), money(gap("income")).alias("income_gap"), money(gap("spend")).alias("spend_gap"))
    return both.where("n_gap <> 0 or income_gap <> 0 or spend_gap <> 0").withColumn("net_gap", money(F.col("income_gap") - F.col("spend_gap")))


SQL_CLASS_ROWS = f"""class_rows as (select distinct r.id as row_id, {SQL_SOURCE.format('s.pdf_path')} as source, strftime(r.operation_date, '%Y-%m-%dT%H:%M:%S') as stamp, lower(trim(coalesce(r.direction, t.direction, ''))) as direction, r.page_number as page,
  (abs(coalesce(r.amount, t.amount, 0)) * 100)::bigint as cents, {SQL_HIGH.replace('amount)', 'coalesce(r.amount, t.amount, 0))').replace("direction = 'in'", "lower(trim(coalesce(r.direction, t.direction, ''))) = 'in'")} as transfer, t.description_raw as said
  from {{statement_rows}} r join {{sheets}} s on s.id = r.statement_id join {{links}} l on l.statement_row_id = r.id join {{transactions}} t on t.id = l.transaction_id)"""


def class_table(ledger: Ledger) -> DataFrame:
    """Rows with the five parts of their key and whether they look like transfers."""
    tx = ledger.transactions.select(F.col("id").alias("transaction_id"), "meaning", "bank_category", "bank_reference_id", "description_raw", F.col("direction").alias("tx_direction"), F.col("amount").alias("tx_amount"))
    sheets = ledger.sheets.select(F.col("id").alias("statement_id"), source_key(F.col("pdf_path")).alias("source"))
    rows = ledger.statement_rows.withColumnRenamed("id", "row_id").join(sheets, "statement_id").join(ledger.links.withColumnRenamed("statement_row_id", "row_id"), "row_id").join(tx, "transaction_id")
    rows = rows.withColumns({"direction": F.lower(F.trim(F.coalesce("direction", "tx_direction", F.lit("")))), "amount": F.coalesce("amount", "tx_amount", F.lit(0).cast("decimal(14,2)"))})
    at = F.date_format("operation_date", "yyyy-MM-dd'T'HH:mm:ss")
    return rows.select("row_id", "source", at.alias("stamp"), "direction", F.col("page_number").alias("page"), F.abs(cents(F.col("amount"))).alias("cents"), high_confidence_row().alias("transfer"), F.col("description_raw").alias("said")).distinct()


@register("class_rows", duck(f"with {SQL_CLASS_ROWS} select row_id, transfer, said from class_rows"))
def class_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_table(Ledger(spark, sf_dir)).select("row_id", "transfer", "said")


@register("class_key", duck(f"with {SQL_CLASS_ROWS} select source, stamp, direction, cents, page, count(*) as n from class_rows group by all"))
def class_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_table(Ledger(spark, sf_dir)).groupBy("source", "stamp", "direction", "cents", "page").agg(F.count("*").alias("n"))


#: The labelled side: the rows themselves, of which some are labelled otherwise and some are missing.
SQL_LABELLED = f"{SQL_CLASS_ROWS}, labelled as (select *, case when row_id like '%3_a' then not transfer else transfer end as label from class_rows where row_id not like '%7_a')"


def key_gaps(ledger: Ledger) -> DataFrame:
    """By the five-part key: how many rows look like transfers here and by label."""
    rows = class_table(ledger)
    key = ["source", "stamp", "direction", "cents", "page"]
    label = F.when(F.col("row_id").endswith("3_a"), ~F.col("transfer")).otherwise(F.col("transfer"))
    own = rows.groupBy(*key).agg(F.count_if("transfer").alias("own"), F.count("*").alias("n_own"))
    theirs = rows.where(~F.col("row_id").endswith("7_a")).withColumn("label", label).groupBy(*key).agg(F.count_if("label").alias("theirs"), F.count("*").alias("n_theirs"))
    return own.join(theirs, key, "full").na.fill(0, ["own", "n_own", "theirs", "n_theirs"]).withColumn("gap", F.col("own") - F.col("theirs"))


SQL_GAPS = f"""{SQL_LABELLED}, own as (select source, stamp, direction, cents, page, count(*) filter (where transfer) as own, count(*) as n_own from class_rows group by all),
theirs as (select source, stamp, direction, cents, page, count(*) filter (where label) as theirs, count(*) as n_theirs from labelled group by all),
gaps as (select source, stamp, direction, cents, page, coalesce(own, 0) as own, coalesce(theirs, 0) as theirs, coalesce(own, 0) - coalesce(theirs, 0) as gap from own full join theirs using (source, stamp, direction, cents, page))"""


@register("class_mismatch", duck(f"with {SQL_GAPS} select * from gaps where gap <> 0 order by abs(gap) desc, source, stamp, direction, cents, page limit 200"))
def class_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys on which the two sides differ most."""
    gaps = key_gaps(Ledger(spark, sf_dir)).where("gap <> 0")
    return gaps.orderBy(F.desc(F.abs("gap")), "source", "stamp", "direction", "cents", "page").limit(200).select("source", "stamp", "direction", "cents", "page", "own", "theirs", "gap")


@register("class_breakdown", duck(f"with {SQL_GAPS} select coalesce(source, '*') as source, coalesce(direction, '*') as direction, sum(greatest(gap, 0))::bigint as n_over, sum(greatest(-gap, 0))::bigint as n_under from gaps where gap <> 0 group by grouping sets ((), (source), (direction))"))
def class_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the two sides differ: in all, by file, and by direction."""
    gaps = key_gaps(Ledger(spark, sf_dir)).where("gap <> 0")
    sums_ = gaps.groupingSets([[], [F.col("source")], [F.col("direction")]], F.col("source"), F.col("direction")).agg(F.sum(F.greatest("gap", F.lit(0))).alias("n_over"), F.sum(F.greatest(-F.col("gap"), F.lit(0))).alias("n_under"))
    return sums_.select(F.coalesce("source", F.lit("*")).alias("source"), F.coalesce("direction", F.lit("*")).alias("direction"), "n_over", "n_under")


@register("align_plan", duck(f"""with {SQL_GAPS} select row_id, case when gap > 0 then 'demote' else 'promote' end as action from (
  select c.*, gap, row_number() over (partition by source, stamp, direction, cents, page, transfer order by row_id) as k from class_rows c join gaps using (source, stamp, direction, cents, page) where gap <> 0)
  where k <= abs(gap) and transfer = (gap > 0)"""))  # fmt: skip
def align_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each key with a gap as many rows as it takes, by id; a row has one key, so none is taken twice."""
    ledger = Ledger(spark, sf_dir)
    key = ["source", "stamp", "direction", "cents", "page"]
    rows = class_table(ledger).join(key_gaps(ledger).where("gap <> 0").select(*key, "gap"), key).where(F.col("transfer") == (F.col("gap") > 0))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("row_id"))
    return rows.withColumn("k", place).where(F.col("k") <= F.abs("gap")).select("row_id", F.when(F.col("gap") > 0, "demote").otherwise("promote").alias("action"))


def category_changes(ledger: Ledger) -> DataFrame:
    """What the guardrail and the merchant cascade would change of linked transactions that aren't internal."""
    linked = ledger.links.select(F.col("transaction_id").alias("id")).distinct()
    tx = ledger.transactions.join(linked, "id", "left_semi").where(text("meaning") != "internal_transfer")
    after = guarded(text("category"), folded("meaning"), F.coalesce("review_status", F.lit("needs_review")), F.col("direction"))
    merchant = F.coalesce(F.nullif(F.trim(text("merchant_normalized")), F.lit("")), merchant_label(F.col("description_raw"), text("bank_category"), F.col("direction")))
    plan = tx.select("id", text("category").alias("category"), text("merchant_normalized").alias("merchant"), after.alias("new_category"), merchant.alias("new_merchant"))
    return plan.withColumns({"category_changed": F.col("category") != F.col("new_category"), "merchant_changed": F.col("merchant") != F.col("new_merchant")})


SQL_CHANGES = f"""said as (
  select *, {SQL_SPACED.format('description_raw')} as l, coalesce(category, '') as own, lower(trim(coalesce(meaning, ''))) as meant, coalesce(review_status, 'needs_review') as seen
  from {{transactions}} where id in (select transaction_id from {{links}}) and coalesce(meaning, '') <> 'internal_transfer'),
changes as (select id, own as category, coalesce(merchant_normalized, '') as merchant, {sql_guard('own', 'meant', 'seen')} as new_category,
    coalesce(nullif(trim(coalesce(merchant_normalized, '')), ''), {sql_merchant("coalesce(bank_category, '')")}) as new_merchant
  from (select *, {sql_counterparty('l')} as counterparty from said))"""


@register("category_plan", duck(f"with {SQL_CHANGES} select id, new_category, new_merchant, category <> new_category as category_changed, merchant <> new_merchant as merchant_changed from changes where category <> new_category or merchant <> new_merchant"))
def category_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = category_changes(Ledger(spark, sf_dir))
    return plan.where("category_changed or merchant_changed").select("id", "new_category", "new_merchant", "category_changed", "merchant_changed")


@register("apply_plan", duck(f"with {SQL_CHANGES} select t.id, coalesce(new_category, t.category) as category, coalesce(new_merchant, t.merchant_normalized) as merchant from {{transactions}} t left join changes c on c.id = t.id and (c.category <> new_category or c.merchant <> new_merchant)"))
def apply_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as the plan leaves them."""
    ledger = Ledger(spark, sf_dir)
    plan = category_changes(ledger).where("category_changed or merchant_changed").select("id", "new_category", "new_merchant")
    return ledger.transactions.join(plan, "id", "left").select("id", F.coalesce("new_category", "category").alias("category"), F.coalesce("new_merchant", "merchant_normalized").alias("merchant"))


SQL_PRINT = "sha256(concat_ws('|', 'row-v1', r.account, lower(trim(r.currency)), lower(trim(r.direction)), (abs(r.amount) * 100)::bigint::varchar, strftime(r.operation_date, '%Y-%m-%dT%H:%M:%S'), lower(trim(regexp_replace(r.raw_text, '\\s+', ' ', 'g')))))"
SQL_COLLAPSES = f"""collapses as (select transaction_id, count(*) as n, count(distinct statement_id) as n_statements, count(distinct print) as n_prints from (
  select l.transaction_id, r.statement_id, {SQL_PRINT} as print from {{links}} l join (select *, split_part(statement_id, '_', 2) as account from {{statement_rows}}) r on r.id = l.statement_row_id) group by 1 having count(*) > 1),
classed as (select *, n - 1 as surplus, case when n_statements > 1 and n_prints = 1 then 'expected_overlap_dedupe' when n_statements > 1 then 'cross_statement_variance_merge' when n_prints = 1 then 'same_statement_duplicate_collapse' else 'same_statement_variance_merge' end as kind from collapses)"""


def collapses(ledger: Ledger) -> DataFrame:
    """Transactions that several rows fell into, with what kind of collapse that is and how many rows too many."""
    said = F.lower(F.trim(F.regexp_replace("raw_text", r"\s+", " ")))
    parts = ["row-v1", F.split_part("statement_id", F.lit("_"), F.lit(2)), F.lower(F.trim("currency")), F.lower(F.trim("direction")), F.abs(cents(F.col("amount"))).cast("string"), F.date_format("operation_date", "yyyy-MM-dd'T'HH:mm:ss"), said]
    print_ = F.sha2(F.concat_ws("|", F.lit(parts[0]), *parts[1:]), 256)
    rows = ledger.links.join(ledger.statement_rows.select(F.col("id").alias("statement_row_id"), "statement_id", print_.alias("print")), "statement_row_id")
    groups = rows.groupBy("transaction_id").agg(F.count("*").alias("n"), F.countDistinct("statement_id").alias("n_statements"), F.countDistinct("print").alias("n_prints")).where("n > 1")
    across, alike = F.col("n_statements") > 1, F.col("n_prints") == 1
    kind = F.when(across & alike, "expected_overlap_dedupe").when(across, "cross_statement_variance_merge").when(alike, "same_statement_duplicate_collapse").otherwise("same_statement_variance_merge")
    return groups.withColumns({"surplus": F.col("n") - 1, "kind": kind})


@register("collapse_audit", duck(f"with {SQL_COLLAPSES} select coalesce(kind, '*') as kind, count(*) as n_tx, sum(surplus)::bigint as n_rows, coalesce(sum(surplus) filter (where kind <> 'expected_overlap_dedupe'), 0)::bigint as unexpected from classed group by rollup(kind)"))
def collapse_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    unexpected = F.sum(F.when(F.col("kind") != "expected_overlap_dedupe", F.col("surplus")).otherwise(0))
    sums_ = collapses(Ledger(spark, sf_dir)).rollup("kind").agg(F.count("*").alias("n_tx"), F.sum("surplus").alias("n_rows"), unexpected.alias("unexpected"))
    return sums_.withColumn("kind", F.coalesce("kind", F.lit("*")))


@register("source_reco", duck(f"""with {SQL_COLLAPSES}, s as (select coalesce(sum(surplus), 0)::bigint as surplus, coalesce(sum(surplus) filter (where kind <> 'expected_overlap_dedupe'), 0)::bigint as unexpected from classed)
select case when surplus > 0 then 'statement_rows' else 'canonical_transactions' end as gross_source, case when surplus > 0 then 'warning' else 'ok' end as status, surplus, unexpected from s"""))  # fmt: skip
def source_reco(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which side sums should be read from."""
    own = collapses(Ledger(spark, sf_dir))
    one = own.agg(F.coalesce(F.sum("surplus"), F.lit(0)).alias("surplus"), F.coalesce(F.sum(F.when(F.col("kind") != "expected_overlap_dedupe", F.col("surplus"))), F.lit(0)).alias("unexpected"))
    more = F.col("surplus") > 0
    return one.select(F.when(more, "statement_rows").otherwise("canonical_transactions").alias("gross_source"), F.when(more, "warning").otherwise("ok").alias("status"), "surplus", "unexpected")


# The ledger of before: the same transactions without the first, outflows with a sign.
SQL_PARITY = """own as (select count(*) as n, count(*) filter (where direction = 'out') as n_out, count(*) filter (where direction = 'in') as n_in, coalesce(sum(amount) filter (where direction = 'out'), 0) as spend, coalesce(sum(amount) filter (where direction = 'in'), 0) as income from {transactions}),
old as (select count(*) as n, count(*) filter (where direction = 'out') as n_out, count(*) filter (where direction = 'in') as n_in, coalesce(sum(-amount) filter (where direction = 'out'), 0) as spend, coalesce(sum(amount) filter (where direction = 'in'), 0) as income from {transactions} where id not like '%00')"""


@register("legacy_parity", duck(f"""with {SQL_PARITY} select own.n - old.n as n_delta, own.n_out - old.n_out as out_delta, own.n_in - old.n_in as in_delta, (own.spend - abs(old.spend))::decimal(20,2) as spend_delta, (own.income - old.income)::decimal(20,2) as income_delta,
  case when old.n <> 0 then round((own.n - old.n)::double / old.n * 100, 6) end as n_share, case when old.spend < 0 then 'negative' else 'non_negative' end as sign,
  case when own.n = old.n and own.n_out = old.n_out and own.n_in = old.n_in and own.spend = abs(old.spend) and own.income = old.income then 'ok' else 'drift' end as status from own, old"""))  # fmt: skip
def legacy_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger against that of before: differences, the share of one, and whether outflows had a sign."""
    tx = Ledger(spark, sf_dir).transactions
    out, into = F.col("direction") == "out", F.col("direction") == "in"
    count = lambda name, sign: [F.count("*").alias(f"{name}_n"), F.count_if(out).alias(f"{name}_out"), F.count_if(into).alias(f"{name}_in"), total(sign * F.col("amount"), out).alias(f"{name}_spend"), total(F.col("amount"), into).alias(f"{name}_income")]
    both = tx.agg(*count("own", 1)).join(F.broadcast(tx.where(~F.col("id").endswith("00")).agg(*count("old", -1))))  # one row each
    d = {n: F.col(f"own_{n}") - F.col(f"old_{n}") for n in ("n", "out", "in", "income")} | {"spend": F.col("own_spend") - F.abs("old_spend")}
    same = (d["n"] == 0) & (d["out"] == 0) & (d["in"] == 0) & (d["spend"] == 0) & (d["income"] == 0)
    share = F.when(F.col("old_n") != 0, F.round(d["n"].cast("double") / F.col("old_n") * 100, 6))
    return both.select(
        d["n"].alias("n_delta"), d["out"].alias("out_delta"), d["in"].alias("in_delta"), money(d["spend"]).alias("spend_delta"), money(d["income"]).alias("income_delta"), share.alias("n_share"),
        F.when(F.col("old_spend") < 0, "negative").otherwise("non_negative").alias("sign"), F.when(same, "ok").otherwise("drift").alias("status"),
    )


@register("quality_report")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as one text of JSON; tests read it back and hold its parts against the queries that have SQL."""
    ledger = Ledger(spark, sf_dir)
    both = core(ledger).join(F.broadcast(integrity(ledger)))  # one row each
    return both.select(F.to_json(F.struct(*[F.col(c) for c in both.columns])).alias("report"))


def confidence() -> Column:
    factor = F.when(F.col("status") == "ok", 1.0).when(F.col("status") == "mismatch", 0.3).otherwise(0.7)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("parse_confidence"), F.lit(0.5)) * factor)), 4)


SQL_STATUS = """case when opening_balance is null or closing_balance is null then 'unknown' when abs(opening_balance + coalesce(total_credits, 0) - coalesce(total_debits, 0) - closing_balance) <= 0.01 then 'ok' else 'mismatch' end"""
SQL_SNAPSHOTS = f"""told as (select id, account_id, period_start, period_end, opening_balance, closing_balance, round(least(1, greatest(0, coalesce(case when id like '%3' then null else 0.85::double end, 0.5::double) * case {SQL_STATUS} when 'ok' then 1.0::double when 'mismatch' then 0.3::double else 0.7::double end)), 4) as confidence from {{statements}}),
snapshots as (select account_id, id as statement_id, period_start as ts, opening_balance as balance, 'statement_opening_balance' as method, confidence from told where opening_balance is not null and period_start is not null
  union all select account_id, id, period_end, closing_balance, 'statement_closing_balance', confidence from told where closing_balance is not null and period_end is not null)"""


@register("balance_snapshots", duck(f"with {SQL_SNAPSHOTS} select account_id, statement_id, ts, balance, method, confidence from snapshots"))
def balance_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two balances of each statement, with how sure they are."""
    own = Ledger(spark, sf_dir).statements
    zero = F.lit(0).cast("decimal(14,2)")
    delta = F.col("opening_balance") + F.coalesce("total_credits", zero) - F.coalesce("total_debits", zero) - F.col("closing_balance")
    status = F.when(delta.isNull(), "unknown").when(F.abs(delta) <= F.lit("0.01").cast("decimal(14,2)"), "ok").otherwise("mismatch")
    told_ = own.withColumns({"status": status, "parse_confidence": F.when(~F.col("id").endswith("3"), F.lit(0.85))}).withColumn("confidence", confidence())
    one = lambda at, balance, method: F.struct(F.col(at).alias("ts"), F.col(balance).alias("balance"), F.lit(method).alias("method"))
    both = F.explode(F.array(one("period_start", "opening_balance", "statement_opening_balance"), one("period_end", "closing_balance", "statement_closing_balance"))).alias("s")
    return told_.select("account_id", F.col("id").alias("statement_id"), "confidence", both).where("s.ts is not null and s.balance is not null").select("account_id", "statement_id", "s.*", "confidence")


@register("reconcile_payload", duck("""select id, (opening_balance + credits - debits)::decimal(20,2) as expected, (opening_balance + credits - debits - closing_balance)::decimal(20,2) as delta, method from (
  select s.id, opening_balance, closing_balance, case when total_credits is not null and total_debits is not null then total_credits else coalesce(c, 0) end as credits, case when total_credits is not null and total_debits is not null then total_debits else coalesce(d, 0) end as debits,
    case when total_credits is not null and total_debits is not null then 'statement_totals' else 'computed_from_parsed_transactions' end as method
  from {statements} s left join (select 'st_' || lpad(l_orderkey::varchar, 8, '0') as id, sum(case when l_returnflag <> 'R' then l_extendedprice::decimal(14,2) end) as c, sum(case when l_returnflag = 'R' then l_extendedprice::decimal(14,2) end) as d from {lineitem} group by 1) r on r.id = s.id)
where opening_balance is not null and closing_balance is not null"""))  # fmt: skip
def reconcile_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a statement's balances should be, by its own totals or else by the sums of its rows."""
    ledger = Ledger(spark, sf_dir)
    amount, back = F.col("l_extendedprice").cast("decimal(14,2)"), F.col("l_returnflag") == "R"
    rows = ledger.base("lineitem").groupBy(F.concat(F.lit("st_"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0")).alias("id")).agg(F.sum(F.when(~back, amount)).alias("c"), F.sum(F.when(back, amount)).alias("d"))
    own = ledger.statements.where("opening_balance is not null and closing_balance is not null").join(rows, "id", "left")
    stated = F.col("total_credits").isNotNull() & F.col("total_debits").isNotNull()
    part = lambda name, sums_: F.when(stated, F.col(name)).otherwise(F.coalesce(F.col(sums_), F.lit(0)))
    expected = F.col("opening_balance") + part("total_credits", "c") - part("total_debits", "d")
    return own.select("id", money(expected).alias("expected"), money(expected - F.col("closing_balance")).alias("delta"), F.when(stated, "statement_totals").otherwise("computed_from_parsed_transactions").alias("method"))


@register("monthly_flow_scoped", duck(f"""select strftime(date_trunc('month', coalesce(operation_datetime, created_at)), '%Y-%m') as period, {SUMS} from {{transactions}}
where coalesce(operation_datetime, created_at) between timestamp '2024-01-05' and timestamp '2024-01-20' and currency = 'RUB' and not {SQL_LENS['strict_transfer_like']} group by 1"""))  # fmt: skip
def monthly_flow_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = in_scope(Ledger(spark, sf_dir).transactions, "2024-01-05", "2024-01-20", "RUB", "strict_transfer_like")
    return rows.groupBy(F.date_format(event_time(), "yyyy-MM").alias("period")).agg(*sums())


def in_scope(tx: DataFrame, start: str | None = None, end: str | None = None, currency: str | None = None, lens_name: str = "internal_only", include_transfers: bool = False) -> DataFrame:
    """The transactions that the analytics queries count: a range of time on both ends, a currency, a lens."""
    at = lambda value: F.lit(value).cast("timestamp_ntz")
    if start:
        tx = tx.where(event_time() >= at(start))
    if end:
        tx = tx.where(event_time() <= at(end))
    if currency:
        tx = tx.where(F.col("currency") == currency)
    return tx if include_transfers else tx.where(~lens(lens_name))


SCOPES = {
    "spend_mix_scoped": ("coalesce(nullif(trim(category), ''), 'Uncategorized')", "out", "high_confidence_transfer_like"),
    "top_merchants_scoped": ("coalesce(nullif(trim(merchant_normalized), ''), nullif(trim(bank_category), ''), 'Unknown')", "out", None),
    "income_breakdown_scoped": ("case when lower(trim(meaning)) in ('salary', 'interest', 'cashback', 'refund') then lower(meaning) else 'other' end", "in", "strict_transfer_like"),
}


def _register_scope(key: str, label: str, direction: str, name: str | None) -> None:
    kept = f"not {SQL_LENS[name]}" if name else "true"

    @register(key, duck(f"""select {label} as label, count(*) as n_tx, sum(abs(amount))::decimal(20,2) as total from {{transactions}} where direction = '{direction}' and {kept}
  and coalesce(operation_datetime, created_at) between timestamp '2024-01-03' and timestamp '2024-01-25' group by 1 order by total desc, 1 limit 25"""))  # fmt: skip
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tx = in_scope(Ledger(spark, sf_dir).transactions, "2024-01-03", "2024-01-25", None, name or "internal_only", name is None)
        rows = tx.where(F.col("direction") == direction).select(F.expr(label).alias("label"), F.abs("amount").alias("amount"))
        return rows.groupBy("label").agg(F.count("*").alias("n_tx"), money(F.sum("amount")).alias("total")).orderBy(F.desc("total"), "label").limit(25)


for _key, (_label, _direction, _name) in SCOPES.items():
    _register_scope(_key, _label, _direction, _name)
