"""The review queue and what is done to its items; uploads, files and batches; deletions of files and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.columns import blank, ledger_time, needs_review, text
from ledgerloom.plans.browse import SQL_REVIEW
from ledgerloom.plans.registry import register
from ledgerloom.plans.rules import tags
from ledgerloom.sources.ledger import Ledger, duck

MONEY = "coalesce(abs(amount), 0)"
SQL_EVENT = "coalesce(strftime(coalesce(operation_datetime, posting_datetime, created_at), '%Y-%m-%dT%H:%M:%S'), '')"
#: Items of all three kinds. An exception that is a mismatch of balances is an anomaly; the severity is in its payload here.
SQL_ITEMS = f"""tx as (select id, amount, category, {SQL_EVENT} as event, {SQL_REVIEW} as uncategorized from {{transactions}}),
open_exceptions as (select * from {{exceptions}} where status = 'open'), suggested as (select * from {{transfer_links}} where status = 'suggested'),
queued as (select entity_id as id from open_exceptions where entity_type = 'transaction' union select transaction_out_id from suggested union select transaction_in_id from suggested),
items as (
  select 'transfer:' || l.id as key, 'transfer' as lane, 3000 + round(match_score::double * 100)::bigint - least(50, round(abs({MONEY.replace('amount', 'o.amount')} - {MONEY.replace('amount', 'i.amount')})::double / 100)::bigint) as urgency,
    {MONEY.replace('amount', 'o.amount')} + {MONEY.replace('amount', 'i.amount')} as impact, match_score::double as confidence, coalesce(o.event, i.event, l.id) as event
  from suggested l left join tx o on o.id = transaction_out_id left join tx i on i.id = transaction_in_id
  union all select 'exception:' || x.id, case when exception_type = 'reconcile_mismatch' then 'anomaly' else 'exception' end,
    case when exception_type = 'reconcile_mismatch' then 4000 else 3200 end + 100 * case json_extract_string(payload, '$.k') when '1' then 3 when '2' then 2 when '3' then 1 else 0 end, {MONEY.replace('amount', 't.amount')}, 0, coalesce(t.event, x.id)
  from open_exceptions x left join tx t on t.id = x.entity_id
  union all select 'transaction:' || id, case when trim(coalesce(category, '')) = '' or uncategorized then 'category' else 'review' end, case when trim(coalesce(category, '')) = '' or uncategorized then 2600 else 2400 end, abs(amount), 0, event
  from tx where id not in (select id from queued) and (uncategorized or id in (select id from {{transactions}} where review_status = 'needs_review')))"""


def event_key() -> Column:
    return F.coalesce(F.date_format(ledger_time(), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def standalone(ledger: Ledger) -> DataFrame:
    """Transactions that need review and aren't in the queue by an exception or a suggested transfer."""
    links = ledger.transfer_links.where("status = 'suggested'").select(F.explode(F.array("transaction_out_id", "transaction_in_id")).alias("id"))
    open_ = ledger.exceptions.where("status = 'open' and entity_type = 'transaction'").select(F.col("entity_id").alias("id"))
    waiting = ledger.transactions.where(needs_review() | (F.col("review_status") == "needs_review"))
    return waiting.join(links.union(open_), "id", "left_anti")


def items(ledger: Ledger) -> DataFrame:
    """(key, lane, urgency, impact, confidence, event) of everything that waits for somebody."""
    size = lambda c: F.coalesce(F.abs(c), F.lit(0))
    tx = ledger.transactions.select("id", "amount", event_key().alias("event"))
    end = lambda side: tx.select(F.col("id").alias(f"transaction_{side}_id"), F.col("amount").alias(side), F.col("event").alias(f"{side}_event"))
    links = ledger.transfer_links.where("status = 'suggested'").join(end("out"), "transaction_out_id", "left").join(end("in"), "transaction_in_id", "left")
    apart = F.round(F.abs(size("out") - size("in")).cast("double") / 100).cast("bigint")
    urgency = F.lit(3000) + F.round(F.col("match_score").cast("double") * 100).cast("bigint") - F.least(F.lit(50), apart)
    score = F.col("match_score").cast("double")
    transfers = links.select(F.concat(F.lit("transfer:"), "id").alias("key"), F.lit("transfer").alias("lane"), urgency.alias("urgency"), (size("out") + size("in")).alias("impact"), score.alias("confidence"), F.coalesce("out_event", "in_event", "id").alias("event"))

    anomaly, k = F.col("exception_type") == "reconcile_mismatch", F.get_json_object("payload", "$.k")
    severity = F.when(k == "1", 3).when(k == "2", 2).when(k == "3", 1).otherwise(0)
    related = ledger.exceptions.where("status = 'open'").join(tx.withColumnRenamed("id", "entity_id"), "entity_id", "left")
    exceptions = related.select(
        F.concat(F.lit("exception:"), "id").alias("key"), F.when(anomaly, "anomaly").otherwise("exception").alias("lane"), (F.when(anomaly, 4000).otherwise(3200) + severity * 100).cast("bigint").alias("urgency"),
        size("amount").alias("impact"), F.lit(0.0).alias("confidence"), F.coalesce("event", "id").alias("event"),
    )
    empty = blank("category") | needs_review()
    single = standalone(ledger).select(
        F.concat(F.lit("transaction:"), "id").alias("key"), F.when(empty, "category").otherwise("review").alias("lane"), F.when(empty, 2600).otherwise(2400).cast("bigint").alias("urgency"),
        F.abs("amount").alias("impact"), F.lit(0.0).alias("confidence"), event_key().alias("event"),
    )
    return transfers.unionByName(exceptions).unionByName(single)


QUEUE = [F.desc, "urgency", "impact", "confidence", "event"]
SQL_QUEUE = "urgency desc, impact desc, confidence desc, event desc, key"


@register("review_queue", duck(f"with {SQL_ITEMS} select key, lane, urgency, impact::decimal(20,2) as impact from items order by {SQL_QUEUE} limit 100"))
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to look at first: by urgency, impact, confidence and time."""
    ordered = items(Ledger(spark, sf_dir)).orderBy(*[F.desc(c) for c in QUEUE[1:]], "key").limit(100)
    return ordered.select("key", "lane", "urgency", F.col("impact").cast("decimal(20,2)").alias("impact"))


@register("review_lane_counts", duck(f"with {SQL_ITEMS} select lane, count(*) as n from items group by 1"))
def review_lane_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(Ledger(spark, sf_dir)).groupBy("lane").agg(F.count("*").alias("n"))


@register("standalone_review", duck(f"with {SQL_ITEMS} select id from tx where id not in (select id from queued) and (uncategorized or id in (select id from {{transactions}} where review_status = 'needs_review'))"))
def standalone_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standalone(Ledger(spark, sf_dir)).select("id")


@register("merge_review", duck(f"""with {SQL_ITEMS}, both_ as (select id, 1 as g from tx where uncategorized union all select id, 2 from {{transactions}} where review_status = 'needs_review')
select id, min(g)::int as g, any_value(event) as event from both_ join tx using (id) group by 1"""))  # fmt: skip
def merge_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists as one: an item that both hold stands where the first has it."""
    tx = Ledger(spark, sf_dir).transactions
    told = tx.withColumn("g", F.when(needs_review(), 1).when(F.col("review_status") == "needs_review", 2)).where("g is not null")
    return told.select("id", "g", event_key().alias("event")).orderBy(F.desc("event"), F.desc("id"))


@register("next_review_item", duck("""select kind, id from (select 0 as rank, 'transfer' as kind, id, created_at from {transfer_links} where status = 'suggested' union all select 1, 'exception', id, created_at from {exceptions} where status = 'open')
order by rank, created_at desc, id desc limit 1"""))  # fmt: skip
def next_review_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suggested transfer if there is one, else an open exception; the newest."""
    ledger = Ledger(spark, sf_dir)
    kind = lambda df, rank, name: df.select(F.lit(rank).alias("rank"), F.lit(name).alias("kind"), "id", "created_at")
    both = kind(ledger.transfer_links.where("status = 'suggested'"), 0, "transfer").unionByName(kind(ledger.exceptions.where("status = 'open'"), 1, "exception"))
    return both.orderBy("rank", F.desc("created_at"), F.desc("id")).limit(1).select("kind", "id")


SQL_CAPITAL = "upper(left(trim({0}), 1)) || substr(trim({0}), 2)"


def capital(value: Column) -> Column:
    return F.concat(F.upper(F.left(F.trim(value), F.lit(1))), F.substring(F.trim(value), 2, 1 << 30))


def approved() -> Column:
    full = lambda c: F.nullif(F.trim(text(c)), F.lit(""))
    return F.coalesce(full("category"), F.nullif(capital(text("bank_category")), F.lit("")), F.lit("Uncategorized"))


@register("approved_category", duck(f"select id, coalesce(nullif(trim(category), ''), nullif({SQL_CAPITAL.format('bank_category')}, ''), 'Uncategorized') as category, 'reviewed' as review_status from {{transactions}}"))
def approved_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ledger(spark, sf_dir).transactions.select("id", approved().alias("category"), F.lit("reviewed").alias("review_status"))


@register("suggested_category", duck(f"""select x.id, coalesce(nullif(trim(json_extract_string(payload, '$.suggested_category')), ''), nullif(trim(json_extract_string(payload, '$.category')), ''), nullif(trim(json_extract_string(payload, '$.after_category')), ''),
  nullif(trim(json_extract_string(payload, '$.suggested.category')), ''), nullif({SQL_CAPITAL.format("coalesce(t.bank_category, '')")}, ''), 'Uncategorized') as category from {{exceptions}} x left join {{transactions}} t on t.id = x.entity_id"""))  # fmt: skip
def suggested_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first category that an exception's payload names, else the bank's."""
    ledger = Ledger(spark, sf_dir)
    named = [F.nullif(F.trim(F.get_json_object("payload", f"$.{k}")), F.lit("")) for k in ("suggested_category", "category", "after_category", "suggested.category")]
    tx = ledger.transactions.select(F.col("id").alias("entity_id"), "bank_category")
    told = ledger.exceptions.join(tx, "entity_id", "left")
    return told.select("id", F.coalesce(*named, F.nullif(capital(text("bank_category")), F.lit("")), F.lit("Uncategorized")).alias("category"))


DUPLICATE = ("duplicate", "is_duplicate", "suspected_duplicate")


@register("dup_candidate", duck("select id, exception_type like '%duplicate%' or " + " or ".join(f"coalesce(json_extract_string(payload, '$.{k}') = 'true', false)" for k in DUPLICATE) + " as candidate from {exceptions}"))
def dup_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.lower(text("exception_type")).contains("duplicate")
    for key in DUPLICATE:
        told = told | F.coalesce(F.get_json_object("payload", f"$.{key}") == "true", F.lit(False))
    return Ledger(spark, sf_dir).exceptions.select("id", told.alias("candidate"))


@register("mark_duplicate", duck("""select id, case when trim(coalesce(category, '')) = '' then 'Duplicate' else category end as category, 'reviewed' as review_status,
  array_to_string(list_concat(list_filter(string_split(coalesce(tag_list, ''), ','), lambda t: t <> ''), case when list_contains(string_split(coalesce(tag_list, ''), ','), 'duplicate') then [] else ['duplicate'] end), ',') as tags
from {transactions} where id in (select entity_id from {exceptions} where exception_type like '%duplicate%' and status = 'open')"""))  # fmt: skip
def mark_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as they are left when open suspicions of duplicates are confirmed."""
    ledger = Ledger(spark, sf_dir)
    ids = ledger.exceptions.where("exception_type like '%duplicate%' and status = 'open'").select(F.col("entity_id").alias("id"))
    tagged = F.array_join(F.array_union(tags(), F.array(F.lit("duplicate"))), ",")
    return ledger.transactions.join(ids, "id", "left_semi").select("id", F.when(blank("category"), "Duplicate").otherwise(F.col("category")).alias("category"), F.lit("reviewed").alias("review_status"), tagged.alias("tags"))


@register("resolve_exceptions", duck("select id, case when exception_type like '%duplicate%' then 'resolved' else status end as status, case when exception_type like '%duplicate%' then 'marked_duplicate' end as resolution from {exceptions}"))
def resolve_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.col("exception_type").contains("duplicate")
    return Ledger(spark, sf_dir).exceptions.select("id", F.when(chosen, "resolved").otherwise(F.col("status")).alias("status"), F.when(chosen, "marked_duplicate").alias("resolution"))


@register("needs_review_not", duck(f"select id from {{transactions}} where not {SQL_REVIEW}"))
def needs_review_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that needs no look; of an unknown reason that is every transaction."""
    return reviewed_for(Ledger(spark, sf_dir).transactions, needs=False).select("id")


def reviewed_for(tx: DataFrame, needs: bool = True, reason: str = "") -> DataFrame:
    known = reason.strip().lower() in ("", "uncategorized_needs_review")
    wanted = needs_review() if known else F.lit(False)
    return tx.where(wanted if needs else ~wanted)


# Files of uploads: each is one of twelve contents; those of the first three are stored already.
SQL_UPLOADS = "(select event_id as id, event_id // 20 as batch, sha256(event_type || cast(user_id as varchar)) as hash, event_id % 9 as k from {events})"
SQL_STATUS = "case when hash in (select hash from {0} where id < 5) or row_number() over (partition by hash order by id) > 1 then 'duplicate' else 'queued' end"


def uploads(ledger: Ledger) -> DataFrame:
    return ledger.base("events").select(F.col("event_id").alias("id"), F.floor(F.col("event_id") / 20).alias("batch"), F.sha2(F.concat("event_type", F.col("user_id").cast("string")), 256).alias("hash"), (F.col("event_id") % 9).alias("k"))


def deduped(files: DataFrame, stored: DataFrame) -> DataFrame:
    """A file is queued if its content isn't stored and no earlier upload has it; the first is found by a partial minimum."""
    first = files.groupBy("hash").agg(F.min("id").alias("first")).join(stored.select("hash").distinct(), "hash", "left_anti")
    told = files.join(first, "hash", "left")
    return told.withColumn("status", F.when(F.coalesce(F.col("first") == F.col("id"), F.lit(False)), "queued").otherwise("duplicate"))


def received(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = uploads(Ledger(spark, sf_dir))
    return deduped(files, files.where("id < 5"))


@register("file_dedupe", duck(f"select id, {SQL_STATUS.format(SQL_UPLOADS)} as status from {SQL_UPLOADS}"))
def file_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return received(spark, sf_dir).select("id", "status")


@register("batch_summary", duck(f"""select batch, count(*) as n_files, count(*) filter (where status = 'queued') as created, case when count(*) filter (where status = 'queued') > 0 then 'queued' else 'failed' end as status
from (select batch, {SQL_STATUS.format(SQL_UPLOADS)} as status from {SQL_UPLOADS}) group by 1"""))  # fmt: skip
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = F.count_if(F.col("status") == "queued")
    return received(spark, sf_dir).groupBy("batch").agg(F.count("*").alias("n_files"), created.alias("created"), F.when(created > 0, "queued").otherwise("failed").alias("status"))


def progress() -> Column:
    """What became of the files: some failed, some wait, the others are done."""
    return F.when((F.col("k") == 0) & (F.col("batch") % 3 == 0), "failed").when((F.col("k") == 1) & (F.col("batch") % 2 == 0), "queued").otherwise("processed")


SQL_PROGRESS = "case when k = 0 and batch % 3 = 0 then 'failed' when k = 1 and batch % 2 = 0 then 'queued' else 'processed' end"


@register("batch_status", duck(f"select batch, case when bool_or(s = 'failed') then 'failed' when bool_or(s in ('queued', 'processing')) then 'queued' else 'processed' end as status from (select batch, {SQL_PROGRESS} as s from {SQL_UPLOADS}) group by 1"))
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = uploads(Ledger(spark, sf_dir)).withColumn("s", progress())
    some = lambda *names: F.bool_or(F.col("s").isin(*names))
    return files.groupBy("batch").agg(F.when(some("failed"), "failed").when(some("queued", "processing"), "queued").otherwise("processed").alias("status"))


@register("batch_file_status", duck(f"select batch, count(*) filter (where s = 'failed') as failed, count(*) filter (where s = 'queued') as queued, count(*) filter (where s = 'processed') as processed from (select batch, {SQL_PROGRESS} as s from {SQL_UPLOADS}) group by 1"))
def batch_file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = uploads(Ledger(spark, sf_dir)).withColumn("s", progress())
    return files.groupBy("batch").agg(*[F.count_if(F.col("s") == name).alias(name) for name in ("failed", "queued", "processed")])


@register("reprocess_files", duck(f"select id, case when {SQL_PROGRESS} = 'failed' then 'queued' else {SQL_PROGRESS} end as status from {SQL_UPLOADS}"))
def reprocess_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads(Ledger(spark, sf_dir)).select("id", F.when(progress() == "failed", "queued").otherwise(progress()).alias("status"))


SQL_SAFE = "regexp_replace(regexp_replace(file_name, '^.*/', ''), '[^A-Za-z0-9._-]+', '_', 'g')"


@register("file_content_hash", duck(f"""select distinct file_name, sha256(file_name || ' content') as hash, coalesce(nullif(left(trim({SQL_SAFE}, '._'), 160), ''), 'statement.pdf') as safe_name, lower(file_name) like '%.pdf' as is_pdf from {{lines}}"""))
def file_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a file's content and its name as it may be stored."""
    files = Ledger(spark, sf_dir).lines.select("file_name").distinct()
    return files.select("file_name", F.sha2(F.concat("file_name", F.lit(" content")), 256).alias("hash"), safe_name(F.col("file_name")).alias("safe_name"), F.lower("file_name").endswith(".pdf").alias("is_pdf"))


def safe_name(name: Column, most: int = 160) -> Column:
    """Letters, digits, dots, underscores and hyphens of a file's name; a long one loses the end of its stem."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), "^.*/", ""), "[^A-Za-z0-9._-]+", "_")
    bare = F.regexp_replace(F.regexp_replace(plain, "^[._]+", ""), "[._]+$", "")
    suffix = F.regexp_extract(bare, r"(\.[^.]+)$", 1)
    short = F.concat(F.left(bare, F.greatest(F.lit(1), F.lit(most) - F.length(suffix))), suffix)
    return F.when(bare == "", "statement.pdf").when(F.length(bare) > most, short).otherwise(bare)


def gone_with(ledger: Ledger, sheets: DataFrame) -> DataFrame:
    """What goes with statements: rows, links, transactions that nothing else holds, and their transfers; one row."""
    gone = ledger.statement_rows.join(sheets.select(F.col("id").alias("statement_id")), "statement_id", "left_semi").select(F.col("id").alias("statement_row_id"))
    links = ledger.links.join(gone, "statement_row_id", "left_semi")
    kept = ledger.links.join(gone, "statement_row_id", "left_anti").select("transaction_id")
    alone = links.select("transaction_id").distinct().join(kept, "transaction_id", "left_anti")
    ends = ledger.transfer_links.select("id", F.explode(F.array("transaction_out_id", "transaction_in_id")).alias("transaction_id"))
    exceptions = ledger.exceptions.where("entity_type = 'transaction'").withColumnRenamed("entity_id", "transaction_id")
    parts = {
        "n_statements": sheets, "n_links": links, "n_tx": alone, "n_transfers": ends.join(alone, "transaction_id", "left_semi").select("id").distinct(),
        "n_exceptions": exceptions.join(alone, "transaction_id", "left_semi"),
    }
    out = gone.agg(F.count("*").alias("n_rows"))
    for name, part in parts.items():
        out = out.join(F.broadcast(part.agg(F.count("*").alias(name))))  # one row each
    return out


def sql_gone(where: str) -> str:
    return f"""sheets_ as (select * from {{sheets}} where {where}), gone as (select id from {{statement_rows}} where statement_id in (select id from sheets_)),
linked as (select * from {{links}} where statement_row_id in (select id from gone)), alone as (select distinct transaction_id as id from linked where transaction_id not in (select transaction_id from {{links}} where statement_row_id not in (select id from gone))),
counts as (select (select count(*) from gone) as n_rows, (select count(*) from sheets_) as n_statements, (select count(*) from linked) as n_links, (select count(*) from alone) as n_tx,
  (select count(*) from {{transfer_links}} where transaction_out_id in (select id from alone) or transaction_in_id in (select id from alone)) as n_transfers, (select count(*) from {{exceptions}} where entity_id in (select id from alone)) as n_exceptions)"""


@register("delete_file_counts", duck(f"with {sql_gone(chr(39) + 'f_1' + chr(39) + ' = file_id')} select *, (select count(*) = 0 from {{sheets}} where batch_id = 'b_1' and file_id <> 'f_1') as batch_goes from counts"))
def delete_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes with a file, and whether its batch goes as well."""
    ledger = Ledger(spark, sf_dir)
    others = ledger.sheets.where("batch_id = 'b_1' and file_id <> 'f_1'").agg((F.count("*") == 0).alias("batch_goes"))
    return gone_with(ledger, ledger.sheets.where("file_id = 'f_1'")).join(F.broadcast(others))  # one row


@register("delete_batch_counts", duck(f"with {sql_gone(chr(39) + 'b_1' + chr(39) + ' = batch_id')} select *, (select count(distinct file_id) from sheets_) as n_files from counts"))
def delete_batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of a batch at once: a transaction that only they hold is an orphan in whatever order they go."""
    ledger = Ledger(spark, sf_dir)
    own = ledger.sheets.where("batch_id = 'b_1'")
    return gone_with(ledger, own).join(F.broadcast(own.agg(F.countDistinct("file_id").alias("n_files"))))  # one row


SQL_KEPT_FIRST = "row_number() over (partition by provider, account_type, display, currency order by created_at, id)"


@register("resolve_accounts", duck(f"""with wanted as (select distinct provider, case when lower(trim(statement_type)) in ('card', 'payment', 'savings', 'deposit', 'wallet') then lower(trim(statement_type)) else 'unknown' end as account_type, account_display as display, 'RUB' as currency from {{statements}}),
known as (select provider, account_type, display, currency, id from {{accounts}} qualify {SQL_KEPT_FIRST} = 1)
select provider, account_type, display, coalesce(id, 'acct_' || substr(sha1(provider || '|' || account_type || '|' || display || '|' || currency), 1, 16)) as account_id, id is null as created from wanted left join known using (provider, account_type, display, currency)"""))  # fmt: skip
def resolve_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account of each identity: the one that was made first, or a new one with an id from what it is."""
    ledger = Ledger(spark, sf_dir)
    key = ["provider", "account_type", "display", "currency"]
    wanted = ledger.statements.select("provider", account_type(F.col("statement_type")).alias("account_type"), F.col("account_display").alias("display"), F.lit("RUB").alias("currency")).distinct()
    known = ledger.accounts.groupBy(*key).agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))
    made = F.concat(F.lit("acct_"), F.substring(F.sha1(F.concat_ws("|", *key)), 1, 16))
    return wanted.join(known, key, "left").select("provider", "account_type", "display", F.coalesce("id", made).alias("account_id"), F.col("id").isNull().alias("created"))


def account_type(statement_type: Column) -> Column:
    kind = F.lower(F.trim(F.coalesce(statement_type, F.lit(""))))
    return F.when(kind.isin("card", "payment", "savings", "deposit", "wallet"), kind).otherwise("unknown")


def masked(value: Column) -> Column:
    """The last four digits behind stars; nothing of what has no digits."""
    digits = F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9]", "")
    return F.when(digits == "", "").otherwise(F.concat(F.lit("****"), F.right(digits, F.lit(4))))


@register("mask_identifier", duck("select id, case when lower(trim(statement_type)) in ('card', 'payment', 'savings', 'deposit', 'wallet') then lower(trim(statement_type)) else 'unknown' end as account_type, '****' || right(regexp_replace(account_display, '[^0-9]', '', 'g'), 4) as masked from {statements}"))
def mask_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ledger(spark, sf_dir).statements.select("id", account_type(F.col("statement_type")).alias("account_type"), masked(F.col("account_display")).alias("masked"))


@register("rules_scope_order", duck("select id from {transactions} where meaning is null or meaning <> 'internal_transfer' order by operation_datetime desc nulls last, created_at desc, id limit 500"))
def rules_scope_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = Ledger(spark, sf_dir).transactions.where("meaning is null or meaning <> 'internal_transfer'")
    return tx.orderBy(F.desc_nulls_last("operation_datetime"), F.desc("created_at"), "id").limit(500).select("id")


@register("sheets_newest", duck("select file_id, count(*) as n, max(id) as newest from {sheets} group by 1 order by newest desc, file_id limit 200"))
def sheets_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = Ledger(spark, sf_dir).sheets.groupBy("file_id").agg(F.count("*").alias("n"), F.max("id").alias("newest"))
    return files.orderBy(F.desc("newest"), "file_id").limit(200)
