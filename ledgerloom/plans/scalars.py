"""The scalar functions that the ledger's rules are made of, by kind, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.columns import event_time, iso, ledger_time, squeezed, text
from ledgerloom.plans.registry import register
from ledgerloom.sources.ledger import Ledger, duck


@register("fn_string", duck(r"""select id, lower(description_raw) as lowered, trim(regexp_replace(lower(description_raw), '\s+', ' ', 'g')) as squeezed,
  upper(left(description_raw, 1)) || substr(description_raw, 2) as capital, nullif(trim(coalesce(merchant_normalized, '')), '') as merchant,
  array_to_string(regexp_extract_all(description_raw, '[0-9]+'), ' ') as numbers, len(string_split(description_raw, ' '))::int as n_words,
  split_part(bank_reference_id, '-', 2) as reference_part, starts_with(lower(description_raw), 'purchase') as bought, description_raw ilike '%TRANSFER%' as hinted,
  replace(account_id, 'acc_', '') as account_part, length(description_raw)::int as n_letters from {transactions}"""))  # fmt: skip
def fn_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.col("description_raw")
    return Ledger(spark, sf_dir).transactions.select(
        "id",
        F.lower(said).alias("lowered"),
        squeezed(said).alias("squeezed"),
        # Only the first letter: initcap would raise that of every word.
        F.concat(F.upper(F.left(said, F.lit(1))), F.substr(said, F.lit(2))).alias("capital"),
        F.nullif(F.trim(text("merchant_normalized")), F.lit("")).alias("merchant"),
        F.array_join(F.regexp_extract_all(said, F.lit("[0-9]+"), 0), " ").alias("numbers"),
        F.size(F.split(said, " ")).alias("n_words"),
        F.split_part("bank_reference_id", F.lit("-"), F.lit(2)).alias("reference_part"),
        F.lower(said).startswith("purchase").alias("bought"),
        said.ilike("%TRANSFER%").alias("hinted"),
        F.replace("account_id", F.lit("acc_"), F.lit("")).alias("account_part"),
        F.length(said).alias("n_letters"),
    )


@register("fn_date", duck("""select id, strftime(coalesce(operation_datetime, created_at), '%Y-%m') as period,
  strftime(date_trunc('week', coalesce(operation_datetime, created_at)), '%Y-%m-%d') as monday, strftime(date_trunc('day', created_at), '%Y-%m-%d') as day,
  coalesce(strftime(operation_datetime, '%Y-%m-%dT%H:%M:%S'), '') as iso, strftime(coalesce(operation_datetime, posting_datetime, created_at) + interval 3 day, '%Y-%m-%d') as later,
  operation_datetime::date = posting_datetime::date as same_day, floor(epoch(created_at - operation_datetime))::bigint as seconds, dayofweek(created_at)::int as weekday from {transactions}"""))  # fmt: skip
def fn_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda time: F.date_format(time, "yyyy-MM-dd")
    return Ledger(spark, sf_dir).transactions.select(
        "id",
        F.date_format(event_time(), "yyyy-MM").alias("period"),
        day(F.date_trunc("week", event_time())).alias("monday"),
        day(F.date_trunc("day", "created_at")).alias("day"),
        iso(F.col("operation_datetime")).alias("iso"),
        day(F.date_add(ledger_time().cast("date"), 3)).alias("later"),
        (F.to_date("operation_datetime") == F.to_date("posting_datetime")).alias("same_day"),
        F.timestamp_diff("SECOND", F.col("operation_datetime"), F.col("created_at")).alias("seconds"),
        (F.dayofweek("created_at") - 1).alias("weekday"),
    )


@register("fn_math", duck("""select id, abs(amount)::decimal(14,2) as size, (case when direction = 'out' then -abs(amount) else abs(amount) end)::decimal(14,2) as signed,
  floor(abs(amount))::bigint as whole, least(amount, 100)::decimal(14,2) as at_most, greatest(amount, 0)::decimal(14,2) as at_least, round(amount::double / 7, 4) as share,
  case when amount = 0 then null else round(100::double / amount::double, 4) end as inverse, try_cast(bank_reference_id as int) as number from {transactions}"""))  # fmt: skip
def fn_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount, narrow = F.col("amount"), "decimal(14,2)"
    size = F.abs(amount)
    return Ledger(spark, sf_dir).transactions.select(
        "id",
        size.cast(narrow).alias("size"),
        F.when(F.col("direction") == "out", -size).otherwise(size).cast(narrow).alias("signed"),
        F.floor(size).cast("bigint").alias("whole"),
        F.least(amount, F.lit(100).cast(narrow)).cast(narrow).alias("at_most"),
        F.greatest(amount, F.lit(0).cast(narrow)).cast(narrow).alias("at_least"),
        F.round(amount.cast("double") / 7, 4).alias("share"),
        F.round(F.try_divide(F.lit(100.0), amount.cast("double")), 4).alias("inverse"),
        F.col("bank_reference_id").try_cast("int").alias("number"),
    )


SQL_TAGS = "string_split(coalesce(tag_list, ''), ',')"


@register("fn_array", duck(f"""select id, len({SQL_TAGS})::int as n_tags, list_has_any({SQL_TAGS}, ['trip', 'work']) as overlaps, array_to_string(list_sort(list_intersect({SQL_TAGS}, ['home', 'trip'])), ',') as both_have,
  array_to_string(list_sort(list_distinct(list_concat({SQL_TAGS}, ['home', 'zoo']))), ',') as either_has, array_to_string({SQL_TAGS}[1:1], ',') as first_tag, list_contains({SQL_TAGS}, 'home') as at_home from {{transactions}}"""))  # fmt: skip
def fn_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.split(text("tag_list"), ",")
    given = lambda *names: F.array(*map(F.lit, names))
    return Ledger(spark, sf_dir).transactions.select(
        "id",
        F.size(tags).alias("n_tags"),
        F.arrays_overlap(tags, given("trip", "work")).alias("overlaps"),
        F.array_join(F.array_sort(F.array_intersect(tags, given("home", "trip"))), ",").alias("both_have"),
        F.array_join(F.array_sort(F.array_union(tags, given("home", "zoo"))), ",").alias("either_has"),
        F.array_join(F.slice(tags, 1, 1), ",").alias("first_tag"),
        F.array_contains(tags, "home").alias("at_home"),
    )


@register("fn_json", duck("""select id, coalesce(json_extract_string(payload, '$.k'), '') as k, json_object('id', id, 'status', status)::varchar as object,
  json_contains(json_array(exception_type, status), '"open"') as contains_open, json_extract_string(payload, '$.none') as absent from {exceptions}"""))  # fmt: skip
def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.to_json(F.array("exception_type", "status"))
    return Ledger(spark, sf_dir).exceptions.select(
        "id",
        F.coalesce(F.get_json_object("payload", "$.k"), F.lit("")).alias("k"),
        F.to_json(F.struct("id", "status")).alias("object"),
        F.array_contains(F.from_json(listed, "array<string>"), "open").alias("contains_open"),
        F.get_json_object("payload", "$.none").alias("absent"),
    )


@register("fn_hash", duck("""select id, sha256(description_raw) as sha256, left(sha1(id || '|' || account_id), 24) as sha1, md5(id) as md5 from {transactions}"""))
def fn_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ledger(spark, sf_dir).transactions.select(
        "id",
        F.sha2("description_raw", 256).alias("sha256"),
        F.left(F.sha1(F.concat_ws("|", "id", "account_id")), F.lit(24)).alias("sha1"),
        F.md5("id").alias("md5"),
    )


@register("month_range", duck("""select distinct strftime(coalesce(operation_datetime, created_at), '%Y-%m') as month, strftime(date_trunc('month', coalesce(operation_datetime, created_at)), '%Y-%m-%d') as first_day,
  strftime(last_day(coalesce(operation_datetime, created_at)), '%Y-%m-%d') as last_day from {transactions}"""))  # fmt: skip
def month_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months of the ledger with their first and last day."""
    day = event_time().cast("date")
    ends = [F.date_format(x, "yyyy-MM-dd").alias(n) for x, n in ((F.trunc(day, "month"), "first_day"), (F.last_day(day), "last_day"))]
    return Ledger(spark, sf_dir).transactions.select(F.date_format(event_time(), "yyyy-MM").alias("month"), *ends).distinct()
