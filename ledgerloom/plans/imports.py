"""Imported statement rows: candidates, keys, duplicates within a statement, overlaps with what is known, and merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import cents, iso, squeezed, text
from ledgerloom.operators.graph import written
from ledgerloom.plans.registry import register
from ledgerloom.sources.ledger import Ledger, duck

# Days and seconds of overlaps, and the least likeness of texts.
REVIEW_DAYS, REFERENCE_DAYS, MERCHANT_DAYS, SCOPE_DAYS = 2, 2, 1, 3
EXACT_S, DATE_ONLY_S = 3 * 3600, 36 * 3600
REVIEW_SIM, MERCHANT_SIM, PLAIN_SIM, LEAST_GAP = 0.5, 0.6, 0.9, 0.1
MOST_MATCHES = 5

SQL_ISO = "coalesce(strftime({}, '%Y-%m-%dT%H:%M:%S'), '')"
SQL_NORM = "lower(trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g')))"
SQL_FULL = "coalesce(nullif({}, ''), nullif({}, ''), '{}')"

SQL_ROWS = f"""rows_ as (
  select statement_row_id, statement_id, account_id, coalesce(tx_at, row_at) as op, coalesce(tx_posted, row_posted) as post, coalesce(nullif(tx_amount, 0), nullif(row_amount, 0), 0)::decimal(14,2) as amount,
    {SQL_FULL.format('tx_currency', 'row_currency', 'RUB')} as currency, {SQL_FULL.format('tx_direction', 'row_direction', 'out')} as direction, {SQL_FULL.format('tx_description', 'raw_text', '')} as description,
    coalesce(tx_merchant, '') as merchant, coalesce(tx_reference, '') as reference, coalesce(tx_category, '') as bank_category, coalesce(raw_text, '') as raw_text,
    {SQL_FULL.format('tx_precision', 'row_precision', 'unknown')} as precision, 'reviewed' as review_status from {{imports}})"""

SQL_PARTS = [
    "account_id", "currency", "direction", "amount::varchar", SQL_ISO.format("op"), SQL_ISO.format("post"),
    SQL_NORM.format("description"), SQL_NORM.format("bank_category"), SQL_NORM.format("raw_text"),
]
SQL_GROUP = ", ".join(SQL_PARTS)
SQL_REFS = f"""numbered as (
  select *, count(*) over (partition by statement_id, {SQL_GROUP}) as n, row_number() over (partition by statement_id, {SQL_GROUP} order by statement_row_id) as k from rows_ where trim(reference) = ''),
refs as (select statement_row_id, substr(sha1(concat_ws('|', 'stmtdup', statement_id, {SQL_GROUP}, k::varchar)), 1, 24) as ref from numbered where n > 1)"""
SQL_KEY = "sha256(concat_ws('|', 'v1', account_id, currency, direction, (amount * 100)::bigint::varchar, {}, {}, {}, {}, {}, {}))".format(
    SQL_ISO.format("op"), SQL_ISO.format("post"), *[SQL_NORM.format(c) for c in ("reference", "description", "bank_category", "raw_text")]
)
SQL_KEYED = f"""{SQL_ROWS}, {SQL_REFS},
referred as (select rows_.* replace (coalesce(ref, reference) as reference) from rows_ left join refs using (statement_row_id)),
keyed as (select *, {SQL_KEY} as key from referred),
known_keys as (select account_id, key, min(replace(statement_row_id, 'row_', 'tx_')) as tx_id from keyed where ends_with(statement_row_id, '3_a') group by all)"""


def full(*values: Column | str) -> Column:
    """The first that isn't null or empty."""
    return F.coalesce(*[F.nullif(v if isinstance(v, Column) else F.col(v), F.lit("")) for v in values[:-1]], F.lit(values[-1]))


def normalized(rows: DataFrame) -> DataFrame:
    """Candidates: what was parsed of a transaction, else what its row says, else a default; an amount of zero counts as none."""
    zero = F.lit(0).cast("decimal(14,2)")
    amount = F.coalesce(F.nullif("tx_amount", zero), F.nullif("row_amount", zero), zero)
    return rows.select(
        "statement_row_id", "statement_id", "account_id", F.coalesce("tx_at", "row_at").alias("op"), F.coalesce("tx_posted", "row_posted").alias("post"), amount.alias("amount"),
        full("tx_currency", "row_currency", "RUB").alias("currency"), full("tx_direction", "row_direction", "out").alias("direction"), full("tx_description", "raw_text", "").alias("description"),
        text("tx_merchant").alias("merchant"), text("tx_reference").alias("reference"), text("tx_category").alias("bank_category"), text("raw_text").alias("raw_text"),
        full("tx_precision", "row_precision", "unknown").alias("precision"), F.lit("reviewed").alias("review_status"),
    )


def group_parts() -> list[Column]:
    parts = [F.col("account_id"), F.col("currency"), F.col("direction"), F.col("amount").cast("string"), iso(F.col("op")), iso(F.col("post"))]
    return [*parts, *[squeezed(F.col(c)) for c in ("description", "bank_category", "raw_text")]]


def with_references(rows: DataFrame) -> DataFrame:
    """Equal rows of one statement without a reference get one by their place, so that they stay apart.

    Groups are found by counting digests; only rows of groups with more than one row are numbered.
    """
    digest = F.sha2(F.concat_ws("|", "statement_id", *group_parts()), 256)
    blank = rows.where(F.trim("reference") == "").select("statement_row_id", "statement_id", F.concat_ws("|", *group_parts()).alias("parts"), digest.alias("digest"))
    several = blank.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    place = F.row_number().over(Window.partitionBy("digest").orderBy("statement_row_id")).cast("string")
    ref = F.substring(F.sha1(F.concat_ws("|", F.lit("stmtdup"), "statement_id", "parts", place)), 1, 24)
    refs = blank.join(several, "digest", "left_semi").select("statement_row_id", ref.alias("ref"))
    return rows.join(refs, "statement_row_id", "left").withColumn("reference", F.coalesce("ref", "reference")).drop("ref")


def fingerprint() -> Column:
    """A digest of what makes a transaction; missing parts are empty."""
    parts = [F.lit("v1"), F.col("account_id"), full("currency", "RUB"), full("direction", "out"), cents(F.col("amount")).cast("string"), iso(F.col("op")), iso(F.col("post"))]
    return F.sha2(F.concat_ws("|", *parts, *[squeezed(F.col(c)) for c in ("reference", "description", "bank_category", "raw_text")]), 256)


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(normalized(Ledger(spark, sf_dir).imports), "normalized")
    return with_references(rows).withColumn("key", fingerprint())


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their keys, written once for the steps that read them again."""
    return written(keyed(spark, sf_dir), "candidates")


def known_keys(rows: DataFrame) -> DataFrame:
    """The keys that are stored already: here those of every tenth row."""
    own = rows.where(F.col("statement_row_id").endswith("3_a"))
    return own.groupBy("account_id", "key").agg(F.min(F.replace("statement_row_id", F.lit("row_"), F.lit("tx_"))).alias("tx_id"))


def deduped(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(statement_row_id, key, tx_id, verdict): a row of a known key is linked; of others the first makes a transaction.

    The first of a key is found by a partial minimum, so a key with many rows sends one from each task.
    """
    told = rows.join(known, ["account_id", "key"], "left")
    order = F.struct("statement_id", "statement_row_id")
    first = told.where("tx_id is null").groupBy("account_id", "key").agg(F.min(order)["statement_row_id"].alias("first"))
    verdict = F.when(F.col("tx_id").isNotNull(), "known").when(F.col("first") == F.col("statement_row_id"), "created").otherwise("linked")
    return told.join(first, ["account_id", "key"], "left").select("statement_row_id", "key", "tx_id", verdict.alias("verdict"))


@register("normalize_rows", duck(f"with {SQL_ROWS} select statement_row_id, account_id, op, post, amount, currency, direction, description, merchant, precision, review_status from rows_"))
def normalize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["statement_row_id", "account_id", "op", "post", "amount", "currency", "direction", "description", "merchant", "precision", "review_status"]
    return normalized(Ledger(spark, sf_dir).imports).select(columns)


@register("synthetic_refs", duck(f"with {SQL_KEYED} select statement_row_id, reference from keyed"))
def synthetic_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir).select("statement_row_id", "reference")


@register("fingerprint", duck(f"with {SQL_KEYED} select statement_row_id, key from keyed"))
def fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir).select("statement_row_id", "key")


SQL_DEDUPED = f"""{SQL_KEYED}, deduped as (
  select statement_row_id, key, tx_id, case when tx_id is not null then 'known' when row_number() over (partition by account_id, key order by statement_id, statement_row_id) = 1 then 'created' else 'linked' end as verdict
  from keyed left join known_keys using (account_id, key))"""


@register("exact_dedupe", duck(f"with {SQL_DEDUPED} select * from deduped"))
def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(spark, sf_dir)
    return deduped(rows, known_keys(rows))


SQL_SCOPE = f"""{SQL_ROWS}, periods as (select statement_id, account_id, min(op)::date::timestamp as a, max(op)::date::timestamp as z from rows_ group by all)
select statement_id, count(*) as n_tx from periods p join {{transactions}} t on t.account_id = p.account_id
  and (t.operation_datetime between a - interval {SCOPE_DAYS} day and z + interval {SCOPE_DAYS} day or t.posting_datetime between a - interval {SCOPE_DAYS} day and z + interval {SCOPE_DAYS} day) group by 1"""


@register("overlap_scope", duck(f"with {SQL_SCOPE}"))
def overlap_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many known transactions a statement may overlap: of its account, within its period and some days.

    Transactions are counted by account and day first, once by either of their days, so that no transaction
    meets every statement of its account.
    """
    ledger = Ledger(spark, sf_dir)
    day = lambda c: F.to_date(c)
    rows = normalized(ledger.imports).groupBy("statement_id", "account_id").agg(day(F.min("op")).alias("a"), day(F.max("op")).alias("z"))
    within = F.explode(F.sequence(F.date_sub("a", SCOPE_DAYS), F.date_add("z", SCOPE_DAYS))).alias("day")
    days = rows.select("statement_id", "account_id", within, F.date_add("z", SCOPE_DAYS).alias("end"), F.date_sub("a", SCOPE_DAYS).alias("begin"))
    midnight = lambda c: F.col(c) == F.date_trunc("day", c)
    tx = ledger.transactions.select("account_id", *[x for c, n in (("operation_datetime", "op"), ("posting_datetime", "post")) for x in (day(c).alias(n), midnight(c).alias(f"{n}_even"))])
    counts = tx.groupBy("account_id", "op", "op_even", "post", "post_even").agg(F.count("*").alias("n"))
    # The last day counts up to its first moment only, as the period ends there.
    inside = lambda n: F.coalesce((F.col(n) >= F.col("begin")) & ((F.col(n) < F.col("end")) | ((F.col(n) == F.col("end")) & F.col(f"{n}_even"))), F.lit(False))
    each = counts.withColumn("day", F.explode(F.array_distinct(F.array_compact(F.array("op", "post")))))
    met = days.join(each, ["account_id", "day"])
    once = F.when(inside("op"), F.col("op")).when(inside("post"), F.col("post"))
    return met.where(F.col("day") == once).groupBy("statement_id").agg(F.sum("n").cast("bigint").alias("n_tx"))


def words(*names: str) -> Column:
    """Distinct words of three letters and more that aren't numbers."""
    found = F.split(F.lower(F.concat_ws(" ", *names)), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\p{N}+$")))


def similarity(a: Column, b: Column) -> Column:
    """What two sets of words share, of the smaller; of both together where that has one word."""
    same, least = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    whole = F.size(F.array_union(a, b))
    return F.when(least == 0, 0.0).when(least < 2, same / whole).otherwise(same / least)


def plain_reference(name: str) -> Column:
    """Letters and digits of a reference; one that was made up for a repeated row counts as none."""
    low = F.lower(F.trim(text(name)))
    return F.when(low.rlike("^[0-9a-f]{24}$"), "").otherwise(F.regexp_replace(low, r"[^\p{L}\p{N}]", ""))


def overlap_side(rows: DataFrame, prefix: str, key: str, names: Sequence[str]) -> DataFrame:
    """A side of the overlap join: signature, days, reference, merchant, words and precision."""
    op, post, description, merchant, reference = names
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return rows.select(
        F.col(key).alias(f"{prefix}_id"), "account_id", F.abs(cents(F.col("amount"))).alias("cents"), full(F.trim("currency"), "RUB").alias("currency"), full(F.trim("direction"), "out").alias("direction"),
        F.array_compact(F.array(seconds(op), seconds(post))).alias(f"{prefix}_at"), plain_reference(reference).alias(f"{prefix}_ref"), squeezed(F.col(merchant)).alias(f"{prefix}_merchant"),
        words(description, merchant).alias(f"{prefix}_words"), full(F.trim("precision"), "unknown").alias(f"{prefix}_precision"),
    )


def overlap_pairs(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of a candidate and a known transaction of equal account, amount, currency and direction, at most two days apart.

    The join is on the day as well, of which a candidate takes its neighbours: a common amount doesn't pair
    everything of an account.
    """
    day = lambda at: F.floor(at / 86400)
    near = F.explode(F.array_distinct(F.flatten(F.transform("c_at", lambda t: F.transform(F.sequence(F.lit(-REVIEW_DAYS), F.lit(REVIEW_DAYS)), lambda k: day(t) + k)))))
    signature = ["account_id", "cents", "currency", "direction"]
    left = rows.withColumn("day", near)
    right = known.withColumn("day", F.explode(F.array_distinct(F.transform("e_at", day))))
    pairs = left.join(right, [*signature, "day"]).dropDuplicates(["c_id", "e_id"])
    apart = F.flatten(F.transform("c_at", lambda a: F.transform("e_at", lambda b: F.abs(a - b))))
    days = F.flatten(F.transform("c_at", lambda a: F.transform("e_at", lambda b: F.abs(day(a) - day(b)))))
    c, e = F.col("c_ref"), F.col("e_ref")
    partial = (F.length(c) >= 6) & (F.length(e) >= 6) & (c.contains(e) | e.contains(c))
    ref = F.when((c == "") | (e == ""), "none").when(c == e, "match").when(partial, "partial").otherwise("mismatch")
    merchant = (F.col("c_merchant") != "") & (F.col("c_merchant") == F.col("e_merchant"))
    out = pairs.withColumns({
        "days": F.array_min(days), "seconds": F.array_min(apart), "ref": ref, "merchant": merchant, "sim": similarity(F.col("c_words"), F.col("e_words")),
        "longest": F.when((F.col("c_precision") == "date_only") | (F.col("e_precision") == "date_only"), DATE_ONLY_S).otherwise(EXACT_S),
    })
    by_ref = F.col("ref") == "match"
    score = F.when(by_ref, 1.0 - F.least("days", F.lit(REFERENCE_DAYS)) * 0.05).when(F.col("merchant") & (F.col("sim") > 0), F.least(F.lit(1.0), F.col("sim") + 0.05)).otherwise(F.col("sim"))
    review = F.col("ref").isin("match", "partial") | (F.col("sim") >= REVIEW_SIM)
    in_time = F.col("seconds") <= F.col("longest")
    named = F.col("merchant") & (F.col("days") <= MERCHANT_DAYS) & (F.col("ref") != "mismatch")
    plain = (F.col("days") == 0) & in_time & (F.col("sim") >= PLAIN_SIM) & (F.col("ref") != "mismatch")
    auto = F.when(by_ref & (F.col("days") <= REFERENCE_DAYS), True).when(named, (F.col("sim") >= MERCHANT_SIM) & ((F.col("days") > 0) | in_time)).otherwise(plain)
    return out.withColumns({"score": score, "review": review & (F.col("days") <= REVIEW_DAYS), "auto": auto})


def overlap_plan(pairs: DataFrame) -> DataFrame:
    """(c_id, verdict, tx_id, matches): the known transaction that is clearly the best, or the five to look at."""
    place = lambda flag: F.row_number().over(Window.partitionBy("c_id", flag).orderBy(F.desc("score"), "e_id"))
    placed = pairs.where("auto or review").withColumns({"auto_place": place("auto"), "review_place": place("review")})
    best = lambda k, c: F.max(F.when(F.col("auto") & (F.col("auto_place") == k), F.col(c)))
    match = F.when(F.col("review") & (F.col("review_place") <= MOST_MATCHES), F.struct("review_place", F.concat_ws(":", "e_id", F.format_string("%.4f", F.round("score", 4))).alias("said")))
    plan = placed.groupBy("c_id").agg(best(1, "score").alias("first"), best(1, "e_id").alias("tx_id"), best(2, "score").alias("second"), F.array_sort(F.collect_list(match)).alias("found"))
    sure = F.coalesce(F.col("first") - F.coalesce("second", F.lit(0.0)) >= LEAST_GAP, F.lit(False))
    verdict = F.when(sure, "auto").when(F.size("found") > 0, "needs_review")
    told = plan.select("c_id", verdict.alias("verdict"), F.when(sure, F.col("tx_id")).alias("tx_id"), F.when(~sure, F.array_join(F.transform("found", lambda m: m["said"]), ",")).alias("matches"))
    return told.where("verdict is not null")


def overlaps(ledger: Ledger, rows: DataFrame) -> DataFrame:
    """The plan for the candidates whose key isn't known."""
    fresh = rows.join(known_keys(rows), ["account_id", "key"], "left_anti")
    known = ledger.transactions.withColumnRenamed("timestamp_precision", "precision")
    left = overlap_side(fresh, "c", "statement_row_id", ("op", "post", "description", "merchant", "reference"))
    right = overlap_side(known, "e", "id", ("operation_datetime", "posting_datetime", "description_raw", "merchant_normalized", "bank_reference_id"))
    return overlap_plan(overlap_pairs(left, right))


SQL_WORDS = "list_distinct(list_filter(string_split_regex(lower({} || ' ' || {}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3 and not regexp_full_match(w, '[0-9]+')))"
SQL_REF = "case when regexp_full_match(lower(trim({0})), '[0-9a-f]{{24}}') then '' else regexp_replace(lower(trim({0})), '[^\\p{{L}}\\p{{N}}]', '', 'g') end"
SQL_PLAN = f"""{SQL_DEDUPED},
c as (select statement_row_id as c_id, account_id, abs((amount * 100)::bigint) as cents, currency, direction, list_filter([date_trunc('second', op), date_trunc('second', post)], lambda x: x is not null) as at_,
  {SQL_REF.format('reference')} as ref, {SQL_NORM.format('merchant')} as merchant, {SQL_WORDS.format('description', 'merchant')} as w, precision from keyed anti join known_keys using (account_id, key)),
e as (select id as e_id, account_id, abs((amount * 100)::bigint) as cents, currency, direction, list_filter([date_trunc('second', operation_datetime), date_trunc('second', posting_datetime)], lambda x: x is not null) as at_,
  {SQL_REF.format('bank_reference_id')} as ref, {SQL_NORM.format('merchant_normalized')} as merchant, {SQL_WORDS.format('description_raw', 'merchant_normalized')} as w, timestamp_precision as precision from {{transactions}}),
anchors as (select c_id, e_id, min(abs(date_diff('day', a::date, b::date))) as days, min(abs(epoch(a) - epoch(b))) as seconds
  from (select c_id, account_id, cents, currency, direction, unnest(at_) as a from c) join (select e_id, account_id, cents, currency, direction, unnest(at_) as b from e) using (account_id, cents, currency, direction) group by all),
p as (
  select c_id, e_id, days, seconds, case when c.precision = 'date_only' or e.precision = 'date_only' then {DATE_ONLY_S} else {EXACT_S} end as longest,
    case when c.ref = '' or e.ref = '' then 'none' when c.ref = e.ref then 'match' when length(c.ref) >= 6 and length(e.ref) >= 6 and (contains(c.ref, e.ref) or contains(e.ref, c.ref)) then 'partial' else 'mismatch' end as ref,
    c.merchant <> '' and c.merchant = e.merchant as named,
    case when least(len(c.w), len(e.w)) = 0 then 0 when least(len(c.w), len(e.w)) < 2 then len(list_intersect(c.w, e.w))::double / len(list_distinct(list_concat(c.w, e.w))) else len(list_intersect(c.w, e.w))::double / least(len(c.w), len(e.w)) end as sim
  from anchors join c using (c_id) join e using (e_id)),
s as (
  select *, case when ref = 'match' then 1.0::double - least(days, 2) * 0.05::double when named and sim > 0 then least(1.0::double, sim + 0.05::double) else sim end as score,
    days <= 2 and (ref in ('match', 'partial') or sim >= 0.5) as review,
    case when ref = 'match' and days <= 2 then true when named and days <= 1 and ref <> 'mismatch' then sim >= 0.6::double and (days > 0 or seconds <= longest)
      else days = 0 and seconds <= longest and sim >= 0.9::double and ref <> 'mismatch' end as auto from p),
autos as (select c_id, e_id, score - coalesce(lead(score) over w, 0) as gap, row_number() over w as k from s where auto window w as (partition by c_id order by score desc, e_id)),
sure as (select c_id, e_id as tx_id from autos where k = 1 and gap >= 0.1::double),
looks as (select c_id, string_agg(e_id || ':' || printf('%.4f', round(score, 4)), ',' order by k) as matches from (select *, row_number() over (partition by c_id order by score desc, e_id) as k from s where review) where k <= 5 group by 1),
plan as (select c_id, 'auto' as verdict, tx_id, null::varchar as matches from sure union all select c_id, 'needs_review', null, matches from looks where c_id not in (select c_id from sure))"""


@register("fuzzy_overlap", duck(f"with {SQL_PLAN} select c_id, verdict, tx_id, matches from plan"))
def fuzzy_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(Ledger(spark, sf_dir), stored(spark, sf_dir))


@register("ingest_pipeline", duck(f"""with {SQL_PLAN} select count(*) as n_rows, count(*) filter (where d.verdict = 'known') as n_known, count(*) filter (where plan.verdict = 'auto') as n_overlaps,
  count(*) filter (where d.verdict = 'created' and coalesce(plan.verdict, '') <> 'auto') as n_created, count(*) filter (where d.verdict = 'created' and plan.verdict = 'needs_review') as n_exceptions
  from deduped d left join plan on plan.c_id = d.statement_row_id"""))  # fmt: skip
def ingest_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import does: rows of known keys and clear overlaps are linked, others make transactions, unclear ones an exception."""
    rows = stored(spark, sf_dir)
    plan = overlaps(Ledger(spark, sf_dir), rows).select(F.col("c_id").alias("statement_row_id"), F.col("verdict").alias("overlap"))
    told = deduped(rows, known_keys(rows)).join(plan, "statement_row_id", "left")
    overlap = F.coalesce("overlap", F.lit(""))
    made = (F.col("verdict") == "created") & (overlap != "auto")
    return told.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("verdict") == "known").alias("n_known"), F.count_if(overlap == "auto").alias("n_overlaps"),
        F.count_if(made).alias("n_created"), F.count_if(made & (overlap == "needs_review")).alias("n_exceptions"),
    )


SQL_MOVED = f"""{SQL_ROWS}, moved as (select *, 'acc_' || ((right(account_id, 1))::int + 1) as target from rows_)
select statement_row_id, {SQL_KEY.replace("account_id", "target").replace(SQL_NORM.format("raw_text"), SQL_NORM.format("coalesce(nullif(raw_text, ''), description)"))} as key from moved"""


@register("rekey", duck(f"with {SQL_MOVED}"))
def rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of transactions that move to another account: by its row's text, or else by the description."""
    rows = normalized(Ledger(spark, sf_dir).imports)
    target = F.concat(F.lit("acc_"), (F.right("account_id", F.lit(1)).cast("int") + 1).cast("string"))
    moved = rows.withColumns({"account_id": target, "raw_text": F.coalesce(F.nullif("raw_text", F.lit("")), "description")})
    return moved.select("statement_row_id", fingerprint().alias("key"))


SQL_SPLIT = f"""{SQL_KEYED}, numbered_ as (
  select statement_row_id, statement_id, row_number() over (partition by statement_id, {SQL_GROUP} order by statement_row_id) as k, count(*) over (partition by statement_id, {SQL_GROUP}) as n from rows_ where trim(reference) = '')
select statement_row_id, case when k = 1 then 'stays' else 'splits' end as action, case when k > 1 then ref else '' end as reference from numbered_ join refs using (statement_row_id) where n > 1"""


@register("split_plan", duck(f"with {SQL_SPLIT}"))
def split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one statement that fell into one transaction: the first keeps it, the others get references of their own."""
    rows = with_references(written(normalized(Ledger(spark, sf_dir).imports), "normalized"))
    made = rows.where(F.col("reference").rlike("^[0-9a-f]{24}$"))
    digest = F.sha2(F.concat_ws("|", "statement_id", *group_parts()), 256)
    first = made.withColumn("digest", digest)
    first = first.join(first.groupBy("digest").agg(F.min("statement_row_id").alias("first")), "digest")
    stays = F.col("statement_row_id") == F.col("first")
    return first.select("statement_row_id", F.when(stays, "stays").otherwise("splits").alias("action"), F.when(stays, "").otherwise(F.col("reference")).alias("reference"))


@register("apply_split", duck(f"""with {SQL_SPLIT.replace('select statement_row_id, case', 'select * from (select statement_row_id, case')})
select action, count(*) as n, count(distinct reference) as n_references from split_ group by 1""".replace("select * from (select statement_row_id, case", ", split_ as (select statement_row_id, case")))
def apply_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many links stay and how many are repointed to clones."""
    return split_plan(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"), F.countDistinct("reference").alias("n_references"))


SQL_TARGETS = """targets as (select * from {transactions} where account_id = 'acc_1' union all
  select * replace ('m' || id as id, 'acc_1' as account_id, created_at + interval 1 day as created_at) from {transactions} where account_id = 'acc_2' and (id like '%3' or id like '%4')
  union all select * replace ('n' || id as id, 'acc_1' as account_id) from {transactions} where account_id = 'acc_2' and id like '%4')"""


@register("match_tx", duck(f"""with {SQL_TARGETS} select s.id as source_id, arg_min(t.id, (t.created_at, t.id)) as target_id from {{transactions}} s join targets t
  on s.account_id = 'acc_2' and s.amount = t.amount and s.currency = t.currency and s.direction = t.direction and s.description_raw = t.description_raw and s.bank_reference_id = t.bank_reference_id
  and s.bank_category = t.bank_category and s.operation_datetime is not distinct from t.operation_datetime and s.posting_datetime is not distinct from t.posting_datetime group by 1"""))  # fmt: skip
def match_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For transactions of an account that is merged into another their equals there: of several the one that was made first."""
    tx = Ledger(spark, sf_dir).transactions
    into = lambda df, mark: df.withColumns({"id": F.concat(F.lit(mark), "id"), "account_id": F.lit("acc_1")})
    own = tx.where("account_id = 'acc_2'")
    later = into(own.where("id like '%3' or id like '%4'"), "m").withColumn("created_at", F.expr("created_at + interval 1 day"))
    targets = tx.where("account_id = 'acc_1'").unionByName(later).unionByName(into(own.where("id like '%4'"), "n"))
    return matched(own, targets)


def matched(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Equals among the targets are reduced to the first before the join; times may be unknown on both sides."""
    same, times = ["amount", "currency", "direction", "description_raw", "bank_reference_id", "bank_category"], ["operation_datetime", "posting_datetime"]
    known = lambda t: F.coalesce(F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("")).alias(f"{t}_key")
    keys = [*same, *[f"{t}_key" for t in times]]
    first = targets.select("id", "created_at", *same, *map(known, times)).groupBy(*keys).agg(F.min(F.struct("created_at", "id"))["id"].alias("target_id"))
    return sources.select(F.col("id").alias("source_id"), *same, *map(known, times)).join(first, keys).select("source_id", "target_id")
