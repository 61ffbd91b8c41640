"""Registered queries of own transfers: hints, lanes, candidates, scores, ranks, links and meanings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import ledger_time, text
from ledgerloom.operators import transfers as T
from ledgerloom.operators.graph import components, written
from ledgerloom.plans.registry import register
from ledgerloom.sources.ledger import Ledger, duck

# DuckDB's \b knows only ASCII, so the hint is stated once more with what may stand around a word.
HINT = r"(?i)(^|[^\p{L}\p{N}_])(перевод|сбп|sbp|transfer|p2p)($|[^\p{L}\p{N}_])|между\s+своими|собственн(ых|ые)\s+средств|between\s+accounts"
listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
STOP = listed(T.STOPWORDS)
SQL_AT = "coalesce(operation_datetime, posting_datetime, created_at)"
SQL_TOKENS = "list_filter(list_distinct(regexp_extract_all(lower({}), '[0-9a-zа-я]{{3,}}')), lambda w: not list_contains(" + STOP + ", w))"

SQL_CONFIRMED = f"""ends as (select id, account_id, {SQL_AT} as at, trim(coalesce(description_raw, '') || ' ' || coalesce(bank_category, '')) as t from {{transactions}}),
confirmed as (
  select o.account_id as oa, i.account_id as ia, abs(epoch_us(i.at) - epoch_us(o.at)) / 1000000.0::double as delay, o.t as out_text, i.t as in_text
  from {{transfer_links}} l join ends o on o.id = l.transaction_out_id join ends i on i.id = l.transaction_in_id where l.status = 'confirmed'),
delays as (select oa, ia, count(*) as n, list_sort(list(delay))[floor((count(*) - 1) * 0.9::double)::int + 1]::double as delay from confirmed group by all)"""


def sql_patterns(side: str) -> str:
    return f"""{side}_words as (
  select oa, ia, w, count(*) as n from (select oa, ia, unnest(regexp_extract_all(lower({side}_text), '[0-9a-zа-я]{{{{3,}}}}')) as w from confirmed)
  where not list_contains({listed(T.LANE_STOPWORDS)}, w) group by all),
{side}_ranked as (select *, row_number() over (partition by oa, ia order by n desc, w) as place, max(n) over (partition by oa, ia) as most from {side}_words),
{side}_kept as (select * from {side}_ranked where (n >= 2 and place <= 8) or (most < 2 and place <= 3))"""


SQL_LANES = f"""{SQL_CONFIRMED}, {sql_patterns('out').replace('{{', '{').replace('}}', '}')}, {sql_patterns('in').replace('{{', '{').replace('}}', '}')},
out_lists as (select oa, ia, list(w) as out_patterns from out_kept group by all), in_lists as (select oa, ia, list(w) as in_patterns from in_kept group by all),
lanes as (
  select oa, ia, n as lane_n, greatest(1800.0::double, delay) as lane_s, greatest(172800.0::double, least(greatest(1800.0::double, delay) * 1.8::double + 21600.0::double, 432000.0::double)) as window_s,
    coalesce(out_patterns, []) as out_patterns, coalesce(in_patterns, []) as in_patterns
  from delays left join out_lists using (oa, ia) left join in_lists using (oa, ia))"""

SQL_PAIRS = f"""{SQL_LANES}, sides as (
  select id, account_id, currency, direction, {SQL_AT} as at, (amount * 100)::bigint as cents, lower(trim(coalesce(bank_reference_id, ''))) as ref,
    regexp_matches(coalesce(description_raw, '') || ' ' || coalesce(bank_category, ''), '{HINT}') as hint, regexp_matches(coalesce(description_raw, ''), '(?i)vklad[\\s\\-]?karta|karta[\\s\\-]?vklad') as lane,
    {SQL_TOKENS.format("coalesce(description_raw, '')")} as tokens, {SQL_TOKENS.format("coalesce(description_raw, '') || ' ' || coalesce(bank_category, '')")} as words
  from {{transactions}} where id not in (select unnest([transaction_out_id, transaction_in_id]) from {{transfer_links}})),
pairs as (
  select o.id as out_id, i.id as in_id, o.account_id as out_account, i.account_id as in_account, abs(epoch_us(i.at) - epoch_us(o.at)) / 1000000.0::double as delta_s,
    abs(o.cents - i.cents) as delta_cents, least(1000, greatest(1, greatest(o.cents, i.cents) // 200)) as allowed, o.hint as out_hint, i.hint as in_hint, o.lane as out_lane, i.lane as in_lane,
    o.at::date = i.at::date as same_day, o.hint::int + i.hint::int as hints, (o.ref <> '' and o.ref = i.ref)::int as ref_match, len(list_intersect(o.tokens, i.tokens)) as overlap, (i.at >= o.at)::int as forward,
    coalesce(lane_n, 0) as lane_n, coalesce(lane_s, 0) as lane_s, coalesce(window_s, 172800.0::double) as window_s,
    len(list_intersect(o.words, coalesce(out_patterns, []))) as out_hits, len(list_intersect(i.words, coalesce(in_patterns, []))) as in_hits
  from sides o join sides i on o.direction = 'out' and i.direction = 'in' and o.account_id <> i.account_id and o.currency = i.currency
    and epoch_us(i.at) - epoch_us(o.at) between -432000000000 and 432000000000 and abs(o.cents - i.cents) <= least(1000, greatest(1, greatest(o.cents, i.cents) // 200))
  left join lanes on lanes.oa = o.account_id and lanes.ia = i.account_id
  where abs(epoch_us(i.at) - epoch_us(o.at)) / 1000000.0::double <= coalesce(window_s, 172800.0::double)),
based as (
  select *, least(0.99::double, 0.20::double + greatest(0.7::double, least(1.0::double, 1.0::double - delta_cents::double / allowed::double)) * 0.35::double
    + case when delta_s <= 300 then 0.25::double when delta_s <= 1800 then 0.18::double when delta_s <= 7200 then 0.12::double when delta_s <= 86400 then 0.05::double else 0.02::double end
    + case when out_hint then 0.1::double else 0 end + case when in_hint then 0.1::double else 0 end + case when same_day then 0.04::double else 0 end) as base,
    case when lane_n > 0 then least(0.12::double, least(0.06::double, lane_n * 0.008::double) + case when out_hits > 0 then least(0.03::double, 0.015::double * out_hits) else 0 end
      + case when in_hits > 0 then least(0.03::double, 0.015::double * in_hits) else 0 end + case when delta_s <= lane_s then 0.03::double else 0 end) else 0 end as bonus from pairs),
scored as (select *, least(0.99::double, base + bonus) as score from based),
able as (
  select * from scored where score >= 0.8::double or (score >= 0.74::double and delta_cents = 0 and delta_s <= 86400 and out_hint <> in_hint and case when out_hint then in_lane else out_lane end)),
counts as (
  select out_account, in_account, coalesce(n_pairs, 0) as n_pairs, coalesce(n_forward, 0) as n_forward
  from (select out_account, in_account, count(*) as n_pairs from scored where score >= 0.74::double group by all)
  full join (select out_account, in_account, count(*) as n_forward from able where forward = 1 group by all) using (out_account, in_account)),
ranked as (select able.*, coalesce(n_forward, 0) as n_forward from able left join counts using (out_account, in_account))"""
SQL_RANK = "score desc, hints desc, ref_match desc, overlap desc, forward desc, n_forward desc, lane_n desc, delta_s, delta_cents, out_id, in_id"
#: In whole thousandths: what doubles differ by in their last digits doesn't show.
SQL_M = "floor({} * 1000 + 0.000001::double)::bigint"


def thousandths(name: str = "score") -> Column:
    return F.floor(F.col(name) * 1000 + 0.000001).alias(f"{name}_m")


def confirmed(ledger: Ledger) -> DataFrame:
    """Confirmed links with the accounts, texts and delay of their two sides."""
    links = ledger.transfer_links.where("status = 'confirmed'")
    held = links.select(F.explode(F.array("transaction_out_id", "transaction_in_id")).alias("id"))
    # All transactions are shuffled once; the two joins see those that a link holds.
    ends = written(ledger.transactions.select("id", "account_id", F.unix_micros(ledger_time().cast("timestamp")).alias("us"), T.hint_text().alias("text")).join(held, "id", "left_semi"), "ends")
    end = lambda side: ends.select(F.col("id").alias(f"transaction_{side}_id"), *[F.col(c).alias(f"{side}_{n}") for c, n in (("account_id", "account"), ("us", "us"), ("text", "text"))])
    both = links.join(end("out"), "transaction_out_id").join(end("in"), "transaction_in_id")
    return both.withColumn("delay", F.abs(F.col("in_us") - F.col("out_us")) / 1_000_000)


def unlinked(ledger: Ledger) -> DataFrame:
    """Transactions that no link holds, whatever its status."""
    ids = ledger.transfer_links.select(F.explode(F.array("transaction_out_id", "transaction_in_id")).alias("id"))
    return ledger.transactions.join(ids, "id", "left_anti")


def candidates(ledger: Ledger) -> DataFrame:
    return T.candidates(unlinked(ledger), written(T.lane_priors(confirmed(ledger)), "lanes"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.scored(candidates(Ledger(spark, sf_dir)))


def likely(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, as a condition that names the score more than once would have it computed so often within the join."""
    return written(T.likely(scored(spark, sf_dir)), "pairs")


@register("transfer_hints", duck(f"with {SQL_PAIRS.split('pairs as (')[0].rstrip().rstrip(',')} select direction, hint, count(*) as n_tx from sides group by all"))
def transfer_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unlinked(Ledger(spark, sf_dir)).groupBy("direction", T.hint_text().rlike(T.HINT).alias("hint")).agg(F.count("*").alias("n_tx"))


@register("lane_delay_p90", duck(f"with {SQL_CONFIRMED} select oa as out_account, ia as in_account, delay from delays"))
def lane_delay_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.lane_delays(confirmed(Ledger(spark, sf_dir))).select("out_account", "in_account", "delay")


@register("lane_patterns", duck(f"with {SQL_LANES} select oa as out_account, ia as in_account, 'out' as side, w as token, n from out_kept union all select oa, ia, 'in', w, n from in_kept"))
def lane_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = confirmed(Ledger(spark, sf_dir))
    side = lambda name: T.lane_patterns(links, name).select("out_account", "in_account", F.lit(name).alias("side"), "token", "n")
    return side("out").unionByName(side("in"))


@register("lane_priors", duck(f"with {SQL_LANES} select oa as out_account, ia as in_account, lane_n, lane_s, window_s, array_to_string(list_sort(out_patterns), ',') as out_patterns, array_to_string(list_sort(in_patterns), ',') as in_patterns from lanes"))
def lane_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often an account pays another, how long that takes (half an hour at least), the window it opens, and its words."""
    words = lambda c: F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), ",").alias(c)
    return T.lane_priors(confirmed(Ledger(spark, sf_dir))).select("out_account", "in_account", "lane_n", "lane_s", "window_s", words("out_patterns"), words("in_patterns"))


@register("transfer_candidates", duck(f"with {SQL_PAIRS} select out_id, in_id, delta_s, delta_cents, allowed, window_s from pairs"))
def transfer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(Ledger(spark, sf_dir)).select("out_id", "in_id", "delta_s", "delta_cents", "allowed", "window_s")


@register("transfer_scores", duck(f"with {SQL_PAIRS} select out_id, in_id, {SQL_M.format('base')} as base_m, hints, ref_match, overlap, forward from scored"))
def transfer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("out_id", "in_id", thousandths("base"), "hints", "ref_match", "overlap", "forward")


@register("transfer_scores_lane", duck(f"with {SQL_PAIRS} select out_id, in_id, lane_n, out_hits, in_hits, {SQL_M.format('bonus')} as bonus_m, {SQL_M.format('score')} as score_m from scored"))
def transfer_scores_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("out_id", "in_id", "lane_n", "out_hits", "in_hits", thousandths("bonus"), thousandths("score"))


@register("viable_pairs", duck(f"with {SQL_PAIRS} select out_id, in_id, {SQL_M.format('score')} as score_m from able"))
def viable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.viable(likely(spark, sf_dir)).select("out_id", "in_id", thousandths())


@register("counterparty_overlap", duck(f"with {SQL_PAIRS} select overlap, count(*) as n_pairs from pairs group by 1"))
def counterparty_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("overlap").agg(F.count("*").alias("n_pairs"))


@register("pair_lane_counts", duck(f"with {SQL_PAIRS} select out_account, in_account, n_pairs, n_forward from counts"))
def pair_lane_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.lane_counts(scored(spark, sf_dir))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viable pairs with their place among those of the outflow and of the inflow."""
    pairs = likely(spark, sf_dir)
    counts = T.lane_counts(pairs)
    first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(*T.rank_order()))
    edges = T.viable(pairs).join(counts, ["out_account", "in_account"], "left").na.fill(0, ["n_pairs", "n_forward"])
    return edges.withColumns({"of_out": first("out_id"), "of_in": first("in_id")})


SQL_PLACES = f"row_number() over (partition by out_id order by {SQL_RANK}) as of_out, row_number() over (partition by in_id order by {SQL_RANK}) as of_in"


@register("pair_rank", duck(f"with {SQL_PAIRS} select out_id, in_id, n_forward, {SQL_PLACES} from ranked"))
def pair_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).select("out_id", "in_id", "n_forward", "of_out", "of_in")


@register("mutual_best", duck(f"with {SQL_PAIRS} select out_id, in_id, score_m from (select out_id, in_id, {SQL_M.format('score')} as score_m, {SQL_PLACES} from ranked) where of_out = 1 and of_in = 1"))
def mutual_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that are each other's best."""
    return ranked(spark, sf_dir).where("of_out = 1 and of_in = 1").select("out_id", "in_id", thousandths())


@register("transfer_components", duck(f"""with recursive {SQL_PAIRS}, edges as (select out_id as a, in_id as b from able union select in_id, out_id from able),
reached(node, r) as (select a, a from edges union select node, b from reached join edges on a = r) select node, min(r) as label from reached group by 1"""))  # fmt: skip
def transfer_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(T.viable(likely(spark, sf_dir)).select(F.col("out_id").alias("a"), F.col("in_id").alias("b")))


@register("transfer_assign")
def transfer_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links that detection makes: no SQL says a matching; tests hold it against trying all and against a plain loop."""
    return T.links(scored(spark, sf_dir)).select("out_id", "in_id", "status", thousandths(), "fee", "rationale")


LINKED = "select unnest([transaction_out_id, transaction_in_id]) from {transfer_links}"


@register("mark_internal", duck(f"select id, 'internal_transfer' as meaning from {{transactions}} where id in ({LINKED} where status in ('auto', 'confirmed'))"))
def mark_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger(spark, sf_dir)
    return ledger.transactions.join(ends_of(ledger, "auto", "confirmed"), "id", "left_semi").select("id", F.lit("internal_transfer").alias("meaning"))


def ends_of(ledger: Ledger, *status: str) -> DataFrame:
    links = ledger.transfer_links.where(F.col("status").isin(*status)) if status else ledger.transfer_links
    return links.select(F.explode(F.array("transaction_out_id", "transaction_in_id")).alias("id")).distinct()


@register("set_except_linked", duck(f"select id from {{transactions}} where id not in ({LINKED})"))
def set_except_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unlinked(Ledger(spark, sf_dir)).select("id")


@register("set_union_ids", duck("select transaction_out_id as id from {transfer_links} union select transaction_in_id from {transfer_links}"))
def set_union_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ends_of(Ledger(spark, sf_dir))


@register("reset_internal", duck(f"select id, case when id in ({LINKED}) and meaning = 'internal_transfer' then 'unknown' else meaning end as meaning from {{transactions}}"))
def reset_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meanings before all links are found anew: linked transactions that were internal become unknown."""
    ledger = Ledger(spark, sf_dir)
    told = ledger.transactions.join(ends_of(ledger).withColumn("linked", F.lit(True)), "id", "left")
    return told.select("id", F.when(F.col("linked") & (F.col("meaning") == "internal_transfer"), "unknown").otherwise(F.col("meaning")).alias("meaning"))


@register("confirm_links", duck(f"""select id, 'internal_transfer' as meaning from {{transactions}} where id in ({LINKED} where status = 'suggested') and coalesce(meaning, '') <> 'internal_transfer'"""))
def confirm_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions that change when all suggested links are confirmed."""
    ledger = Ledger(spark, sf_dir)
    told = ledger.transactions.join(ends_of(ledger, "suggested"), "id", "left_semi")
    return told.where(text("meaning") != "internal_transfer").select("id", F.lit("internal_transfer").alias("meaning"))


@register("reject_links", duck(f"""select id, 'unknown' as meaning from {{transactions}} where id in ({LINKED} where status in ('auto', 'suggested')) and meaning = 'internal_transfer'"""))
def reject_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions that change when all open links are rejected."""
    ledger = Ledger(spark, sf_dir)
    told = ledger.transactions.join(ends_of(ledger, "auto", "suggested"), "id", "left_semi")
    return told.where(F.col("meaning") == "internal_transfer").select("id", F.lit("unknown").alias("meaning"))
