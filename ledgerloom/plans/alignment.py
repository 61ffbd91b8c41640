"""Demotions and promotions that bring the counts of transfer-like rows by key to given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.alignment import Alignment, align
from ledgerloom.plans.audit import SQL_HIGH, high_confidence_row
from ledgerloom.plans.registry import register
from ledgerloom.sources.ledger import Ledger, duck

#: Rows of transactions by file, direction and page: a transaction that two files tell of is under two keys.
SQL_ROWS = """select lower(regexp_replace(s.pdf_path, '^.*/', '')) || '|' || t.direction || '|' || cast(r.page_number as string) as key, t.*, r.row_index
from {transactions} t join {links} l on l.transaction_id = t.id join {statement_rows} r on r.id = l.statement_row_id join {sheets} s on s.id = r.statement_id"""
#: Given counts: a few keys have more than there are rows, some of the others more than are high, some fewer.
SQL_GIVEN = "select key, case when key like '%in|3' then n + 100000 else case cast(ascii(substr(key, 5, 1)) as int) % 3 when 0 then n + cast(floor(n / 3) as bigint) + 9 when 1 then cast(floor(n / 2) as bigint) else n end end as n"


def aligned(spark: SparkSession, sf_dir: str) -> Alignment:
    ledger = Ledger(spark, sf_dir)
    rows = ledger.sql(SQL_ROWS).withColumns({"high": high_confidence_row(), "said": F.col("meaning")})
    rows = rows.withColumn("meaning", F.lit("unknown")).withColumn("stays", high_confidence_row()).withColumn("meaning", F.col("said"))
    rows = rows.select("key", "id", "high", "meaning", "bank_category", "bank_reference_id", "stays")
    counts = rows.groupBy("key").agg(F.count_if("high").alias("n"))
    return align(rows, spark.sql(f"{SQL_GIVEN} from {{counts}}", counts=counts))


#: Keys are folded in order, each with its candidates in order; what was taken before is a list.
SQL_ALIGNED = f"""rows_ as ({SQL_ROWS}), marked as (select *, {SQL_HIGH} as high, trim(lower(coalesce(bank_category, ''))) = 'transfer' and trim(coalesce(bank_reference_id, '')) <> '' as bare from rows_),
judged as (select key, id, said as meaning, high, bare, {SQL_HIGH} as stays from (select * replace ('unknown' as meaning), meaning as said from marked)),
counts as (select key, count(*) filter (where high) as n from judged group by key), given as ({SQL_GIVEN} from counts),
deltas as (select c.key, c.n - g.n as delta from counts c join given g using (key) where c.n <> g.n),
able as (select key, id, min(case when delta < 0 then 0 when meaning = 'unknown' then 2 when stays then 0 else 1 end) as priority, any_value(delta) as delta from judged join deltas using (key)
  where case when delta > 0 then high and (meaning in ('internal_transfer', 'external_transfer') or (meaning = 'unknown' and bare)) else not high and meaning = 'unknown' end group by key, id),
lists as (select key, abs(any_value(delta)) as needed, list(id order by priority, id) as ids from able group by key),
folded as (select list_reduce(list_prepend(struct_pack(key := '', needed := 0::bigint, ids := []::varchar[], said := []::varchar[]),
    list(struct_pack(key := key, needed := needed::bigint, ids := ids, said := []::varchar[]) order by key)),
  lambda x, y: struct_pack(key := '', needed := 0::bigint, ids := list_concat(x.ids, list_filter(y.ids, lambda i: not list_contains(x.ids, i))[1:y.needed]),
    said := list_concat(x.said, list_transform(list_filter(y.ids, lambda i: not list_contains(x.ids, i))[1:y.needed], lambda i: y.key || '#' || i)))) as f from lists),
taken as (select split_part(s, '#', 1) as key, split_part(s, '#', 2) as id from (select unnest(f.said) as s from folded)),
operations as (select key, id, case when delta < 0 then 'promote_unknown' when priority = 2 then 'demote_unknown_clear_reference' when priority = 0 then 'demote_internal_clear_reference' else 'demote_internal' end as action
  from taken join able using (key, id))"""


@register("align_operations", duck(f"with {SQL_ALIGNED} select key, id, action from operations"))
def align_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which transactions change, by which key and how; none twice."""
    return aligned(spark, sf_dir).operations.select("key", "id", "action")


@register("align_unresolved", duck(f"""with {SQL_ALIGNED} select d.key, case when delta > 0 then 'demote' else 'promote' end as kind, abs(delta) as needed, abs(delta) - count(o.id) as missing
  from deltas d left join operations o using (key) group by d.key, delta having abs(delta) > count(o.id)"""))  # fmt: skip
def align_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose counts can't be met, and by how much."""
    return aligned(spark, sf_dir).unresolved
