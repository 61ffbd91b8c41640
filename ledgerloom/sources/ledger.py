"""A ledger derived from the benchmark tables by SQL that Spark and DuckDB read alike.

``{events}``, ``{orders}`` and ``{lineitem}`` stand for the base tables, and a name of ``TEXTS`` in
braces for that derived table.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TEXTS: dict[str, str] = {}

TEXTS["transactions"] = """
select 'tx_' || lpad(cast(event_id as string), 8, '0') as id,
  'acc_' || cast(user_id % 12 as string) as account_id,
  case when event_id % 17 = 0 then null else ts end as operation_datetime,
  case when event_id % 5 = 0 then ts + interval 1 day else null end as posting_datetime,
  ts + interval 2 day as created_at,
  case when event_id % 7 = 0 then 'date_only' else 'exact' end as timestamp_precision,
  cast(value as decimal(14,2)) as amount, 'RUB' as currency,
  case when event_type in ('view','signup') then 'in' else 'out' end as direction,
  case event_type when 'click' then case when event_id % 4 = 0 then 'Перевод для клиента' when event_id % 4 = 1 then 'transfer between accounts' when event_id % 4 = 2 then 'Списание' else 'karta-vklad move' end
    when 'view' then case when event_id % 3 = 0 then 'Перевод СБП входящий' when event_id % 3 = 1 then 'Зачисление к/с' else 'Card replenishment' end
    when 'signup' then 'Payroll credit' when 'error' then 'Комиссия' else 'Purchase item ' || cast(event_id % 40 as string) end as description_raw,
  case when event_type = 'purchase' and event_id % 4 <> 0 then 'Merchant ' || cast(event_id % 40 as string) else '' end as merchant_normalized,
  case when event_id % 3 = 0 then 'REF-' || cast(event_id % 500 as string) else '' end as bank_reference_id,
  case event_type when 'click' then 'transfer' when 'view' then 'transfer' when 'error' then 'fees' when 'purchase' then 'shopping' else '' end as bank_category,
  case when event_type in ('click','view') then case when event_id % 11 = 0 then 'internal_transfer' when event_id % 13 = 0 then 'external_transfer' else 'unknown' end
    when event_type = 'error' then 'fee' when event_type = 'purchase' then 'spend'
    else case event_id % 5 when 0 then 'salary' when 1 then 'interest' when 2 then 'cashback' when 3 then 'refund' else 'income' end end as meaning,
  case when event_type = 'purchase' and event_id % 3 <> 0 then 'Cat ' || cast(event_id % 9 as string) when event_id % 10 = 0 then '  ' else '' end as category,
  case when event_id % 6 = 0 then 'needs_review' else 'reviewed' end as review_status,
  case when event_id % 4 = 0 then 'home' when event_id % 4 = 1 then 'home,work' when event_id % 9 = 0 then 'trip' end as tag_list
from {events}
"""

TEXTS["statement_rows"] = """
select 'row_' || lpad(cast(event_id as string), 8, '0') || '_a' as id, 'st_' || cast(user_id % 12 as string) || '_' || cast(cast(floor(day(ts) / 10) as int) as string) as statement_id,
  cast(event_id as int) as row_index, cast(event_id % 4 as int) as page_number, 'raw ' || event_type || ' ' || cast(event_id % 40 as string) as raw_text,
  cast(value as decimal(14,2)) as amount, 'RUB' as currency, case when event_type in ('view','signup') then 'in' else 'out' end as direction, ts as operation_date, event_id
from {events}
union all
select 'row_' || lpad(cast(event_id as string), 8, '0') || '_b', 'st_' || cast(user_id % 12 as string) || '_ov', cast(event_id as int), 1,
  case when event_id % 16 = 0 then 'raw ' || event_type || ' ' || cast(event_id % 40 as string) else 'variant text' end,
  cast(value as decimal(14,2)), 'RUB', case when event_type in ('view','signup') then 'in' else 'out' end, ts, event_id
from {events} where event_id % 8 = 0
"""

#: Rows as they are parsed from statements, with what was found out of the transaction in each; some stand twice.
TEXTS["imports"] = """
select id as statement_row_id, statement_id, event_id, 'acc_' || split_part(statement_id, '_', 2) as account_id, row_index, page_number, raw_text,
  operation_date as row_at, cast(null as timestamp) as row_posted, amount as row_amount, currency as row_currency, direction as row_direction, cast(null as string) as row_precision,
  case when event_id % 17 = 0 then null else operation_date end as tx_at, case when event_id % 5 = 0 then operation_date + interval 1 day end as tx_posted,
  case when event_id % 19 = 0 then cast(0 as decimal(14,2)) else amount end as tx_amount, case when event_id % 23 = 0 then '' else currency end as tx_currency,
  case when event_id % 29 = 0 then null else direction end as tx_direction,
  case when event_id % 6 = 0 then '' when event_id % 6 = 1 then 'Purchase item ' || cast(event_id % 40 as string) else 'Purchase  item ' || cast(event_id % 40 as string) || ' Merchant 12' end as tx_description,
  case when event_id % 4 <> 0 then 'merchant ' || cast(event_id % 40 as string) else '' end as tx_merchant,
  case when event_id % 3 = 0 then 'REF ' || cast(event_id % 500 as string) when event_id % 7 = 0 then 'XREF-' || cast(event_id % 500 as string) else '' end as tx_reference,
  case when event_id % 8 = 0 then 'shopping' end as tx_category, case when event_id % 7 = 0 then 'date_only' else 'exact' end as tx_precision
from (select * from {statement_rows} union all
  select replace(id, '_a', '_c'), statement_id, row_index, page_number, raw_text, amount, currency, direction, operation_date, event_id from {statement_rows} where event_id % 40 = 1 and id like '%_a') as r
"""

#: Lines of statement pages in several layouts.
TEXTS["lines"] = """
select event_id, cast(floor(event_id / 10) as int) as page, case when event_type in ('view','signup') then 'in' else 'out' end as direction,
  case user_id % 3 when 0 then 'yandex' when 1 then 'sber' else 'other' end as bank,
  case user_id % 7 when 0 then 'SPB_2024.pdf' when 1 then 'Yandex card.pdf' when 2 then 'сбер savings.pdf' when 3 then 'ozon wallet.pdf' when 4 then 'deposit.pdf' else 'statement.pdf' end as file_name,
  case event_id % 7 when 0 then '− 1 234,50' when 1 then '+' || cast(cast(value as decimal(14,2)) as string) when 2 then 'a1b2' when 3 then '12 345.60' when 4 then '12 of 5' when 5 then '' else '–' || cast(cast(value as decimal(14,2)) as string) end as raw,
  lpad(cast(day(ts) as string), 2, '0') || case when event_id % 4 = 0 then '/' else '.' end || lpad(cast(month(ts) as string), 2, '0') || case when event_id % 4 = 0 then '/' else '.' end || cast(year(ts) as string) || ' ' ||
  case event_id % 16 when 0 then '10:15 Оплата товаров по карте SHOP*MARKET 12 −1 234,50 ₽' when 1 then '25:61:00 Перевод от Иван И. операция по карте +500,00' when 2 then '09:01:07 Отправитель: ООО "Ромашка", договор 1234567 1 000,00'
    when 3 then 'Списание ****1234 в КОФЕЙНЯ дата 300,00 12 000,00' when 4 then 'Зачисление к/с 31.02.2024 77,10' when 5 then 'Капитализация вклада 15.00' when 6 then 'Оплата СБП QR магазин: Лента; чек - 45,00'
    when 7 then 'возврат покупки по qr-коду СБП 9,99' when 8 then 'Банк Санкт-Петербург счёт без суммы' when 9 then 'Справка о движении средств Озон' when 10 then 'Зачисление зарплаты от АО Завод 40 000,00'
    when 11 then 'Входящий перевод СБП, Пётр П. +10,00 Страница 2' when 12 then 'сумма из ALIFMOBI6 дата 3,33' when 13 then 'Перевод для клиента на счёте 1,00' when 14 then 'Покупка ПАО «Мега Маркет» 123456789 99,90' else 'исходящий перевод сбп 250000000000,00' end as line
from {events}
union all
select event_id, cast(floor(event_id / 10) as int), 'in', 'other', 'statement.pdf', '31', case event_id % 4 when 0 then '31.02.2024 нет дня 5,00' when 1 then 'ИВАНОВ ИВАН 40817810000000 перевод' when 2 then ' Зачисление  остатка ЭДС ' else '' end from {events} where event_id % 25 = 0
"""

#: Pages of statements in four layouts, one for each event.
TEXTS["statement_pages"] = """
select provider, provider || case when file % 2 = 0 then ' card ' else ' savings ' end || cast(file as string) || '.pdf' as file_name, page,
  case provider
    when 'ozon' then case when page % 19 = 3 then 'Справка о движении средств' || chr(10) else '' end || case event_id % 5 when 0 then day || chr(10) || ' 10:1' || digit || ':07 ' || number || ' Перевод Индивидуальный предприниматель через СБП. чай' when 1 then day || ' 25:61 ' || number || chr(10) || 'Зачисление'
      when 2 then '31.02.2024 10:00 ' || number || ' нет дня' else day || ' 0' || digit || ':30 ' || number || ' Заказ 12 345,60' end || chr(10) || '− ' || money || ' ₽' || chr(10) || chr(10) || 'строка ' || digit
    when 'yandex' then case when page % 23 = 2 then 'Выписка по договору Исх. №' || chr(10) else '' end || case event_id % 4 when 0 then 'Оплата СБП QR' || chr(10) || day || chr(10) || 'в 0' || digit || ':15' || chr(10) || 'кафе ' || day || ' –' || money || ' ₽' when 1 then 'Входящий перевод в 11:0' || digit || chr(10) || day || ' +' || money || ' ₽ 1 000,00 ₽'
      when 2 then 'Страница ' || digit || chr(10) || 'Итого ' || money || ' ₽ ' || day else '31.02.2024' || chr(10) || 'нет дня ' || day || ' ' || money || ' ₽' end
    when 'spb' then 'Период: ' || day || chr(10) || day || case event_id % 4 when 0 then ' Перевод СБП' when 1 then ' в 1' || digit || ':20 Зарплата код операции A' || number when 2 then ' Покупка' else ' Кешбэк' end || chr(10) || '+' || money || chr(10) || case when event_id % 3 = 0 then 'чек ' || day || ' 12:3' || digit || ':09' else 'чек' end || chr(10) || '/1 2'
    else case when page % 9 = 1 then 'Расшифровка операций' || chr(10) else '' end || case event_id % 4 when 0 then day || ' 1' || digit || ':40 Перевод от Пётр П. ' || money when 1 then day || ' Возврат покупки по QR–коду СБП +' || money when 2 then day || ' Комиссия № 12345678 −' || money || chr(10) || 'ДАТА' else '31.02.2024 нет дня ' || money end
      || chr(10) || day || ' AB12' || digit || ' подробности' || chr(10) || '1 000,00' || chr(10) || 'Продолжение на следующей странице' end as text
from (select event_id, cast(event_id % 50 as int) as page, cast(floor(event_id / 50) as int) as file, case cast(floor(event_id / 50) as int) % 4 when 0 then 'ozon' when 1 then 'yandex' when 2 then 'spb' else 'sber' end as provider, cast(event_id % 10 as string) as digit,
  cast(1000 + event_id % 900 as string) as number, replace(cast(cast(case when event_id % 10 < 5 then event_id % 7 else value end as decimal(14,2)) as string), '.', ',') as money,
  lpad(cast(day(ts) as string), 2, '0') || '.' || lpad(cast(month(ts) as string), 2, '0') || '.' || cast(year(ts) as string) as day from {events}) as e
"""

TEXTS["links"] = """
select case when event_id % 211 = 0 then 'tx_missing_' || cast(event_id as string) else 'tx_' || lpad(cast(event_id as string), 8, '0') end as transaction_id, id as statement_row_id
from {statement_rows} r where event_id % 97 <> 0
"""

TEXTS["transfer_links"] = """
select 'lk_' || lpad(cast(event_id as string), 8, '0') as id, 'tx_' || lpad(cast(event_id as string), 8, '0') as transaction_out_id,
  case when event_id % 400 = 0 then 'tx_missing' else 'tx_' || lpad(cast(event_id + 1 as string), 8, '0') end as transaction_in_id,
  case cast(floor(event_id / 50) as int) % 4 when 0 then 'auto' when 1 then 'suggested' when 2 then 'confirmed' else 'rejected' end as status,
  cast(0.8 as decimal(6,3)) as match_score, ts as created_at
from {events} where event_id % 50 = 0
"""

TEXTS["balance_snapshots"] = """
select 'acc_' || cast(o_custkey % 12 as string) as account_id, 'st_' || lpad(cast(o_orderkey as string), 8, '0') as statement_id,
  o_orderdate as ts, cast(o_totalprice as decimal(14,2)) as balance, 'statement_opening_balance' as method, 'RUB' as currency from {orders}
union all
select 'acc_' || cast(o_custkey % 12 as string), 'st_' || lpad(cast(o_orderkey as string), 8, '0'),
  o_orderdate + interval 30 day, cast(o_totalprice as decimal(14,2)) + 100, 'statement_closing_balance', 'RUB' from {orders}
"""

TEXTS["statements"] = """
select 'st_' || lpad(cast(o_orderkey as string), 8, '0') as id, 'acc_' || cast(o_custkey % 12 as string) as account_id,
  'bank_' || cast(o_custkey % 5 as string) as provider, case when o_orderkey % 3 = 0 then 'Card Statement' when o_orderkey % 3 = 1 then ' savings ' else 'loan' end as statement_type,
  o_orderdate as period_start, o_orderdate + interval 30 day as period_end,
  case when o_orderkey % 11 = 0 then null else cast(o_totalprice as decimal(14,2)) end as opening_balance,
  cast(cast(o_totalprice as decimal(14,2)) + case when o_orderkey % 5 = 0 then 101 else 100 end as decimal(14,2)) as closing_balance,
  case when o_orderkey % 4 = 0 then null else cast(150 as decimal(14,2)) end as total_credits, case when o_orderkey % 4 = 0 then null else cast(50 as decimal(14,2)) end as total_debits,
  '/in/2024/All_' || o_orderstatus || '.pdf' as pdf_path, 'Acct 40817-' || cast(o_custkey as string) as account_display
from {orders}
"""

TEXTS["exceptions"] = """
select 'ex_' || lpad(cast(event_id as string), 8, '0') as id, case when event_id % 3 = 0 then 'suspected_overlap_duplicate' else 'reconcile_mismatch' end as exception_type,
  case when event_id % 4 = 0 then 'resolved' else 'open' end as status, 'transaction' as entity_type, 'tx_' || lpad(cast(event_id as string), 8, '0') as entity_id, props as payload, ts as created_at
from {events} where event_type = 'error'
"""

TEXTS["reference_rows"] = """
select 'ref_' || cast(l_orderkey as string) || '_' || cast(l_linenumber as string) as id, l_shipdate as operation_date,
  cast(case when l_returnflag = 'R' then -l_extendedprice else l_extendedprice end as decimal(14,2)) as amount_rub,
  case when l_quantity % 3 = 0 then 'true' else 'false' end as is_transfer,
  case when l_quantity % 2 = 0 then 'high' else 'medium' end as transfer_confidence, 'all_' || l_linestatus || '.pdf' as source_file
from {lineitem}
"""

RULE_COLUMNS = (
    "id, name, priority, created_at, enabled, pattern, direction, currency, meaning, category, category_empty, description_contains, merchant_contains, bank_category_contains, "
    "min_amount, max_amount, tags_any, tags_all, tags_none, set_category, set_meaning, set_review_status, set_tags, add_tags, remove_tags"
)
_NAMES = RULE_COLUMNS.split(", ")
_KINDS = {"priority": "int", "created_at": "timestamp", "enabled": "boolean", "category_empty": "boolean", "min_amount": "decimal(14,2)", "max_amount": "decimal(14,2)"}


def _rule(**said: str) -> str:
    """A rule as a row of SQL; what isn't said is null."""
    return "select " + ", ".join(f"cast({said.get(n, 'null')} as {_KINDS.get(n, 'string')}) as {n}" for n in _NAMES)


def _rules(*rules: str) -> str:
    return " union all ".join(rules)


_day = "timestamp '2024-01-0{}'".format
#: Rules of every kind: setters, tags, a pattern, each condition, one disabled, one that says nothing.
TEXTS["rules"] = _rules(
    _rule(id="'r1'", priority="10", created_at=_day(1), enabled="true", pattern="'Merchant 1'", set_category="'Groceries'", add_tags="'food'"),
    _rule(id="'r2'", priority="20", created_at=_day(1), enabled="true", pattern="''", direction="'out'", min_amount="100", set_category="'Large'", set_meaning="'spend'", add_tags="'large,food'"),
    _rule(id="'r3'", priority="20", created_at=_day(2), enabled="true", pattern="'payroll'", direction="'in'", set_category="'Spending'", set_meaning="'salary'", set_review_status="'needs_review'"),
    _rule(id="'r4'", priority="30", created_at=_day(1), enabled="true", pattern="'item 2'", max_amount="50", set_category="'Small'", add_tags="'small'", remove_tags="'home,food'"),
    _rule(id="'r5'", priority="5", created_at=_day(1), enabled="false", pattern="'purchase'", set_category="'Never'"),
    _rule(id="'r6'", priority="1", created_at=_day(1), enabled="true", pattern="'  '", set_category="'Nothing'"),
    _rule(id="'r7'", priority="2", created_at=_day(1), enabled="true", pattern="''", currency="'RUB'", tags_any="'trip,none'", bank_category_contains="'SHOP'", set_tags="'away,trip'"),
    _rule(id="'r8'", priority="15", created_at=_day(1), enabled="true", pattern="''", tags_all="'home,work'", category_empty="true", description_contains="'СБП'", set_tags="'own'", set_category="'Income'"),
    _rule(id="'r9'", priority="25", created_at=_day(1), enabled="true", pattern="''", tags_none="'home'", merchant_contains="'merchant 3'", meaning="'spend'", add_tags="'three'"),
    _rule(id="'r10'", priority="40", created_at=_day(1), enabled="true", pattern="''", category="'Cat 4'", set_tags="''", set_review_status="'reviewed'"),
)
#: The ids, in order, of the rules that stand in where there are none.
DEFAULT_RULES = ("d1", "d2", "d3")
# These rules.
TEXTS["default_rules"] = _rules(
    _rule(id="'d1'", name="'[system] Internal transfer fallback'", priority="1000000", created_at=_day(1), enabled="true", pattern="''", meaning="'internal_transfer'", category_empty="true", set_category="'Transfer'"),
    _rule(id="'d2'", name="'[system] Outflow fallback'", priority="1000001", created_at=_day(1), enabled="true", pattern="''", direction="'out'", category_empty="true", set_category="'Spending'"),
    _rule(id="'d3'", name="'[system] Inflow fallback'", priority="1000002", created_at=_day(1), enabled="true", pattern="''", direction="'in'", category_empty="true", set_category="'Income'"),
)

#: The statements that the rows above belong to, with their accounts, files and batches.
TEXTS["sheets"] = """
select id, case when id like '%_ov' then 'acc_a' || split_part(id, '_', 2) else 'acc_' || split_part(id, '_', 2) end as account_id, '/In/2024/' || case when split_part(id, '_', 3) = '2' then 'x' else '' end || 'All_' || split_part(id, '_', 2) || '.PDF' as pdf_path,
  'f_' || split_part(id, '_', 2) as file_id, 'b_' || cast(cast(split_part(id, '_', 2) as int) % 4 as string) as batch_id,
  case split_part(id, '_', 3) when '0' then 'ok' when '1' then 'mismatch' end as reconcile_status
from (select distinct statement_id as id from {statement_rows}) as s
"""

#: Accounts, some not counted in the net worth, some the same as others by provider, type and name.
TEXTS["accounts"] = """
select 'acc_' || cast(c_custkey % 12 as string) || case when c_custkey < 12 then '' else '_' || cast(c_custkey as string) end as id, 'bank_' || cast(c_custkey % 5 as string) as provider,
  case c_custkey % 3 when 0 then 'card' when 1 then 'savings' else 'unknown' end as account_type, 'Acct 40817-' || cast(c_custkey % 50 as string) as display, 'RUB' as currency,
  c_custkey % 4 <> 0 as include_in_net_worth, timestamp '2024-01-01' + interval 1 day as created_at, c_custkey
from {customer} where c_custkey < 60
"""

BASE = ("events", "orders", "lineitem", "customer", "nation")


def expand(text: str) -> str:
    """A text in which only base tables are left in braces."""
    return re.sub(r"\{(\w+)\}", lambda m: f"({expand(TEXTS[m[1]])})" if m[1] in TEXTS else m[0], text)


def duck(text: str) -> str:
    """The SQL for DuckDB, where base tables are views of their own names."""
    return re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in BASE else m[0], expand(text))


class Ledger:
    """The derived tables of one folder as DataFrames; timestamps are read as UTC. Base tables may be given, streams too."""

    def __init__(self, spark: SparkSession, sf_dir: str, **given: DataFrame) -> None:
        self.spark, self.sf_dir, self.given = spark, sf_dir, given

    def base(self, name: str) -> DataFrame:
        if name in self.given:
            return self.given[name]
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        text = expand(text)
        return self.spark.sql(text, **{n: self.base(n) for n in BASE if f"{{{n}}}" in text})

    @cached_property
    def transactions(self) -> DataFrame:
        return self.sql(TEXTS["transactions"])

    def __getattr__(self, name: str) -> DataFrame:
        if name in TEXTS:
            return self.sql(TEXTS[name])
        raise AttributeError(name)
