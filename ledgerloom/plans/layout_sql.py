"""DuckDB SQL of the records of statement layouts."""

from __future__ import annotations

from ledgerloom.plans.statements import DATE, KINDS, LETTERS, MONEY, MOST_MONEY, SECTION, E, quoted, sql_any, sql_names

DAY, CLOCK = r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}", r"[0-9]{2}:[0-9]{2}(?::[0-9]{2})?"
AUTH = r"[0-9A-Za-z\-]{4,}"
SPACES = r"[\s\x{00A0}]"
PLACE = "partition by file_name, section order by page, n"
SO_FAR = "rows between unbounded preceding and 1 preceding"


def spaced(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACES}+', ' ', 'g'))"


def bare(x: str, tail: str = "") -> str:
    """A text without its amounts."""
    return spaced(f"regexp_replace({x}, '{MONEY}{tail}', ' ', 'g')")


def value(token: str) -> str:
    return f"try_cast(translate(replace({token}, '+', ''), '−–,', '--.') as decimal(20,2))"


def tokens(x: str, pattern: str = MONEY) -> str:
    found = f"list_transform(regexp_extract_all(regexp_replace({x}, '{DATE}', ' ', 'g'), '{pattern}'), lambda m: regexp_replace(m, '[\\s\\x{{00A0}}₽]', '', 'g'))"
    return f"list_filter({found}, lambda v: abs({value('v')}) <= {MOST_MONEY})"


def day(x: str) -> str:
    return f"try_strptime(replace(regexp_extract({x}, '{DATE}'), '/', '.'), '%d.%m.%Y')"


def at(x: str, clock: str) -> str:
    parts = f"list_transform(string_split({clock}, ':'), lambda p: try_cast(p as int))"
    seconds = f"(select case when p[1] <= 23 and p[2] <= 59 and coalesce(p[3], 0) <= 59 then p[1] * 3600 + p[2] * 60 + coalesce(p[3], 0) end from (select {parts} as p))"
    return f"({day(x)} + to_seconds(case when {clock} <> '' then coalesce({seconds}, 0) else 0 end))"


def joined(x: str) -> str:
    return f"coalesce(trim(string_agg({x}, ' ' order by page, n)), '')"


def lines(provider: str, marks: tuple[str, ...] = ()) -> str:
    begins = " and ".join(f"contains(text, {quoted(m)})" for m in marks) or "false"
    return f"""pages as (select file_name, page, text, ({begins})::int as b from {{statement_pages}} where provider = '{provider}'),
  parts as (select *, sum(b) over (partition by file_name order by page) as s, sum(b) over (partition by file_name) as most from pages),
  cut as (select file_name, greatest(s, 1) as section, page, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as n from parts where s > 0 or most = 0),
  own as (select file_name, section, page, n, trim(raw) as line from cut where trim(raw) <> '')"""


def shaped(source: str) -> str:
    return f"""select file_name, section, row_number() over (partition by file_name, section order by record) - 1 as row_index, page, abs(signed) as amount,
  operation_at, posting_at, direction, description, reference, category, timestamp_precision, raw_text from {source}"""


WAY = "case when signed > 0 then 'in' else 'out' end"


def wallet(credited: str, remainder: str, payees: tuple[str, ...]) -> str:
    head, timed = rf"^({DAY})\s+({CLOCK})\s+([0-9]+)\s*(.*)$", rf"^({CLOCK})\s+([0-9]+)\s*(.*)$"
    part = lambda k: f"case when whole then regexp_extract(line, '{head}', {k}) when begins then regexp_extract(line, '{timed}', {k - 1}) end"
    paid = spaced("regexp_replace(regexp_replace(said, '^Перевод ', 'Оплата '), '(?i)\\s*через\\s+СБП\\.\\s*', ' ', 'g')")
    return f"""with {lines('ozon', (SECTION,))},
  told as (select *, regexp_full_match(line, '{DAY}') as alone, regexp_matches(line, '{head}') as whole, regexp_matches(line, '{timed}') as later from own),
  waiting as (select *, nullif(last_value(case when alone then line when (whole and {day('line')} is not null) or later then '' end ignore nulls) over ({PLACE} {SO_FAR}), '') as waits from told),
  begun as (select *, whole or (later and waits is not null) as begins from waiting where not alone),
  dealt as (select *, sum(begins::int) over ({PLACE}) as record from begun),
  cells as (select *, case when begins then {at("case when whole then line else waits end", f"({part(2)})")} end as moment, {part(3)} as document,
    case when begins then nullif({part(4)}, '') else line end as piece, case when begins and not whole then waits || ' ' || line else line end as raw from dealt where record > 0),
  found as (select file_name, section, record, min(page) as page, max(moment) as operation_at, max(document) as reference, {joined('raw')} as raw_text, {joined('piece')} as pieces from cells group by all),
  valued as (select *, {value(f"coalesce({tokens('raw_text', MONEY.replace('?', '', 1) + r'\s*₽')}[1], {tokens('raw_text')}[1])")} as signed, {bare('pieces', r'\s*₽?')} as said from found),
  named as (select *, {WAY} as direction, null::timestamp as posting_at, '' as category, 'exact' as timestamp_precision from valued where operation_at is not null and signed is not null),
  done as (select *, case when starts_with(said, {quoted(credited)}) then replace(said, 'по переводу денежных средств', 'по зачислению денежных средств')
    when starts_with(said, {quoted(remainder)}) then regexp_replace(said, '^Перевод', 'Зачисление')
    when direction = 'out' and starts_with(said, 'Перевод ') and {sql_any('said', payees)} then {paid} else said end as description from named)
  {shaped('done')}"""


def contract(marks: tuple[str, ...], heads: tuple[str, ...], parts: tuple[str, ...], own_move: str) -> str:
    heading = f"starts_with(low, 'страница') or starts_with(low, 'сумма в валюте') or low in ({', '.join(map(quoted, heads))}) or {sql_any('low', parts)}"
    return f"""with {lines('yandex', marks)},
  told as (select *, case when {heading} then 'heading' when regexp_full_match(line, '{DAY}') then 'day' when regexp_matches(line, '^в\\s*{CLOCK}') then 'clock'
    when regexp_matches(line, '{DATE}') and contains(line, '₽') and not contains(low, 'остаток') and len({tokens('line')}) > 0 then 'row' else 'text' end as kind from (select *, lower(line) as low from own)),
  runs as (select *, coalesce(sum((kind in ('heading', 'row'))::int) over ({PLACE} {SO_FAR}), 0) as record,
    last_value(nullif(regexp_extract(line, 'в\\s*({CLOCK})', 1), '') ignore nulls) over ({PLACE} rows between 4 preceding and current row) as near from told),
  found as (select file_name, section, record, max(page) as page, max(line) filter (kind = 'row') as raw_text, max(near) filter (kind = 'row') as near,
    arg_max(line, (page, n)) filter (kind = 'day') as own_day, arg_max(case when kind = 'day' then '' else regexp_extract(line, '^в\\s*({CLOCK})', 1) end, (page, n)) filter (kind in ('day', 'clock')) as own_clock,
    {joined(f"case kind when 'text' then line when 'row' then nullif(trim(regexp_extract(line, '^(.*?){DATE}', 1)), '') end")} as said from runs group by all having bool_or(kind = 'row')),
  timed as (select *, coalesce(nullif(own_clock, ''), near, '') as clock from found),
  valued as (select *, {at('coalesce(own_day, raw_text)', 'clock')} as operation_at, {value(f"{tokens('raw_text')}[1]")} as signed from timed),
  named as (select *, {WAY} as direction from valued where operation_at is not null),
  said_ as (select * exclude (said), null::timestamp as posting_at, '' as reference, case when clock <> '' then 'exact' else 'date_only' end as timestamp_precision,
    case when direction = 'out' then regexp_replace({spaced('said')}, '(?i)^Оплата\\s+СБП\\s+QR', 'Оплата QR') else {spaced('said')} end as description from named),
  done as (select *, case when description = {quoted(own_move)} then 'transfer' else '' end as category from said_)
  {shaped('done')}"""


def ledger(starts: tuple[str, ...], noise: tuple[str, ...]) -> str:
    left_out = " or ".join(f"starts_with(low, {quoted(s)})" for s in starts)
    return f"""with {lines('spb')},
  kept as (select *, regexp_matches(line, '^{DAY}\\s+.+$') as begins from (select *, lower(line) as low from own)
    where not ({left_out} or low in ({', '.join(map(quoted, noise))}) or contains(low, 'входящий остаток') or regexp_full_match(line, '/[0-9]+\\s+[0-9]+') or regexp_full_match(line, '{DAY}\\s*\\|\\s*[0-9]{{2}}:[0-9]{{2}}'))),
  dealt as (select *, sum(begins::int) over ({PLACE}) as record from kept),
  opened as (select *, first_value(left(line, 10)) over (partition by file_name, section, record order by page, n) as day_ from dealt where record > 0),
  cells as (select *, case when begins then regexp_extract(line, '^{DAY}\\s+(.+)$', 1) when not regexp_full_match(line, '{MONEY}') then line end as piece,
    case when begins then nullif(regexp_extract(regexp_extract(line, '^{DAY}\\s+(.+)$', 1), '\\b{CLOCK}\\b'), '') end as inline,
    list_filter(regexp_extract_all(line, '(?:^|\\s){DAY}\\s+{CLOCK}\\b'), lambda h: contains(h, day_))[1] as h from opened),
  found as (select file_name, section, record, min(page) as page, any_value(day_) as day_, max(inline) as inline, regexp_extract(arg_min(h, (page, n)) filter (h is not null), '{CLOCK}$') as hidden,
    {joined('line')} as raw_text, {joined('piece')} as pieces from cells group by all),
  valued as (select *, coalesce(inline, hidden, '') as clock, {value(f"{tokens('raw_text')}[1]")} as signed, {bare('pieces')} as said from found),
  named as (select *, {at('day_', 'clock')} as operation_at, {WAY} as direction, lower(said) as low, coalesce(nullif(said, ''), raw_text) as description, regexp_extract(raw_text, '(?i)код\\s+операции\\s+([A-Za-z0-9]+)', 1) as own_reference,
    null::timestamp as posting_at, case when clock <> '' then 'inferred' else 'date_only' end as timestamp_precision from valued where signed is not null),
  told as (select *, case when {sql_any('low', ('перевод', 'сбп', 'sbp'))} then 'transfer' when contains(low, 'зарплат') then 'salary' when {sql_any('low', ('кешбэк', 'поощрен'))} then 'cashback' else '' end as category from named where operation_at is not null),
  same as (select *, 'spbdup|' || strftime(operation_at, '%Y-%m-%dT%H:%M:%S') || '|' || direction || '|' || abs(signed)::string || '|' || category || '|' || {spaced('description')} as key from told),
  done as (select *, case when own_reference <> '' then own_reference when count(*) over (partition by file_name, key, own_reference = '') > 1
    then left(sha1(key || '|' || (row_number() over (partition by file_name, key, own_reference = '' order by record))::string), 24) else '' end as reference from same)
  {shaped('done')}"""


def table(marks: tuple[str, ...], starts: tuple[str, ...], words: tuple[str, ...], next_page: str, out_words: tuple[str, ...], in_words: tuple[str, ...]) -> str:
    left_out = " or ".join(f"starts_with(low, {quoted(s)})" for s in starts)
    goes_on = rf"^({DATE})\s+[.,;]*({AUTH})[.,;]*(?:\s+(.*))?$"
    digit = lambda k, p: f"regexp_matches(regexp_extract(line, '{p}', {k}), '[0-9]')"
    code = rf"^({DAY})\s+({AUTH})\s*(.*)$"
    part = lambda k: f"case when coded and not begins then regexp_extract(line, '{code}', {k}) when slashed then regexp_extract(line, '{goes_on}', {k}) end"
    return f"""with {lines('sber')},
  named as (select *, lower(line) as low, coalesce({sql_names('lower(file_name)', KINDS)}, case when bool_or({sql_any('lower(line)', ('счет', 'счёт'))}) over (partition by file_name) then 'payment' end, 'unknown') as kind from own),
  marked as (select *, {sql_any('low', marks)} as mark, bool_or({sql_any('low', marks)}) over ({PLACE}) as within_ from named),
  kept as (select *, regexp_matches(line, '^{DAY}\\s+.+$') as dated, regexp_matches(line, '{code}') and {digit(2, code)} as coded, regexp_matches(line, '{goes_on}') and {digit(2, goes_on)} as on_ from marked
    where within_ and not mark and not ({left_out} or low in ({', '.join(map(quoted, words))}) or contains(low, 'страница'))),
  runs as (select *, on_ and not dated as slashed, dated and {day('line')} is not null as valid, sum((dated and not coded)::int) over ({PLACE}) as run from kept),
  opened as (select *, dated and (not coded or not coalesce(bool_or(valid) over (partition by file_name, section, run order by page, n {SO_FAR}), false)) as begins from runs),
  dealt as (select *, sum(begins::int) over ({PLACE}) as record from opened),
  cells as (select *, {part(1)} as posted, {part(2)} as code, case when begins then regexp_extract(line, '^{DAY}\\s+(.+)$', 1) when coded or slashed then nullif({part(3)}, '')
    when regexp_matches(line, '{LETTERS}') and not contains(low, {quoted(next_page.lower())}) then line end as piece from dealt where record > 0),
  found as (select file_name, section, record, min(page) as page, max(kind) as kind, max(line) filter (begins) as head, arg_max({day('posted')}, (page, n)) filter ({day('posted')} is not null) as posting_at,
    arg_max(code, (page, n)) filter (code is not null) as code, trim(replace({joined('line')}, {quoted(next_page)}, '')) as raw_text, {joined('piece')} as pieces from cells group by all),
  timed as (select *, regexp_extract(regexp_extract(head, '^{DAY}\\s+(.+)$', 1), '\\b{CLOCK}\\b') as clock, {tokens('raw_text')}[1] as token from found),
  valued as (select *, {at('head', 'clock')} as operation_at, {value('token')} as signed, lower(raw_text) as raw_low from timed where token is not null),
  told as (select *, case when signed = 0 then 'out' when kind = 'card' and not regexp_matches(token, '^[+\\-–−]') then case when {sql_any('raw_low', out_words)} then 'out' when {sql_any('raw_low', in_words)} then 'in' else 'out' end
    else {WAY} end as direction from valued where operation_at is not null),
  said as (select *, {spaced(f"case when direction = 'in' then regexp_replace({spaced('pieces')}, '(?i)^(.*?возврат\\s+покупки\\s+по\\s+qr[–-]?коду)\\s+сбп({E})', '\\1\\2') else {spaced('pieces')} end")} as description,
    coalesce(nullif(code, ''), regexp_extract(raw_text, '№\\s*([0-9][0-9\\-]{{5,}})', 1)) as reference, case when clock <> '' then 'exact' else 'date_only' end as timestamp_precision from told),
  done as (select * exclude (b), case when contains(b, 'возврат') and contains(b, 'qr') then 'refund' when {sql_any('b', ('перевод', 'сбп', 'sbp'))} then 'transfer' when kind <> 'card' and {sql_any('b', ('к/с', 'корреспондирующ'))} then 'transfer'
    when {sql_any('b', ('заработная плата', 'зарплат'))} then 'salary' when {sql_any('b', ('кешбэк', 'кэшбэк'))} then 'cashback' else '' end as category from (select *, lower(description || ' ' || raw_text) as b from said))
  {shaped('done')}"""
