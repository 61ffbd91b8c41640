"""Reading statement texts: provider, dates, money, merchants, counterparties, rows of generic layouts and sections."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import text
from ledgerloom.plans.registry import register
from ledgerloom.sources.ledger import Ledger, duck

# Names by which files and texts are told, and patterns of statement lines. Patterns are written
# so that Java and RE2 read them alike: B and E stand for what may be around a word.
B, E = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
FILE_NAMES = (("spb", ("spb",)), ("yandex", ("yandex", "яндекс")), ("sber", ("sber", "сбер")), ("ozon", ("ozon",)))
TEXT_NAMES = (("spb", ('банк "санкт-петербург"', "банк санкт-петербург")), ("ozon", ("ozon bank", "озон")), ("sber", ("sberbank", "сбербанк")), ("yandex", ("yandex bank", "яндекс банк")))
KINDS = (("savings", ("saving", "deposit")), ("card", ("card",)), ("wallet", ("wallet",)))
DATE = r"[0-9]{2}[./][0-9]{2}[./][0-9]{4}"
MONEY = r"[+\-–−]?\s*[0-9][0-9\s\x{00A0}]*[.,][0-9]{2}"
LONG_DIGITS, MASKED = r"\b[0-9]{6,}\b", r"\*{2,}[0-9]{2,4}"
NAME = r"[A-Za-zА-Яа-я0-9.&@_/-]"
MOST_MONEY = 100_000_000_000
LETTERS = "[A-Za-zА-Яа-яЁё]"
SENDERS = (
    rf"(?i){B}(?:отправитель|sender)\s*:\s*([^.;,]{{3,}})",
    rf"(?i){B}входящий\s+перевод(?:\s+сбп)?\s*,\s*([^,.;]{{3,}})",
    rf"(?i){B}зачисление\s+зарплаты\s+от\s+([^.;,]{{3,}})",
    rf"(?i){B}перевод{E}[^.;]*?{B}от\s+([A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё .'-]{{2,}}?)\s*(?:[.,]|операция|ндс|$)",
    r"(?i)(?:^|[^\p{L}\p{N}_])сумма\s+из\s+([A-Za-zА-Яа-я0-9*._@/&-][A-Za-zА-Яа-я0-9*._@/&\- ]{2,}?)(?:\s+дата|\s+время|\s*$)",
    r"^([А-ЯЁ][А-ЯЁ]+(?:\s+[А-ЯЁ][А-ЯЁ]+){1,3})\s+[0-9]{10,}",
)
LABELS = ((r"(?i)^капитализация\s+вклада" + E, "Капитализация вклада"), (r"(?i)^зачисление\s+к/с" + E, "Зачисление к/с"), (r"(?i)^зачисление\s+остатка\s+эдс" + E, "Остаток ЭДС"))
PREFIXES = ("перевод", "зачисление", "списание", "пополнение", "капитализация вклада")
MERCHANTS = (
    rf"(?i){B}(?:получатель|merchant|магазин)\s*:\s*([^.;,]{{3,}})",
    r"(?i)(?:^|[^\p{L}\p{N}_])в\s+([A-Za-zА-Я0-9\"«»'._@/&-][A-Za-zА-Я0-9\"«»'._@/&\- ]{2,}?)\s+(?:дата|время|ндс|сумма|операция|$)",
    r"(?i)(?:^|[^\p{L}\p{N}_])([A-ZА-Я0-9._-]+\*[A-ZА-Я0-9._@-]+(?:\s+[A-ZА-Я0-9._@-]+){0,3})",
    rf"(?i){B}((?:ООО|АО|ПАО|ИП)\s*(?:[\"«][^\"»]{{2,}}[\"»]|{NAME}{{2,}}(?:\s+{NAME}{{2,}}){{0,3}}))",
)
CUT = r"(?i)(?:^|[^\p{L}\p{N}_])(?:ндс|операция по|дата|время|интернет-банк|договор|документ)(?:$|[^\p{L}\p{N}_]).*$"
PAID = r"(?i)^(?:оплата товаров по карте|оплата по qr-коду|оплата|покупка)\s+"
FOOTERS = ("дополнительная информация", "шифр, № документа", "на счёте", "страница")
SECTION = "Справка о движении средств"
ROLES = (
    ("sender_role", ("перевод от ", "отправитель:")), ("recipient_role", ("перевод для ", "получатель:")),
    ("incoming_transfer", ("входящий перевод",)), ("outgoing_transfer", ("исходящий перевод",)),
)
ROLE_WORDS = (("generic_credit", "зачисление"), ("generic_debit", "списание"))


def java(pattern: str) -> str:
    """A pattern that ignores case as Java writes it: RE2 folds all letters anyway."""
    return pattern.replace("(?i)", "(?iu)")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def any_of(value: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (value.contains(w) for w in words))


def first_named(value: Column, names: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    return F.coalesce(*[F.when(any_of(value, words), F.lit(name)) for name, words in names])


def provider(file_name: Column, page_text: Column) -> Column:
    """By the file's name first, then by what the text says of the bank."""
    return F.coalesce(first_named(F.lower(file_name), FILE_NAMES), first_named(F.lower(page_text), TEXT_NAMES), F.lit("unknown"))


def statement_kind(file_name: Column, page_text: Column) -> Column:
    return F.coalesce(first_named(F.lower(file_name), KINDS), F.when(any_of(F.lower(page_text), ("счет", "счёт")), "payment"), F.lit("unknown"))


def spaced(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\s\x{00A0}]+", " "))


def parsed_money(raw: Column) -> Column:
    """An amount with any minus, spaces and a decimal comma; what isn't a number is null."""
    plain = F.regexp_replace(F.translate(raw, "−–,", "--."), r"[ \x{00A0}]", "")
    plain = F.trim(plain)
    return F.when(plain.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$"), F.regexp_replace(plain, r"^\+", "")).try_cast("decimal(20,2)")


def amounts(line: Column) -> Column:
    """The amounts with two decimals that a line holds, in order; too large ones are left out."""
    found = F.transform(F.regexp_extract_all(line, F.lit(MONEY), F.lit(0)), lambda m: parsed_money(F.regexp_replace(m, r"\s", "")))
    return F.filter(found, lambda v: v.isNotNull() & (F.abs(v) <= MOST_MONEY))


def parsed_date(line: Column) -> Column:
    day = F.translate(F.regexp_extract(line, DATE, 0), "/", ".")
    return F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit("dd.MM.yyyy")).cast("timestamp_ntz")


def parsed_time(line: Column) -> Column:
    """Seconds of the day of the first time in a line; null if there is none or it isn't one of the clock."""
    part = lambda k: F.regexp_extract(line, r"\b([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?\b", k)
    h, m, s = part(1).try_cast("int"), part(2).try_cast("int"), F.coalesce(part(3).try_cast("int"), F.lit(0))
    return F.when((h <= 23) & (m <= 59) & (s <= 59), h * 3600 + m * 60 + s)


def clean_merchant(value: Column) -> Column:
    """Without long numbers, masked cards, outer punctuation and quotes; 120 characters at most, nothing shorter than two."""
    bare = spaced(F.regexp_replace(F.regexp_replace(spaced(value), LONG_DIGITS, " "), MASKED, " "))
    bare = F.regexp_replace(F.regexp_replace(bare, r"^[ \-:;,.]+", ""), r"[ \-:;,.]+$", "")
    bare = spaced(F.regexp_replace(bare, '["«»]', ""))
    return let(bare, lambda v: F.when(F.length(v) >= 2, F.left(v, F.lit(120))).otherwise(""))


def lettered(value: Column) -> Column:
    return let(value, lambda v: F.when(v.rlike(LETTERS), v))


def counterparty(line: Column) -> Column:
    """Whom an inflow comes from, by the first pattern that names somebody, or by what kind of inflow it is."""
    named = [lettered(clean_merchant(lettered(F.regexp_extract(line, java(p), 1)))) for p in SENDERS]
    return F.coalesce(*named, *[F.when(line.rlike(java(p)), label) for p, label in LABELS], F.lit(""))


def merchant_label(description: Column, bank_category: Column, direction: Column) -> Column:
    """The merchant of a transaction: a named one, else what is left of the description, else the bank's category."""
    full = lambda c: F.nullif(c, F.lit(""))

    def label(line: Column) -> Column:
        named = [full(clean_merchant(F.regexp_extract(line, java(p), 1))) for p in MERCHANTS]
        rest = spaced(F.regexp_replace(F.regexp_replace(line, MASKED, " "), LONG_DIGITS, " "))
        rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, java(CUT), ""), r"[;|].*$", ""), java(PAID), "")
        known = F.when(direction == "in", full(counterparty(line)))
        transfer = reduce(lambda a, b: a | b, (F.lower(line).startswith(p) for p in PREFIXES))
        other = F.when(transfer, "").otherwise(F.coalesce(*named, full(clean_merchant(rest)), clean_merchant(bank_category)))
        return F.when(line == "", "").otherwise(F.coalesce(known, other))

    return let(spaced(description), label)


def rewritten(bank: Column, description: Column, direction: Column) -> Column:
    """Descriptions whose words of transfers would mislead the lenses, said otherwise; the first place only."""
    line = spaced(description)
    qr = F.when(direction == "out", F.regexp_replace(line, r"(?iu)^Оплата\s+СБП\s+QR", "Оплата QR")).otherwise(line)
    back = F.when(direction == "in", spaced(F.regexp_replace(line, r"(?iu)^(.*?возврат\s+покупки\s+по\s+qr[–-]?коду)\s+сбп(" + E + ")", "$1$2"))).otherwise(line)
    return F.when(bank == "yandex", qr).when(bank == "sber", back).otherwise(line)


def described(raw: Column) -> Column:
    """A row's text as a description: without the leading date and what a page's foot added."""
    line = F.regexp_replace(spaced(raw), r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?:\s+[0-9]{2}:[0-9]{2})?\s+", "")
    for footer in FOOTERS:
        line = let(line, until(footer))
    return line


def until(word: str) -> Callable[[Column], Column]:
    """A text up to a word, if something stands before it."""
    return lambda v: F.when(F.instr(F.lower(v), word) > 1, F.trim(F.left(v, F.instr(F.lower(v), word) - 1))).otherwise(v)


def roles(said: Column, direction: Column) -> Column:
    """What the texts of a transfer say of its sides, in a fixed order."""
    low = F.lower(F.trim(said))
    tags = [F.when(any_of(low, words), F.lit(name)) for name, words in ROLES]
    told = reduce(lambda a, b: a | b, (t.isNotNull() for t in tags))
    tags += [F.when(low.rlike(B + word + E), F.lit(name)) for name, word in ROLE_WORDS]
    tags.append(F.when(low.contains("сбп") & ~told, F.lit("sbp_protocol_only")))
    found = F.array_compact(F.array(*tags))
    other = F.when(direction == "in", "direction_in_other").when(direction == "out", "direction_out_other").otherwise("other")
    return F.when(F.size(found) > 0, found).otherwise(F.array(other))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ledger(spark, sf_dir).lines


quoted = lambda s: "'" + s.replace("'", "''") + "'"
sql_any = lambda value, words: "(" + " or ".join(f"contains({value}, {quoted(w)})" for w in words) + ")"
sql_names = lambda value, names: "case " + " ".join(f"when {sql_any(value, words)} then '{name}'" for name, words in names) + " end"
SQL_SPACED = "trim(regexp_replace(coalesce({}, ''), '[\\s\\x{{00A0}}]+', ' ', 'g'))"


def sql_clean(value: str) -> str:
    bare = SQL_SPACED.format(f"regexp_replace(regexp_replace({SQL_SPACED.format(value)}, '{LONG_DIGITS}', ' ', 'g'), '{MASKED}', ' ', 'g')")
    bare = SQL_SPACED.format(f"""regexp_replace(regexp_replace(regexp_replace({bare}, '^[ \\-:;,.]+', ''), '[ \\-:;,.]+$', ''), '["«»]', '', 'g')""")
    return f"(select case when length(x) >= 2 then left(x, 120) else '' end from (select {bare} as x))"


@register("detect_provider", duck(f"""select event_id, coalesce({sql_names('lower(file_name)', FILE_NAMES)}, {sql_names('lower(line)', TEXT_NAMES)}, 'unknown') as provider,
  coalesce({sql_names('lower(file_name)', KINDS)}, case when {sql_any('lower(line)', ('счет', 'счёт'))} then 'payment' end, 'unknown') as kind from {{lines}}"""))  # fmt: skip
def detect_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    file_name, line = F.col("file_name"), F.col("line")
    return lines(spark, sf_dir).select("event_id", provider(file_name, line).alias("provider"), statement_kind(file_name, line).alias("kind"))


SQL_DATE = f"try_strptime(replace(regexp_extract(line, '{DATE}'), '/', '.'), '%d.%m.%Y')"


@register("parse_dates", duck(f"""select event_id, day, day + to_seconds(coalesce(case when h <= 23 and m <= 59 and s <= 59 then h * 3600 + m * 60 + s end, 0)) as at from (
  select event_id, {SQL_DATE} as day, try_cast(regexp_extract(line, '\\b([0-9]{{2}}):([0-9]{{2}})(?::([0-9]{{2}}))?\\b', 1) as int) as h, try_cast(regexp_extract(line, '\\b([0-9]{{2}}):([0-9]{{2}})(?::([0-9]{{2}}))?\\b', 2) as int) as m,
    coalesce(try_cast(regexp_extract(line, '\\b([0-9]{{2}}):([0-9]{{2}})(?::([0-9]{{2}}))?\\b', 3) as int), 0) as s from {{lines}})"""))  # fmt: skip
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first date of a line with the first time; what is no day of the calendar is null, what is no time is midnight."""
    day = parsed_date(F.col("line"))
    at = F.timestamp_add("SECOND", F.coalesce(parsed_time(F.col("line")), F.lit(0)), day)
    return lines(spark, sf_dir).select("event_id", day.alias("day"), at.alias("at"))


SQL_MONEY = "case when regexp_full_match(x, '[+-]?[0-9]+(\\.[0-9]*)?') then try_cast(regexp_replace(x, '^\\+', '') as decimal(20,2)) end"


@register("parse_money", duck(f"select event_id, {SQL_MONEY} as amount from (select event_id, trim(regexp_replace(translate(raw, '−–,', '--.'), '[ \\x{{00A0}}]', '', 'g')) as x from {{lines}})"))
def parse_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("event_id", parsed_money(F.col("raw")).alias("amount"))


@register("clean_merchant", duck(f"select event_id, {sql_clean('line')} as merchant from {{lines}}"))
def clean_merchant_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("event_id", clean_merchant(F.col("line")).alias("merchant"))


def sql_counterparty(line: str) -> str:
    letters = lambda x: f"case when regexp_matches({x}, '[A-Za-zА-Яа-яЁё]') then {x} end"
    named = [letters(sql_clean(letters(f"regexp_extract({line}, {quoted(p)}, 1)"))) for p in SENDERS]
    return f"coalesce({', '.join(named)}, " + "case " + " ".join(f"when regexp_matches({line}, {quoted(p)}) then {quoted(label)}" for p, label in LABELS) + " end, '')"


@register("counterparty", duck(f"select event_id, {sql_counterparty('l')} as counterparty from (select event_id, {SQL_SPACED.format('line')} as l from {{lines}})"))
def counterparty_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("event_id", counterparty(spaced(F.col("line"))).alias("counterparty"))


SQL_REST = "regexp_replace(regexp_replace(regexp_replace(" + SQL_SPACED.format(f"regexp_replace(regexp_replace(l, '{MASKED}', ' ', 'g'), '{LONG_DIGITS}', ' ', 'g')") + f", '{CUT}', ''), '[;|].*$', ''), '{PAID}', '')"
def sql_merchant(category: str) -> str:
    """The label of a line ``l`` with its ``counterparty``; the bank's category stands in where nothing else is said."""
    return f"""case when l = '' then '' when direction = 'in' and counterparty <> '' then counterparty when {' or '.join(f"starts_with(lower(l), '{p}')" for p in PREFIXES)} then ''
  else coalesce({', '.join(f"nullif({sql_clean(f'regexp_extract(l, {quoted(p)}, 1)')}, '')" for p in MERCHANTS)}, nullif({sql_clean(SQL_REST)}, ''), {sql_clean(category)}) end"""


SQL_MERCHANT = sql_merchant("'shop'")


@register("merchant_label", duck(f"select event_id, {SQL_MERCHANT} as merchant from (select *, {sql_counterparty('l')} as counterparty from (select event_id, direction, {SQL_SPACED.format('line')} as l from {{lines}}))"))
def merchant_label_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("event_id", merchant_label(F.col("line"), F.lit("shop"), F.col("direction")).alias("merchant"))


SQL_REWRITTEN = (
    "case when bank = 'yandex' and direction = 'out' then regexp_replace(l, '(?i)^Оплата\\s+СБП\\s+QR', 'Оплата QR') when bank = 'sber' and direction = 'in' then "
    + SQL_SPACED.format(f"regexp_replace(l, '(?i)^(.*?возврат\\s+покупки\\s+по\\s+qr[–-]?коду)\\s+сбп({E})', '\\1\\2')")
    + " else l end"
)


@register("desc_rewrite", duck(f"select event_id, {SQL_REWRITTEN} as description from (select event_id, direction, bank, {SQL_SPACED.format('line')} as l from {{lines}})"))
def desc_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("event_id", rewritten(F.col("bank"), F.col("line"), F.col("direction")).alias("description"))


SQL_AMOUNTS = (
    f"list_filter(list_transform(regexp_extract_all(regexp_replace(rest, '{DATE}', ' ', 'g'), '{MONEY}'), lambda m: (select "
    + SQL_MONEY
    + f" from (select trim(regexp_replace(translate(regexp_replace(m, '\\s', '', 'g'), '−–,', '--.'), '[ \\x{{{{00A0}}}}]', '', 'g')) as x))), lambda v: v is not null and abs(v) <= {MOST_MONEY})"
)


@register("generic_rows", duck(f"""select event_id, day as operation_date, abs(amount)::decimal(20,2) as amount, case when amount > 0 then 'in' else 'out' end as direction, trim(rest) as description from (
  select event_id, day, rest, try_cast(translate(regexp_replace(regexp_extract(regexp_replace(rest, '{DATE}', ' ', 'g'), '{MONEY}'), '[\\s\\x{{00A0}}+]', '', 'g'), '−–,', '--.') as decimal(20,2)) as amount
  from (select event_id, {SQL_DATE} as day, regexp_replace(trim(line), '^.*?{DATE}', '') as rest from {{lines}} where regexp_matches(line, '{DATE}'))) where day is not null and amount is not null and abs(amount) <= {MOST_MONEY}"""))  # fmt: skip
def generic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a date and an amount as rows: the first amount after the date counts, its sign is the direction."""
    line = F.trim("line")
    rest = F.regexp_replace(line, rf"^.*?{DATE}", "")
    found = lines(spark, sf_dir).where(line.rlike(DATE)).select("event_id", parsed_date(line).alias("day"), rest.alias("rest"))
    found = found.withColumn("amount", F.get(amounts(F.regexp_replace("rest", DATE, " ")), 0)).where("day is not null and amount is not null")
    direction = F.when(F.col("amount") > 0, "in").otherwise("out")
    return found.select("event_id", F.col("day").alias("operation_date"), F.abs("amount").alias("amount"), direction.alias("direction"), F.trim("rest").alias("description"))


@register("sections", duck(f"""select file_name, page, greatest(1, section) as section from (
  select file_name, page, sum(starts::int) over (partition by file_name order by page) as section, sum(starts::int) over (partition by file_name) as sections from (
  select file_name, page, bool_or(contains(line, '{SECTION}')) as starts from {{lines}} group by all)) where section > 0 or sections = 0"""))  # fmt: skip
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the section that they belong to: a page with the marker begins one, and pages before the first belong to none."""
    pages = lines(spark, sf_dir).groupBy("file_name", "page").agg(F.bool_or(F.col("line").contains(SECTION)).alias("starts"))
    so_far = F.sum(F.col("starts").cast("int")).over(Window.partitionBy("file_name").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    most = F.sum(F.col("starts").cast("int")).over(Window.partitionBy("file_name"))
    dealt = pages.select("file_name", "page", so_far.alias("section"), most.alias("sections")).where("section > 0 or sections = 0")
    return dealt.select("file_name", "page", F.greatest(F.lit(1), "section").alias("section"))


def sql_described(raw: str) -> str:
    line = f"regexp_replace({SQL_SPACED.format(raw)}, '^[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}}(?:\\s+[0-9]{{2}}:[0-9]{{2}})?\\s+', '')"
    for footer in FOOTERS:
        line = f"(select case when instr(lower(x), '{footer}') > 1 then trim(left(x, instr(lower(x), '{footer}') - 1)) else x end from (select {line} as x))"
    return line


@register("best_description", duck(f"select file_name, page, arg_min(d, (-length(d), d)) as description from (select file_name, page, {sql_described('line')} as d from {{lines}}) where d <> '' group by all"))
def best_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the texts of a group the richest, the first of equally long ones."""
    said = lines(spark, sf_dir).select("file_name", "page", described(F.col("line")).alias("d")).where("d <> ''")
    return said.groupBy("file_name", "page").agg(F.min(F.struct((-F.length("d")).alias("n"), "d"))["d"].alias("description"))


SQL_ROLES = ", ".join(f"case when {sql_any('l', words)} then '{name}' end" for name, words in ROLES)
SQL_WORDS = ", ".join(f"case when regexp_matches(l, '{B}{word}{E}') then '{name}' end" for name, word in ROLE_WORDS)


@register("phrase_roles", duck(f"""select event_id, array_to_string(case when len(found) > 0 then found else [case direction when 'in' then 'direction_in_other' when 'out' then 'direction_out_other' else 'other' end] end, ',') as roles from (
  select event_id, direction, list_filter([{SQL_ROLES}, {SQL_WORDS}, case when contains(l, 'сбп') and coalesce({SQL_ROLES}) is null then 'sbp_protocol_only' end], lambda x: x is not null) as found
  from (select event_id, direction, lower(trim(line)) as l from {{lines}}))"""))  # fmt: skip
def phrase_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("event_id", F.array_join(roles(text("line"), F.col("direction")), ",").alias("roles"))
