"""Records of four banks' statement layouts, from page texts.

A record is a run of lines of a file. Which line begins one depends on what stood before it (a date on a
line of its own, a record that is open), and running counts and last values over the lines of a file say so;
the lines of a record are then grouped. A file is one partition of those windows; records are what is grouped.

Pages are ``file_name, page, text``. Blank lines don't count, a null text has no lines, records without an
amount or with an impossible date are left out, and ``row_index`` counts the records of a section from 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerloom.plans import layout_sql
from ledgerloom.plans.registry import register
from ledgerloom.plans.statements import DATE, LETTERS, MONEY, MOST_MONEY, SECTION, any_of, let, parsed_date, parsed_money, parsed_time, rewritten, spaced, statement_kind
from ledgerloom.sources.ledger import Ledger, duck

# Marks and words of the four layouts.
DAY, CLOCK = r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}", r"[0-9]{2}:[0-9]{2}(?::[0-9]{2})?"
CONTRACT = ("Выписка по договору", "Исх. №")
HEADS = ("операции", "мск", "дата", "обработки", "карта", "эсп", "договора")
HEAD_PARTS = (
    "выписка по договору", "файл содержит", "описание операции", "дата и время", "дата операции", "дата обработки", "карта сумма",
    "сумма в валюте", "входящий остаток", "исходящий остаток", "итого ", "всего ",
)
OWN_MOVE = "Перенос денежных средств с ЭДС на банковский счёт"
NOISE_STARTS = ("период:", "дата плательщик", "исходящий остаток", "иванов иван", "бик ")
NOISE = ("выписка", "поступление", "списание")
TABLE = ("расшифровка операций", "наименование операции")
TABLE_STARTS, TABLE_WORDS = ("выписка ", "дата"), ("операции", "сумма", "остаток")
NEXT_PAGE = "Продолжение на следующей странице"
OUT_WORDS = ("перевод для ", "перевод с карты", "оплата ", "покупка", "снятие наличных", "комиссия", "sberbank onl@in karta-vklad")
IN_WORDS = ("перевод от ", "перевод на карту", "заработная плата", "зачисление", "пополнение", "sberbank onl@in vklad-karta")
CREDITED = "Зачисление по переводу денежных средств по карте 6569 сумма из ALIFMOBI6"
REMAINDER = "Перевод остатка ЭДС в связи повышением уровня идентификации."
PAYEES = (
    "{TC5}<31YY>", "Оплата чаевых", "Индивидуальный предприниматель", 'ГУП "ПЕТЕРБУРГСКИЙ МЕТРОПОЛИТЕН"',
    'АО "ДИКСИ ЮГ"', 'НКО "ПЕРСПЕКТИВА" (ООО)', 'АО "ТАНДЕР"',
)

PLACE = ("page", "n")
KEY = ("file_name", "section", "record")
AUTH = r"(?=[0-9A-Za-z\-]*[0-9])[0-9A-Za-z\-]{4,}"


def in_file(*more: str) -> WindowSpec:
    return Window.partitionBy("file_name", "section", *more).orderBy(*PLACE)


def before(*more: str) -> WindowSpec:
    return in_file(*more).rowsBetween(Window.unboundedPreceding, -1)


def lines_of(pages: DataFrame, marks: tuple[str, ...] = ()) -> DataFrame:
    """(file_name, section, page, n, line): a page with all ``marks`` begins a section; pages before the first go, unless there is none."""
    own = pages.select("file_name", "page", F.coalesce("text", F.lit("")).alias("text"))
    if marks:
        begins = reduce(lambda a, b: a & b, (F.col("text").contains(m) for m in marks)).cast("int")
        by_page = Window.partitionBy("file_name").orderBy("page")
        own = own.withColumn("section", F.sum(begins).over(by_page)).withColumn("sections", F.max("section").over(Window.partitionBy("file_name")))
        own = own.where("section > 0 or sections = 0").withColumn("section", F.greatest("section", F.lit(1)))
    else:
        own = own.withColumn("section", F.lit(1))
    cut = own.select("file_name", "section", "page", F.posexplode(F.split("text", r"\R")).alias("n", "raw"))
    line = F.regexp_replace("raw", r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")
    return cut.select("file_name", "section", "page", "n", line.alias("line")).where("line <> ''")


def at(day: Column, clock: Column) -> Column:
    """A day and a time; a time that the clock doesn't have is midnight, an impossible day is null."""
    return F.timestamp_add("SECOND", F.coalesce(parsed_time(clock), F.lit(0)), parsed_date(day))


def full(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def in_order(value: str) -> Column:
    """The texts of a group in the order of their lines, with spaces between; nulls are left out."""
    found = F.array_sort(F.collect_list(F.struct(*PLACE, F.col(value).alias("said"))))
    return F.trim(F.concat_ws(" ", F.transform(found, lambda x: x["said"])))


def first_of(value: str) -> Column:
    """The first of a group's values that isn't null."""
    return F.min(F.when(F.col(value).isNotNull(), F.struct(*PLACE, F.col(value).alias("said"))))["said"]


def last_of(value: str) -> Column:
    return F.max(F.when(F.col(value).isNotNull(), F.struct(*PLACE, F.col(value).alias("said"))))["said"]


def tokens(value: Column, pattern: str = MONEY) -> Column:
    """The amounts of a text without its dates, as they are written but for spaces; too large ones are left out."""
    found = F.transform(F.regexp_extract_all(F.regexp_replace(value, DATE, " "), F.lit(pattern), F.lit(0)), lambda m: F.regexp_replace(m, r"[\s\x{00A0}₽]", ""))
    return F.filter(found, lambda v: F.abs(parsed_money(v)) <= MOST_MONEY)


def without_money(value: Column, tail: str = "") -> Column:
    return spaced(F.regexp_replace(value, MONEY + tail, " "))


def way(signed: Column) -> Column:
    return F.when(signed > 0, "in").otherwise("out")


def numbered(records: DataFrame) -> DataFrame:
    order = Window.partitionBy("file_name", "section").orderBy("record")
    return records.withColumn("row_index", F.row_number().over(order) - 1)


def shaped(records: DataFrame) -> DataFrame:
    names = ("operation_at", "posting_at", "direction", "description", "reference", "category", "timestamp_precision", "raw_text")
    return numbered(records).select("file_name", "section", "row_index", "page", F.abs("signed").alias("amount"), *names)


def renamed(description: Column, direction: Column) -> Column:
    """Descriptions of a wallet whose words of transfers would mislead the lenses, said otherwise."""
    paid = spaced(F.regexp_replace(F.regexp_replace(description, "^Перевод ", "Оплата "), r"(?iu)\s*через\s+СБП\.\s*", " "))
    credited = F.regexp_replace(description, "^(Зачисление) по переводу денежных средств", "$1 по зачислению денежных средств")
    named = (direction == "out") & description.startswith("Перевод ") & any_of(description, PAYEES)
    back = F.regexp_replace(description, "^Перевод", "Зачисление")
    return F.when(description.startswith(CREDITED), credited).when(description.startswith(REMAINDER), back).when(named, paid).otherwise(description)


def wallet_records(pages: DataFrame) -> DataFrame:
    """Records that begin with day, time and document, the day on the same line or on one of its own before."""
    line = F.col("line")
    head, timed = rf"^({DAY})\s+({CLOCK})\s+([0-9]+)\s*(.*)$", rf"^({CLOCK})\s+([0-9]+)\s*(.*)$"
    whole, later = line.rlike(head), line.rlike(timed)
    own = lines_of(pages, (SECTION,)).withColumn("alone", line.rlike(f"^{DAY}$"))
    # The day that waits for its time: the last one, unless a record took it.
    told = F.when(F.col("alone"), line).when((whole & parsed_date(line).isNotNull()) | later, "")
    own = own.withColumn("waits", full(F.last(told, True).over(before()))).where("not alone")
    parted = later & F.col("waits").isNotNull()
    part = lambda k: F.when(whole, F.regexp_extract(line, head, k)).when(parted, F.regexp_extract(line, timed, k - 1))
    own = own.withColumn("begins", whole | parted).withColumn("record", F.sum(F.col("begins").cast("int")).over(in_file()))
    own = own.withColumn("at", F.when(F.col("begins"), at(F.when(whole, line).otherwise(F.col("waits")), part(2))))
    own = own.withColumn("document", part(3)).withColumn("piece", F.when(F.col("begins"), full(part(4))).otherwise(line))
    own = own.withColumn("raw", F.when(parted, F.concat_ws(" ", "waits", "line")).otherwise(line))
    found = own.where("record > 0").groupBy(*KEY).agg(
        F.min(F.struct(*PLACE))["page"].alias("page"), F.max("at").alias("operation_at"), F.max("document").alias("reference"), in_order("raw").alias("raw_text"), in_order("piece").alias("said")
    )
    roubles = tokens(F.col("raw_text"), rf"{MONEY.replace('?', '', 1)}\s*₽")
    found = found.withColumn("signed", parsed_money(F.coalesce(F.get(roubles, 0), F.get(tokens(F.col("raw_text")), 0))))
    found = found.where("operation_at is not null and signed is not null").withColumn("direction", way(F.col("signed")))
    description = let(without_money(F.col("said"), r"\s*₽?"), lambda d: d)
    found = found.withColumn("said", description).withColumn("description", renamed(F.col("said"), F.col("direction")))
    return shaped(found.withColumns({"posting_at": F.lit(None).cast("timestamp_ntz"), "category": F.lit(""), "timestamp_precision": F.lit("exact")}))


def contract_records(pages: DataFrame) -> DataFrame:
    """Records of one line with a day and a rouble amount, described by the lines since the last record or heading."""
    line, low = F.col("line"), F.lower("line")
    heading = low.startswith("страница") | low.startswith("сумма в валюте") | low.isin(*HEADS) | any_of(low, HEAD_PARTS)
    alone, clock = line.rlike(f"^{DAY}$"), F.regexp_extract(line, rf"^в\s*({CLOCK})", 1)
    row = line.rlike(DATE) & line.contains("₽") & ~low.contains("остаток") & (F.size(tokens(line)) > 0)
    kind = F.when(heading, "heading").when(alone, "day").when(clock != "", "clock").when(row, "row").otherwise("text")
    own = lines_of(pages, CONTRACT).withColumn("kind", kind)
    # What a record or a heading clears belongs to it: a run of lines that ends with either.
    own = own.withColumn("record", F.coalesce(F.sum(F.col("kind").isin("heading", "row").cast("int")).over(before()), F.lit(0)))
    near = F.last(full(F.regexp_extract(line, rf"в\s*({CLOCK})", 1)), True).over(in_file().rowsBetween(-4, 0))
    own = own.withColumns({
        "near": F.when(F.col("kind") == "row", near), "day": F.when(F.col("kind") == "day", line), "row": F.when(F.col("kind") == "row", line),
        # A day of its own forgets the time before it.
        "clock": F.when(F.col("kind") == "clock", clock).when(F.col("kind") == "day", ""),
        "piece": F.when(F.col("kind") == "text", line).when(F.col("kind") == "row", full(F.trim(F.regexp_extract(line, rf"^(.*?){DATE}", 1)))),
    })
    found = own.groupBy(*KEY).agg(
        F.max("page").alias("page"), F.max("row").alias("raw_text"), F.max("near").alias("near"), last_of("day").alias("day"), last_of("clock").alias("clock"), in_order("piece").alias("said")
    )
    found = found.where("raw_text is not null").withColumn("clock", F.coalesce(full(F.col("clock")), "near"))
    found = found.withColumn("operation_at", at(F.coalesce("day", "raw_text"), F.col("clock"))).where("operation_at is not null")
    found = found.withColumn("signed", parsed_money(F.get(tokens(F.col("raw_text")), 0))).withColumn("direction", way(F.col("signed")))
    found = found.withColumn("description", rewritten(F.lit("yandex"), F.col("said"), F.col("direction")))
    category = F.when(F.col("description") == OWN_MOVE, "transfer").otherwise("")
    precision = F.when(F.col("clock").isNotNull(), "exact").otherwise("date_only")
    return shaped(found.withColumns({"posting_at": F.lit(None).cast("timestamp_ntz"), "reference": F.lit(""), "category": category, "timestamp_precision": precision}))


def ledger_records(pages: DataFrame) -> DataFrame:
    """Records that begin with a day; a time may stand in their text, and equal ones without a reference get one by their number."""
    line, low = F.col("line"), F.lower("line")
    noise = reduce(lambda a, b: a | b, (low.startswith(s) for s in NOISE_STARTS)) | low.isin(*NOISE) | low.contains("входящий остаток")
    noise = noise | line.rlike(r"^/[0-9]+\s+[0-9]+$") | line.rlike(rf"^{DAY}\s*\|\s*[0-9]{{2}}:[0-9]{{2}}$")
    own = lines_of(pages).where(~noise).withColumn("begins", line.rlike(rf"^{DAY}\s+.+$"))
    own = own.withColumn("record", F.sum(F.col("begins").cast("int")).over(in_file())).where("record > 0")
    own = own.withColumn("rest", F.when(F.col("begins"), F.regexp_extract(line, rf"^{DAY}\s+(.+)$", 1)))
    own = own.withColumn("day", F.last(F.when(F.col("begins"), F.left(line, F.lit(10))), True).over(in_file()))
    inline = full(F.regexp_extract("rest", rf"\b{CLOCK}\b", 0))
    hidden = full(F.expr(rf"regexp_extract(line, concat('(?:^|\\s)', replace(day, '.', '[.]'), '\\s+({CLOCK})\\b'), 1)"))
    piece = F.when(F.col("begins"), F.col("rest")).when(~line.rlike(rf"^{MONEY}$"), line)
    own = own.withColumns({"inline": inline, "hidden": hidden, "piece": piece})
    found = own.groupBy(*KEY).agg(
        F.min(F.struct(*PLACE))["page"].alias("page"), F.max("day").alias("day"), F.max("inline").alias("inline"), first_of("hidden").alias("hidden"),
        in_order("line").alias("raw_text"), in_order("piece").alias("said"),
    )
    found = found.withColumn("clock", F.coalesce("inline", "hidden")).withColumn("operation_at", at(F.col("day"), F.col("clock")))
    found = found.withColumn("signed", parsed_money(F.get(tokens(F.col("raw_text")), 0))).where("operation_at is not null and signed is not null")
    found = found.withColumn("said", without_money(F.col("said"))).withColumn("direction", way(F.col("signed")))
    said = F.lower("said")
    category = F.when(any_of(said, ("перевод", "сбп", "sbp")), "transfer").when(said.contains("зарплат"), "salary").when(any_of(said, ("кешбэк", "поощрен")), "cashback").otherwise("")
    found = found.withColumns({
        "category": category, "description": F.coalesce(full(F.col("said")), "raw_text"), "posting_at": F.lit(None).cast("timestamp_ntz"),
        "named": F.regexp_extract("raw_text", r"(?iu)код\s+операции\s+([A-Za-z0-9]+)", 1),
        "timestamp_precision": F.when(F.col("clock").isNotNull(), "inferred").otherwise("date_only"),
    })
    parts = [F.date_format("operation_at", "yyyy-MM-dd'T'HH:mm:ss"), F.col("direction"), F.abs("signed").cast("string"), F.col("category"), spaced(F.col("description"))]
    found = found.withColumn("same", F.concat_ws("|", F.lit("spbdup"), *parts))
    group = Window.partitionBy("file_name", "section", "same", F.col("named") == "")
    number, size = F.row_number().over(group.orderBy("record")), F.count("*").over(group)
    made = F.when(size > 1, F.left(F.sha1(F.concat_ws("|", "same", number.cast("string"))), F.lit(24))).otherwise("")
    return shaped(found.withColumn("reference", F.when(F.col("named") != "", F.col("named")).otherwise(made)))


def table_records(pages: DataFrame) -> DataFrame:
    """Records of a table of operations: a day begins one, and a day with a code goes on with the open one."""
    line, low = F.col("line"), F.lower("line")
    whole_file = Window.partitionBy("file_name")
    own = lines_of(pages).withColumn("account", F.bool_or(any_of(low, ("счет", "счёт"))).over(whole_file))
    own = own.withColumn("kind", statement_kind(F.col("file_name"), F.when(F.col("account"), "счёт").otherwise("")))
    own = own.withColumn("table", any_of(low, TABLE)).withColumn("within", F.bool_or("table").over(in_file())).where("within and not table")
    own = own.where(~(reduce(lambda a, b: a | b, (low.startswith(s) for s in TABLE_STARTS)) | low.isin(*TABLE_WORDS) | low.contains("страница")))
    coded, dated = line.rlike(rf"^{DAY}\s+{AUTH}"), line.rlike(rf"^{DAY}\s+.+$")
    own = own.withColumn("valid", dated & parsed_date(line).isNotNull()).withColumn("coded", coded).withColumn("plain", dated & ~coded)
    # No record is open before the first or after an impossible day, until a line with a possible one.
    own = own.withColumn("run", F.sum(F.col("plain").cast("int")).over(in_file()))
    open_ = F.coalesce(F.bool_or("valid").over(before("run")), F.lit(False))
    own = own.withColumn("begins", F.col("plain") | (F.col("coded") & ~open_))
    own = own.withColumn("record", F.sum(F.col("begins").cast("int")).over(in_file())).where("record > 0")
    rest = F.when(F.col("begins"), F.regexp_extract(line, rf"^{DAY}\s+(.+)$", 1))
    goes_on = rf"^({DATE})\s+[.,;]*({AUTH})[.,;]*(?:\s+(.*))?$"
    slashed = line.rlike(goes_on) & ~dated
    more = F.when(F.col("coded") & ~F.col("begins"), 1).when(slashed, 2)
    part = lambda a, b: F.when(more == 1, F.regexp_extract(line, rf"^({DAY})\s+({AUTH})\s*(.*)$", a)).when(more == 2, F.regexp_extract(line, goes_on, b))
    words = F.when(more.isNotNull(), full(part(3, 3))).when(line.rlike(LETTERS) & ~low.contains(NEXT_PAGE.lower()), line)
    own = own.withColumns({
        "at": F.when(F.col("begins"), at(line, F.regexp_extract(rest, CLOCK, 0))), "clock": F.when(F.col("begins"), F.regexp_extract(rest, rf"\b{CLOCK}\b", 0)),
        "posted": parsed_date(part(1, 1)), "code": part(2, 2), "piece": F.when(F.col("begins"), rest).otherwise(words),
    })
    found = own.groupBy(*KEY).agg(
        F.min(F.struct(*PLACE))["page"].alias("page"), F.max("kind").alias("kind"), F.max("at").alias("operation_at"), F.max("clock").alias("clock"), last_of("posted").alias("posting_at"),
        last_of("code").alias("code"), in_order("line").alias("raw_text"), in_order("piece").alias("said"),
    )
    found = found.withColumn("raw_text", F.trim(F.replace("raw_text", F.lit(NEXT_PAGE), F.lit("")))).withColumn("token", F.get(tokens(F.col("raw_text")), 0))
    found = found.where("operation_at is not null and token is not null").withColumn("signed", parsed_money(F.col("token")))
    raw = F.lower("raw_text")
    told = F.when(any_of(raw, OUT_WORDS), "out").when(any_of(raw, IN_WORDS), "in").otherwise("out")
    unsigned = (F.col("kind") == "card") & ~F.col("token").rlike(r"^[+\-–−]") & (F.col("signed") != 0)
    found = found.withColumn("direction", F.when(unsigned, told).otherwise(way(F.col("signed"))))
    found = found.withColumn("description", spaced(rewritten(F.lit("sber"), F.col("said"), F.col("direction"))))
    both = F.lower(F.concat_ws(" ", "description", "raw_text"))
    category = (
        F.when(both.contains("возврат") & both.contains("qr"), "refund").when(any_of(both, ("перевод", "сбп", "sbp")), "transfer")
        .when((F.col("kind") != "card") & any_of(both, ("к/с", "корреспондирующ")), "transfer").when(any_of(both, ("заработная плата", "зарплат")), "salary")
        .when(any_of(both, ("кешбэк", "кэшбэк")), "cashback").otherwise("")
    )
    reference = F.coalesce(full(F.col("code")), F.regexp_extract("raw_text", r"№\s*([0-9][0-9\-]{5,})", 1))
    precision = F.when(F.col("clock") != "", "exact").otherwise("date_only")
    return shaped(found.withColumns({"category": category, "reference": reference, "timestamp_precision": precision}))


LAYOUTS = {"ozon": wallet_records, "yandex": contract_records, "spb": ledger_records, "sber": table_records}


def records_of(provider: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = Ledger(spark, sf_dir).statement_pages
    return LAYOUTS[provider](pages.where(F.col("provider") == provider))


@register("ozon_records", duck(layout_sql.wallet(CREDITED, REMAINDER, PAYEES)))
def ozon_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_of("ozon", spark, sf_dir)


@register("yandex_records", duck(layout_sql.contract(CONTRACT, HEADS, HEAD_PARTS, OWN_MOVE)))
def yandex_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_of("yandex", spark, sf_dir)


@register("spb_records", duck(layout_sql.ledger(NOISE_STARTS, NOISE)))
def spb_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_of("spb", spark, sf_dir)


@register("sber_records", duck(layout_sql.table(TABLE, TABLE_STARTS, TABLE_WORDS, NEXT_PAGE, OUT_WORDS, IN_WORDS)))
def sber_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_of("sber", spark, sf_dir)
