"""Literal records of the four statement layouts: what begins a record, what belongs to it, what is left out."""

import hashlib
from datetime import datetime
from decimal import Decimal

from ledgerloom.plans import layouts as L


def read(spark, layout, *pages, file_name="in.pdf"):
    frame = spark.createDataFrame([(file_name, k, p) for k, p in enumerate(pages, 1)], "file_name string, page int, text string")
    return layout(frame).orderBy("section", "row_index").collect()


def cells(rows, *names):
    return [tuple(r[n] for n in names) for r in rows]


def test_wallet_records(spark):
    rows = read(
        spark,
        L.wallet_records,
        "10.01.2024 09:00 5 Раньше −1,00 ₽",
        "Справка о движении средств\n  10.01.2024 09:15:07 77 Заказ 12 345,60\n− 1 234,50 ₽\n\nдоставка\n11.01.2024\n10:00 78\nЗачисление + 5,00 ₽",
        "31.02.2024 10:00 79 нет дня 9,00\nничьё 8,00\n12.01.2024 25:61 80 Перевод АО \"ТАНДЕР\" через СБП. чай −7,00 ₽\n13.01.2024\nслово\n10:30 81\n14.01.2024 10:00 82 без суммы",
        None,
        "Справка о движении средств\n10:00 83 время без дня\n15.01.2024 10:00 84 сумма 0,00",
    )
    assert cells(rows, "section", "row_index", "page", "reference", "amount", "direction") == [
        (1, 0, 2, "77", Decimal("1234.50"), "out"),
        (1, 1, 2, "78", Decimal("5.00"), "in"),
        (1, 2, 3, "80", Decimal("7.00"), "out"),
        (2, 0, 5, "84", Decimal("0.00"), "out"),
    ]
    assert [r["operation_at"] for r in rows] == [datetime(2024, 1, 10, 9, 15, 7), datetime(2024, 1, 11, 10), datetime(2024, 1, 12), datetime(2024, 1, 15, 10)]
    assert [r["description"] for r in rows] == ["Заказ доставка", "Зачисление", 'Оплата АО "ТАНДЕР" чай слово', "сумма"]
    assert rows[1]["raw_text"] == "11.01.2024 10:00 78 Зачисление + 5,00 ₽"
    assert cells(read(spark, L.wallet_records, "10.01.2024 09:00 5 Одна −1,00 ₽", "ещё"), "section", "description") == [(1, "Одна ещё")]


def test_wallet_descriptions(spark):
    said = [
        ("Зачисление по переводу денежных средств по карте 6569 сумма из ALIFMOBI6 тест", "in", "Зачисление по зачислению денежных средств по карте 6569 сумма из ALIFMOBI6 тест"),
        ("Перевод остатка ЭДС в связи повышением уровня идентификации.", "in", "Зачисление остатка ЭДС в связи повышением уровня идентификации."),
        ('Перевод АО "ТАНДЕР"', "in", 'Перевод АО "ТАНДЕР"'),
        ("Перевод кому-то", "out", "Перевод кому-то"),
    ]
    df = spark.createDataFrame(said, "d string, w string, want string")
    assert [r[0] for r in df.select(L.renamed(df["d"], df["w"])).collect()] == [s[2] for s in said]


def test_contract_records(spark):
    rows = read(
        spark,
        L.contract_records,
        "Выписка по договору Исх. № 5\nОплата СБП QR\n09.01.2024\nв 08:15\nкафе 10.01.2024 −30,00 ₽ −30,00 ₽\nПеревод в 11:02:03\n11/01/2024 +5,00 ₽",
        "забыто\nСтраница 2\n12.01.2024\nв 07:00\n13.01.2024\nПеренос денежных средств с ЭДС\nна банковский счёт 14.01.2024 6,00 ₽\n31.02.2024\nнет дня 15.01.2024 7,00 ₽\nостаток 15.01.2024 8,00 ₽\nбез\nвремени\nсовсем\nникакого\n16.01.2024 9,00 ₽\nв конце",
    )
    assert cells(rows, "row_index", "page", "amount", "direction", "timestamp_precision", "category") == [
        (0, 1, Decimal("30.00"), "out", "exact", ""),
        (1, 1, Decimal("5.00"), "in", "exact", ""),
        (2, 2, Decimal("6.00"), "in", "exact", "transfer"),
        (3, 2, Decimal("9.00"), "in", "date_only", ""),
    ]
    # The last time of the five lines up to the record stands in where a later day forgot the one before.
    assert [r["operation_at"] for r in rows] == [datetime(2024, 1, 9, 8, 15), datetime(2024, 1, 11, 11, 2, 3), datetime(2024, 1, 13, 7), datetime(2024, 1, 16)]
    assert [r["description"] for r in rows] == [
        "Оплата QR кафе", "Перевод в 11:02:03", "Перенос денежных средств с ЭДС на банковский счёт", "остаток 15.01.2024 8,00 ₽ без времени совсем никакого",
    ]


def test_ledger_records(spark):
    rows = read(
        spark,
        L.ledger_records,
        "Выписка\nПериод: 01.01.2024 - 31.01.2024\nничьё 1,00\n10.01.2024 Перевод СБП\n−50,00\nкод операции A17\n10.01.2024 | 12:00\n/1 2",
        "11.01.2024 Зарплата 09:30 +10,00\n12.01.2024 Покупка 3,00\nчек 12.01.2024 14:05:06\n12.01.2024 Кешбэк 2,00\n12.01.2024 Кешбэк 2,00\n31.02.2024 нет дня 4,00\n13.01.2024 без суммы\n14.01.2024 9,00",
    )
    cashback = "spbdup|2024-01-12T00:00:00|in|2.00|cashback|Кешбэк|"
    assert cells(rows, "page", "amount", "direction", "description", "category", "reference", "timestamp_precision") == [
        (1, Decimal("50.00"), "out", "Перевод СБП код операции A17", "transfer", "A17", "date_only"),
        (2, Decimal("10.00"), "in", "Зарплата 09:30", "salary", "", "inferred"),
        (2, Decimal("3.00"), "in", "Покупка чек .2024 14:05:06", "", "", "inferred"),
        *[(2, Decimal("2.00"), "in", "Кешбэк", "cashback", hashlib.sha1(f"{cashback}{k}".encode()).hexdigest()[:24], "date_only") for k in (1, 2)],
        (2, Decimal("9.00"), "in", "14.01.2024 9,00", "", "", "date_only"),
    ]
    assert [r["operation_at"] for r in rows][:3] == [datetime(2024, 1, 10), datetime(2024, 1, 11, 9, 30), datetime(2024, 1, 12, 14, 5, 6)]


def test_table_records(spark):
    text = (
        "10.01.2024 раньше 1,00\nРасшифровка операций\nДАТА ОПЕРАЦИИ\n10.01.2024 09:15 Перевод от Пётр П. 500,00 1 500,00\n11.01.2024 123456 на карту\n01/02/2024 AB77. ещё\n77,00\n"
        "Продолжение на следующей странице\n12.01.2024 Возврат покупки по QR-коду СБП +40,00\n13.01.2024 Оплата № 12345678 на 60,00\nстраница 3 из 4\n"
        "31.02.2024 нет дня 1,00\nничьё\n14.01.2024 7890 открывает 8,00\n15.01.2024 4321 дальше"
    )
    rows = read(spark, L.table_records, text, file_name="card.pdf")
    assert cells(rows, "amount", "direction", "reference", "category", "timestamp_precision") == [
        (Decimal("500.00"), "in", "AB77", "transfer", "exact"),
        (Decimal("40.00"), "in", "", "refund", "date_only"),
        (Decimal("60.00"), "out", "12345678", "", "date_only"),
        (Decimal("8.00"), "out", "4321", "", "date_only"),
    ]
    assert [r["description"] for r in rows] == [
        "09:15 Перевод от Пётр П. 500,00 1 500,00 на карту ещё", "Возврат покупки по QR-коду +40,00", "Оплата № 12345678 на 60,00", "7890 открывает 8,00 дальше",
    ]
    assert [r["posting_at"] for r in rows] == [datetime(2024, 2, 1), None, None, datetime(2024, 1, 15)]
    assert NEXT not in rows[0]["raw_text"] and rows[0]["raw_text"].endswith("77,00")
    # Without a sign only the words of a card statement tell the direction.
    assert [r["direction"] for r in read(spark, L.table_records, text, file_name="deposit.pdf")] == ["in", "in", "in", "in"]


NEXT = L.NEXT_PAGE


def test_no_pages(spark):
    for layout in L.LAYOUTS.values():
        assert read(spark, layout, None, "") == []
