"""Literal values of the ledger's rules, where a query and its SQL could share an error."""

import json
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerloom.functions.columns import lens
from ledgerloom.plans import imports as I
from ledgerloom.plans import networth
from ledgerloom.plans import rules as R
from ledgerloom.plans import statements as S
from ledgerloom.plans.audit import quality_report
from ledgerloom.plans.quality import core_metrics
from ledgerloom.plans.review import masked, reviewed_for, safe_name
from ledgerloom.sources.files import read_delimited, write_report

SF = "/root/testdata/sf0.001"
TX = "meaning string, direction string, bank_category string, bank_reference_id string, amount decimal(14,2), description_raw string"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_strict_lens_excuses_a_fee_only_with_the_whole_place(spark):
    fee = 'Комиссия за оказание услуги "Перевод с карты на карту" '
    said = [fee + "SANKT-PE, SANKT-PETERBURG, RU", fee + "SANKT-PETERBURG, RU", "Перевод денежных средств через интернет-банк", "Перевод денежных средств, Иван И", "Зачисление к/с"]
    df = spark.createDataFrame([(None, "out", None, None, None, s) for s in said], TX)
    assert [r[0] for r in df.select(lens("strict_transfer_like")).collect()] == [False, True, False, True, True]
    told = df.select(lens("strict_transfer_like", narratives=("%перевод денежных средств, иван%",))).collect()
    assert [r[0] for r in told] == [False, True, False, False, True]


def test_merchants_and_counterparties(spark):
    label = lambda d, way, bank="shop": spark.createDataFrame([(d, way, bank)], "d string, w string, b string").select(S.merchant_label(F.col("d"), F.col("b"), F.col("w"))).first()[0]
    assert label("Отправитель: Иван Иванов, договор", "in") == "Иван Иванов"
    assert label("Входящий перевод СБП, Пётр П., сумма", "in") == "Пётр П"
    assert label("Зачисление к/с 1234567890", "in") == "Зачисление к/с"
    assert label("Перевод клиенту", "out") == ""
    assert label("Получатель: Магазин Книг; чек", "out") == "Магазин Книг"
    assert label("Оплата товаров по карте YM*TAXI 1234567", "out") == "YM*TAXI"
    assert label("Покупка Кофейня ****1234 дата 01", "out") == "Кофейня"
    assert label("1234567", "out", "cafe") == "cafe"
    assert label(None, "out") == ""


def test_dates_and_times(spark):
    day = lambda s: one(spark, S.parsed_date, s)
    assert day("x 01/02/2024 y") == datetime(2024, 2, 1) and day("31.02.2024") is None and day("none") is None
    assert one(spark, S.parsed_time, "at 23:59:59") == 86399 and one(spark, S.parsed_time, "at 24:00") is None


def test_names_and_masks(spark):
    assert one(spark, masked, "Acct 12-34 5678") == "****5678" and one(spark, masked, "12") == "****12" and one(spark, masked, "none") == "" and one(spark, masked, None) == ""
    assert one(spark, safe_name, "../a b/Отчёт 1.pdf") == "1.pdf" and one(spark, safe_name, "..") == "statement.pdf" and one(spark, safe_name, "x" * 200 + ".pdf") == "x" * 156 + ".pdf"


def test_rows_of_one_statement_that_are_equal_get_references(spark):
    at = datetime(2024, 1, 2, 3, 4, 5)
    row = lambda i, ref="", text="Same  Text": (i, "st", "acc", at, None, Decimal("5.00"), "RUB", "out", text, "", ref, "", text)
    columns = "statement_row_id string, statement_id string, account_id string, op timestamp_ntz, post timestamp_ntz, amount decimal(14,2), currency string, direction string, description string, merchant string, reference string, bank_category string, raw_text string"
    rows = spark.createDataFrame([row("2"), row("1"), row("3", "REF"), row("4", text="other"), row("5", "  ", "same text")], columns)
    refs = {r["statement_row_id"]: r["reference"] for r in I.with_references(rows).collect()}
    assert refs["3"] == "REF" and refs["4"] == "" and len({refs["1"], refs["2"], refs["5"]}) == 3 and all(len(refs[k]) == 24 for k in "125")
    keys = [r[0] for r in I.with_references(rows).select(I.fingerprint()).collect()]
    assert len(set(keys)) == 5


def test_likeness_of_words(spark):
    sim = lambda a, b: spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(I.similarity(F.col("a"), F.col("b"))).first()[0]
    assert sim([], ["x"]) == 0.0 and sim(["x"], ["x", "y"]) == 0.5 and sim(["x", "y"], ["x", "y", "z"]) == 1.0


def test_tags_fold_in_the_order_of_rules(spark):
    hits = [
        {"put": None, "add": ["b"], "remove": None}, {"put": ["x", "y"], "add": None, "remove": ["y"]},
        {"put": ["z"], "add": ["x", "w"], "remove": None}, {"put": None, "add": None, "remove": ["a", "w"]},
    ]
    kind = "tags array<string>, hits array<struct<put: array<string>, add: array<string>, remove: array<string>>>"
    row = spark.createDataFrame([(["a"], hits)], kind).select(R.folded_tags(F.col("tags"), F.col("hits"))).first()[0]
    assert row == ["x"]


def test_an_unknown_reason_needs_no_review(spark):
    columns = "id long, category string, meaning string, bank_category string, direction string, merchant_normalized string"
    tx = spark.createDataFrame([(1, "", "unknown", "", "out", ""), (2, "Food", "unknown", "", "out", "")], columns)
    ids = lambda **k: [r["id"] for r in reviewed_for(tx, **k).collect()]
    assert ids() == [1] and ids(needs=False) == [2] and ids(reason="other") == [] and ids(needs=False, reason="other") == [1, 2]


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('﻿id,text,empty\n1,"a ""b"", c",\n2,"x\ny",z\n', encoding="utf-8")
    table = read_delimited(spark, str(tmp_path / "t.csv"))
    assert table.columns == ["id", "text", "empty"] and sorted(map(tuple, table.collect())) == [("1", 'a "b", c', ""), ("2", "x\ny", "z")]
    write_report(table.where("id = '1'"), str(tmp_path / "report"))
    (line,) = spark.read.text(str(tmp_path / "report")).collect()
    assert json.loads(line[0]) == {"id": "1", "text": 'a "b", c', "empty": ""}


def test_the_report_holds_the_measures(spark):
    report = json.loads(quality_report(spark, SF).first()["report"])
    core = core_metrics(spark, SF).first().asDict()
    assert {k: float(v) for k, v in core.items()} == {k: float(report[k]) for k in core}


def test_net_worth_between_two_times(spark):
    said = [("a", 1, "10"), ("a", 5, "20"), ("b", 3, "5"), ("b", 9, "1")]
    text = " union all ".join(
        f"select '{a}' as account_id, 's{d}' as statement_id, timestamp_ntz '2024-01-0{d} 00:00:00' as ts, cast({x} as decimal(14,2)) as balance, 'other' as method, 'RUB' as currency" for a, d, x in said
    )
    snapshots = spark.sql(text)
    start, end = "2024-01-02 12:00:00", "2024-01-06 00:00:00"
    raw = sorted((str(r["ts"]), float(r["total"]), r["n_known"]) for r in networth.raw_between(snapshots, start, end).collect())
    assert raw == [(start, 10.0, 1), ("2024-01-03 00:00:00", 15.0, 2), ("2024-01-05 00:00:00", 25.0, 2)]
    days = [(r["bucket"], float(r["total"]), r["n_known"]) for r in networth.timeline(snapshots, "day", start, end).orderBy("bucket").collect()]
    assert days == [("2024-01-02", 10.0, 1), ("2024-01-03", 15.0, 2), ("2024-01-04", 15.0, 2), ("2024-01-05", 25.0, 2), ("2024-01-06", 25.0, 2)]
    last = networth.timeline(snapshots, "day", start, end).orderBy(F.desc("bucket")).first()["at"]
    assert str(last) == end and networth.raw_between(snapshots, "2023-01-01", "2023-02-01").collect() == []
    late = networth.timeline(snapshots, "month", "2024-03-01").collect()
    assert [(r["bucket"], float(r["total"])) for r in late] == [("2024-03-01", 21.0)]


def test_rules_applied(spark):
    """Rows that change are written whole, all others stay as they are, null fields and odd tags too."""
    schema = "id string, description_raw string, merchant_normalized string, bank_category string, category string, meaning string, review_status string, direction string, currency string, amount decimal(14,2), tag_list string"
    row = lambda i, text, category=None, meaning=None, review=None, tags=None: (i, text, None, None, category, meaning, review, "out", "RUB", None, tags)
    tx = spark.createDataFrame([row("a", "Coffee", tags="x, x,old"), row("b", "tea", tags=" y,,y"), row("c", "coffee", meaning="internal_transfer"), row("d", None), row("e", "coffee", "Food", "spend", "reviewed", "new")], schema)
    rule = {c: None for c in (*R.CONDITIONS, "set_category", "set_meaning", "set_review_status", "set_tags", "add_tags", "remove_tags")} | {"id": "r", "pattern": "coffee"}
    rules = [Row(**(rule | {"set_category": "Food", "set_meaning": "spend", "add_tags": "new", "remove_tags": "old,x"}))]
    got = {r["id"]: (r["category"], r["meaning"], r["review_status"], r["tag_list"], r["updated"]) for r in R.applied(tx, rules).collect()}
    assert got["a"] == ("Food", "spend", "reviewed", "new", True)
    assert got["b"] == (None, None, None, " y,,y", False) and got["d"] == (None, None, None, None, False)
    assert got["c"] == (None, "internal_transfer", None, None, False) and got["e"] == ("Food", "spend", "reviewed", "new", False)
    every = {r["id"]: r["updated"] for r in R.applied(tx, rules, include_transfers=True).collect()}
    assert every == {"a": True, "b": False, "c": True, "d": False, "e": False}
    gone = [Row(**(rule | {"id": "g", "remove_tags": "x,old"}))]
    assert {r["id"]: r["tag_list"] for r in R.applied(tx, gone).collect()}["a"] is None
