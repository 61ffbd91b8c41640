"""Column expressions of the ledger: times, lenses, review, texts, money."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases by which bank texts are told to be transfers.
HIGH_IN = ("%перевод сбп%", "%через сбп%", "%зачисление к/с%", "%отправитель:%")
HIGH_OUT = ("%перевод для%",)
HIGH_LEAST_IN, HIGH_LEAST_OUT = "185.00", "50.00"
LIST_HINTS = ("%перевод%", "%сбп%", "%sbp%", "%между своими%", "%собственн%", "%transfer%", "%between accounts%", "%p2p%")
STRICT_FLOWS = ("%списание к/с%", "%зачисление к/с%")
STRICT_HINTS = ("%перевод%", "%между своими%", "%собственн%", "%transfer%", "%between accounts%", "%p2p%", "%платеж сбп%")
STRICT_EXCEPTIONS = (("%перевод денежных средств%", "%интернет-банк%"), ('%комиссия за оказание услуги "перевод с карты на карту"%', "%sankt-pe, sankt-peterburg, ru%"))
# Meanings.
TRANSFERS = ("internal_transfer", "external_transfer")
OBVIOUS_OUT, OBVIOUS_IN = ("spend", "fee"), ("income", "refund", "cashback", "interest")


def text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def folded(name: str) -> Column:
    return F.lower(F.trim(text(name)))


def blank(name: str) -> Column:
    return F.length(F.trim(text(name))) == 0


def any_like(value: Column, patterns: Sequence[str]) -> Column:
    return reduce(or_, (value.like(p) for p in patterns))


def event_time() -> Column:
    """When a transaction counts in cash flow."""
    return F.coalesce("operation_datetime", "created_at")


def ledger_time() -> Column:
    return F.coalesce("operation_datetime", "posting_datetime", "created_at")


def lens(name: str, narratives: Sequence[str] = ()) -> Column:
    """True for the transactions that a cash-flow lens leaves out; unknown names are the internal lens.

    ``narratives`` are further patterns of descriptions that the strict lens excuses, such as those that name a person.
    """
    meaning, description = text("meaning"), F.lower(text("description_raw"))
    internal = meaning == TRANSFERS[0]
    marked = meaning.isin(*TRANSFERS)
    if name == "high_confidence_transfer_like":
        incoming = text("direction") == "in"
        amount = F.coalesce(F.col("amount"), F.lit(0).cast("decimal(14,2)"))
        enough_in = incoming & (amount >= F.lit(HIGH_LEAST_IN).cast("decimal(14,2)")) & any_like(description, HIGH_IN)
        enough_out = ~incoming & (amount >= F.lit(HIGH_LEAST_OUT).cast("decimal(14,2)")) & any_like(description, HIGH_OUT)
        return marked | ((F.lower(text("bank_category")) == "transfer") & (text("bank_reference_id") != "") & (enough_in | enough_out))
    if name == "strict_transfer_like":
        excused = reduce(or_, [*(description.like(a) & description.like(b) for a, b in STRICT_EXCEPTIONS), *(description.like(p) for p in narratives)])
        return marked | any_like(description, STRICT_FLOWS) | (any_like(description, STRICT_HINTS) & ~excused)
    if name == "strict_list":
        return (meaning == TRANSFERS[1]) | (F.lower(text("bank_category")) == "transfer") | any_like(description, LIST_HINTS)
    return internal


def needs_review() -> Column:
    """An uncategorised transaction that nothing else explains."""
    direction, meaning, bank = folded("direction"), folded("meaning"), folded("bank_category")
    merchant = F.length(folded("merchant_normalized")) > 0
    other_bank = (F.length(bank) > 0) & (bank != "transfer")
    explained = merchant | other_bank
    transfer = meaning.isin(*TRANSFERS) | (bank == "transfer")
    bought = (direction == "out") & merchant & (bank != "transfer")
    out = (direction == "out") & meaning.isin(*OBVIOUS_OUT) & explained
    into = (direction == "in") & meaning.isin(*OBVIOUS_IN) & explained
    return blank("category") & ~transfer & ~bought & ~out & ~into


def money(value: Column) -> Column:
    return value.cast("decimal(20,2)")


def cents(amount: Column) -> Column:
    return (F.bround(amount, 2) * 100).cast("bigint")


def iso(time: Column) -> Column:
    return F.coalesce(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def squeezed(value: Column) -> Column:
    """Lower case, white space as single spaces, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")))


def total(value: Column, when: Column) -> Column:
    return money(F.coalesce(F.sum(F.when(when, value)), F.lit(0)))


def percentile_index(values: Column, share: float) -> Column:
    """The value at the lower index of a share of the sorted values."""
    return F.element_at(F.array_sort(values), F.floor((F.size(values) - 1) * F.lit(share)).cast("int") + 1)
