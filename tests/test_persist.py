import hashlib
import random
import re
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from ledgerloom.plans.imports import keyed, known_keys
from ledgerloom.plans.persist import import_rows, imported
from ledgerloom.sources.ledger import Ledger

SF = "/root/testdata/sf0.001"
ROW = "statement_row_id string, statement_id string, place int, account_id string, key string, op timestamp, post timestamp, amount decimal(14,2), currency string, direction string, description string, merchant string, reference string, bank_category string, precision string, review_status string"
TX = "id string, account_id string, dedup_key string, operation_datetime timestamp, posting_datetime timestamp, amount decimal(14,2), currency string, direction string, description_raw string, merchant_normalized string, bank_reference_id string, timestamp_precision string"
LINK = "transaction_id string, statement_row_id string"


def squeezed(s):
    return re.sub(r"\s+", " ", s or "").strip().lower()


def reference(s):
    low = (s or "").strip().lower()
    return "" if re.fullmatch("[0-9a-f]{24}", low) else re.sub(r"[^a-z0-9]", "", low)


def words(*texts):
    return {w for w in re.split(r"[^a-zа-яё0-9]+", " ".join(t or "" for t in texts).lower()) if len(w) >= 3 and not w.isdigit()}


def look(c, e):
    """(score, auto, review) of a candidate and a transaction, or None; both are (times, description, merchant, reference, precision)."""
    pairs = [(abs((a.date() - b.date()).days), abs((a.replace(microsecond=0) - b.replace(microsecond=0)).total_seconds())) for a in c[0] for b in e[0]]
    if not pairs or min(p[0] for p in pairs) > 2:
        return None
    days, seconds = min(p[0] for p in pairs), min(p[1] for p in pairs)
    cr, er = reference(c[3]), reference(e[3])
    kind = "none" if not cr or not er else "match" if cr == er else "partial" if min(len(cr), len(er)) >= 6 and (cr in er or er in cr) else "mismatch"
    named = squeezed(c[2]) != "" and squeezed(c[2]) == squeezed(e[2])
    a, b = words(c[1], c[2]), words(e[1], e[2])
    least = min(len(a), len(b))
    sim = 0.0 if least == 0 else len(a & b) / (len(a | b) if least < 2 else least)
    in_time = seconds <= (36 if "date_only" in (c[4], e[4]) else 3) * 3600
    if kind == "match":
        score, auto = 1.0 - days * 0.05, True
    else:
        score = min(1.0, sim + 0.05) if named and sim > 0 else sim
        if named and days <= 1 and kind != "mismatch":
            auto = sim >= 0.6 and (days > 0 or in_time)
        else:
            auto = days == 0 and in_time and sim >= 0.9 and kind != "mismatch"
    return score, auto, kind in ("match", "partial") or sim >= 0.5


def plain(rows, transactions):
    """Statement after statement, row after row."""
    pool, by_key = {}, {}
    for t in transactions:
        group = (t["account_id"] or "", t["amount"], t["currency"], t["direction"])
        times = [x for x in (t["operation_datetime"], t["posting_datetime"]) if x]
        pool.setdefault(group, []).append((t["id"], (times, t["description_raw"], t["merchant_normalized"], t["bank_reference_id"], t["timestamp_precision"])))
        if t["dedup_key"] is not None:
            at = (t["account_id"] or "", t["dedup_key"])
            by_key[at] = min(by_key.get(at, t["id"]), t["id"])
    links, made, exceptions = {}, {}, {}
    sheets = {}
    for r in rows:
        sheets.setdefault((r["place"], r["statement_id"]), []).append(r)
    for _, own in sorted(sheets.items(), key=lambda x: x[0]):
        found, new = {}, []
        for r in sorted(own, key=lambda r: r["statement_row_id"]):
            at = (r["account_id"] or "", r["key"])
            if at in by_key or at in found:
                links[r["statement_row_id"]] = by_key.get(at) or found[at]
                continue
            c = ([x for x in (r["op"], r["post"]) if x], r["description"], r["merchant"], r["reference"], r["precision"])
            group = (at[0], r["amount"], r["currency"], r["direction"])
            seen = [(told, i) for i, e in pool.get(group, []) if (told := look(c, e))]
            autos = sorted((-s, i) for (s, auto, _), i in seen if auto)
            reviews = sorted((-s, i) for (s, _, review), i in seen if review)[:5]
            if autos and -autos[0][0] - (-autos[1][0] if len(autos) > 1 else 0.0) >= 0.1:
                found[at] = autos[0][1]
            else:
                found[at] = "tx_" + hashlib.sha256("|".join(at).encode()).hexdigest()[:24]
                new.append((at, found[at], group, c))
                made[found[at]] = bool(reviews)
                if reviews:
                    exceptions[found[at]] = {i for _, i in reviews}
            links[r["statement_row_id"]] = found[at]
        for at, i, group, c in new:
            pool.setdefault(group, []).append((i, c))
            by_key[at] = i
    return links, made, exceptions


def compare(rows, transactions, out):
    links, made, exceptions = plain(rows, transactions)
    assert {r["statement_row_id"]: r["transaction_id"] for r in out.links.collect()} == links
    assert {t["id"]: t["review_status"] == "needs_review" for t in out.transactions.collect()} == made
    assert {e["entity_id"]: {m.rsplit(":", 1)[0] for m in e["matches"].split(",")} for e in out.exceptions.collect()} == exceptions
    counts = out.counts.collect()
    total = lambda c: sum(r[c] for r in counts)
    assert (total("n_rows"), total("n_created"), total("n_exceptions")) == (len(rows), len(made), len(exceptions))
    return made, exceptions, {v["verdict"] for v in out.visits.collect()}


def random_rows(rng, n, sheets):
    rows, seen = [], {}
    for i in range(n):
        at = datetime(2024, 1, 1) + timedelta(days=rng.randrange(6), hours=rng.randrange(0, 24, 2))
        parts = (rng.choice(["a", "b", None]), rng.choice([at, at, None]), rng.choice([None, None, at + timedelta(days=1)]), rng.choice(["5.00", "7.50"]), rng.choice(["coffee shop north", "coffee shop", "taxi ride", ""]), rng.choice(["", "", "REF 12345", "12345", "ab"]))
        key = seen.setdefault(parts, f"k{len(seen)}")
        sheet = rng.randrange(sheets)
        rows.append({
            "statement_row_id": f"r{i:03}", "statement_id": f"s{sheet}", "place": sheet // 2, "account_id": parts[0], "key": key, "op": parts[1], "post": parts[2], "amount": parts[3], "currency": "RUB", "direction": "out",
            "description": parts[4], "merchant": rng.choice(["", "Cafe", "cafe "]), "reference": parts[5], "bank_category": "", "precision": rng.choice(["exact", "date_only"]), "review_status": "reviewed",
        })
    return rows


def frame(spark, rows, schema):
    names = [c.strip().split(" ")[0] for c in schema.replace("decimal(14,2)", "decimal").split(",")]
    return spark.createDataFrame([tuple(Decimal(r[c]) if c == "amount" else r[c] for c in names) for r in rows], schema)


@pytest.mark.parametrize("seed", range(3))
def test_against_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = random_rows(rng, 70, 6)
    stored = [
        {"id": f"t{i}", "account_id": r["account_id"], "dedup_key": rng.choice([None, r["key"]]), "operation_datetime": r["op"], "posting_datetime": r["post"], "amount": r["amount"], "currency": "RUB", "direction": "out",
         "description_raw": rng.choice([r["description"], "coffee"]), "merchant_normalized": r["merchant"], "bank_reference_id": r["reference"], "timestamp_precision": "exact"}
        for i, r in enumerate(random_rows(rng, 8, 1))
    ]
    # A stored key may be that of any row.
    for t in stored:
        t["dedup_key"] = t["dedup_key"] and rng.choice(rows)["key"]
    df, none = frame(spark, rows, ROW), spark.createDataFrame([], LINK)
    out = import_rows(df, frame(spark, stored, TX), none)
    _, _, verdicts = compare(rows, stored, out)
    assert {"known", "overlap", "created"} <= verdicts

    # What was made is stored: the same import makes nothing and links nothing anew.
    after = frame(spark, stored, TX).unionByName(out.transactions.select(*[c.strip().split(" ")[0] for c in TX.replace("decimal(14,2)", "decimal").split(",")]))
    made = {t["dedup_key"] for t in out.transactions.collect()}
    again = import_rows(df.where(df.key.isin(list(made))), after, out.links)
    assert again.transactions.isEmpty() and again.links.isEmpty() and again.exceptions.isEmpty()


def test_chain_of_statements(spark):
    """An unclear row of the third statement meets what the first and second made; the fourth knows the key."""
    at = datetime(2024, 3, 1, 10)
    row = lambda i, sheet, key, hours, merchant, text: {
        "statement_row_id": i, "statement_id": sheet, "place": int(sheet[1:]), "account_id": "a", "key": key, "op": at + timedelta(hours=hours), "post": None, "amount": "9.00", "currency": "RUB", "direction": "out",
        "description": text, "merchant": merchant, "reference": "", "bank_category": "", "precision": "exact", "review_status": "reviewed",
    }
    rows = [row("r1", "s1", "k1", 0, "", "coffee north"), row("r2", "s2", "k2", 1, "", "coffee south"), row("r3", "s3", "k3", 2, "", "coffee west"), row("r4", "s4", "k3", 2, "", "coffee west"), row("r5", "s4", "k5", 1, "", "coffee north")]
    out = import_rows(frame(spark, rows, ROW), spark.createDataFrame([], TX), spark.createDataFrame([], LINK))
    verdicts = {v["visit"]: v["verdict"] for v in out.visits.collect()}
    assert verdicts == {"r1": "created", "r2": "unclear", "r3": "unclear", "r4": "known", "r5": "overlap"}
    links = {r["statement_row_id"]: r["transaction_id"] for r in out.links.collect()}
    assert links["r5"] == links["r1"] and links["r4"] == links["r3"] and len(set(links.values())) == 3


def test_empty(spark):
    out = import_rows(spark.createDataFrame([], ROW), spark.createDataFrame([], TX), spark.createDataFrame([], LINK))
    assert all(df.isEmpty() for df in out)


def test_ledger(spark):
    out = imported(spark, SF)
    rows = keyed(spark, SF)
    keys = {r["tx_id"][:11]: r["key"] for r in known_keys(rows).collect()}
    stored = [t.asDict() | {"dedup_key": keys.get(t["id"])} for t in Ledger(spark, SF).transactions.collect()]
    sheets = [r.asDict() | {"place": 9 if r["statement_id"].endswith("_ov") else int(r["statement_id"][-1])} for r in rows.collect()]
    made, _, _ = compare(sheets, stored, out)
    assert made
