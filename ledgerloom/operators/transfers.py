"""Own transfers: pairs of an outflow and an inflow of two accounts, scored, assigned and judged."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import cents, ledger_time, text
from ledgerloom.operators.graph import components, written

# Words of transfers, of internal lanes, of plain debits, and words that name no counterparty.
HINT = r"(?iU)\bперевод\b|\bсбп\b|\bsbp\b|между\s+своими|собственн(?:ых|ые)\s+средств|\btransfer\b|between\s+accounts|\bp2p\b"
LANE = r"(?i)vklad[\s\-]?karta|karta[\s\-]?vklad"
GENERIC = r"(?iU)^\s*(?:списание|debit|withdrawal)\b"
STOPWORDS = (
    "перевод", "сбп", "sbp", "transfer", "between", "accounts", "между", "своими", "счет", "счета", "счетами", "списание", "зачисление",
    "incoming", "outgoing", "payment", "card", "карту", "карта", "карты", "своих", "funds", "own", "account", "from", "to",
)
#: Of these some may still tell a lane.
LANE_WORDS = ("карту", "карта", "карты", "своих", "funds", "own", "account")
LANE_STOPWORDS = tuple(w for w in STOPWORDS if w not in LANE_WORDS)
# Windows in seconds, fees, thresholds.
WINDOW_S, LONGEST_S, FEE_CENTS, FEE_SHARE = 2 * 86400, 5 * 86400, 1000, 200
VIABLE, AUTO, ONE_SIDED, RECURRENT, BY_LANE = 0.80, 0.92, 0.74, 0.84, 0.86
MARGIN, TIEBREAK_S, RECURRENT_N, ONE_SIDED_N, LANE_N = 0.05, 120.0, 15, 45, 3
#: Components up to these sizes are matched exactly, larger ones greedily by rank.
EXACT_SIDE, EXACT_EDGES = 10, 60
TOKEN = "[0-9a-zа-я]{3,}"
#: Windows of time, and cells of amounts, that a shuffled cell of candidates is wide.
WIDE = 4
#: What is told of a transaction's texts.
SAID = ("hint", "lane", "generic", "ref", "tokens", "words")
#: Lists of words that scores are made from; nothing later reads them.
LISTS = ("out_tokens", "in_tokens", "out_words", "in_words", "out_patterns", "in_patterns")


def tokens(value: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit(TOKEN), F.lit(0)))
    return F.array_except(found, F.array(*[F.lit(w) for w in STOPWORDS]))


def hint_text() -> Column:
    return F.trim(F.concat_ws(" ", text("description_raw"), text("bank_category")))


def said(direction: str) -> list[Column]:
    """What a transaction's texts say, each column named after its side."""
    out = {
        "hint": hint_text().rlike(HINT),
        "lane": text("description_raw").rlike(LANE),
        "generic": text("description_raw").rlike(GENERIC) & ~hint_text().rlike(HINT),
        "ref": F.lower(F.trim(text("bank_reference_id"))),
        "tokens": tokens(text("description_raw")),
        "words": tokens(hint_text()),
    }
    return [value.alias(f"{direction}_{name}") for name, value in out.items()]


def features(tx: DataFrame, direction: str) -> DataFrame:
    return tx.where(F.col("direction") == direction).select(F.col("id").alias(f"{direction}_id"), *said(direction))


def lane_delays(confirmed: DataFrame, share: float = 0.9) -> DataFrame:
    """(out_account, in_account, n, delay): of each lane's delays the one at the lower index of ``share``.

    Delays are counted before they are sorted: a lane sends its distinct delays, not its links.
    """
    lane = ["out_account", "in_account"]
    each = confirmed.groupBy(*lane, "delay").agg(F.count("*").alias("k"))
    so_far = F.sum("k").over(Window.partitionBy(*lane).orderBy("delay").rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("k").over(Window.partitionBy(*lane))
    reached = each.withColumns({"so_far": so_far, "n": n}).where(F.col("so_far") > F.floor((F.col("n") - 1) * F.lit(share)))
    return reached.groupBy(*lane).agg(F.max("n").alias("n"), F.min("delay").alias("delay"))


def lane_patterns(confirmed: DataFrame, side: str) -> DataFrame:
    """(out_account, in_account, token, n, place) of a side's texts: words that come twice, eight at most, or else the first three."""
    lane = ["out_account", "in_account"]
    found = F.regexp_extract_all(F.lower(f"{side}_text"), F.lit(TOKEN), F.lit(0))
    words = confirmed.select(*lane, F.explode(found).alias("token")).where(~F.col("token").isin(*LANE_STOPWORDS))
    counts = words.groupBy(*lane, "token").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*lane).orderBy(F.desc("n"), "token"))
    most = F.max("n").over(Window.partitionBy(*lane))
    ranked = counts.withColumns({"place": place, "most": most})
    return ranked.where(((F.col("n") >= 2) & (F.col("place") <= 8)) | ((F.col("most") < 2) & (F.col("place") <= 3))).drop("most")


def lane_priors(confirmed: DataFrame) -> DataFrame:
    """(out_account, in_account, lane_n, lane_s, window_s, out_patterns, in_patterns) of the lanes of confirmed links."""
    lane = ["out_account", "in_account"]
    late = F.greatest(F.lit(1800.0), F.col("delay"))
    window = F.greatest(F.lit(float(WINDOW_S)), F.least(late * 1.8 + 21600.0, F.lit(float(LONGEST_S))))
    out = lane_delays(confirmed).select(*lane, F.col("n").alias("lane_n"), late.alias("lane_s"), window.alias("window_s"))
    for side in ("out", "in"):
        words = lane_patterns(confirmed, side).groupBy(*lane).agg(F.collect_list("token").alias(f"{side}_patterns"))
        out = out.join(words, lane, "left")
    return out


def amount_cell(value: Column) -> Column:
    """Cells of which two amounts within the tolerance are the same or neighbours.

    The width follows the tolerance: one cent for small amounts, a share of middle ones, the largest fee of
    large ones; two amounts that may pair are less than 1.006 tolerances apart.
    """
    low, high = FEE_SHARE, FEE_CENTS * FEE_SHARE
    middle = low + FEE_SHARE * F.log(F.greatest(value, F.lit(low)) / F.lit(float(low)))
    large = low + FEE_SHARE * F.log(F.lit(high / low)) + (value - high) / F.lit(float(FEE_CENTS))
    at = F.when(value < low, value.cast("double")).when(value < high, middle).otherwise(large)
    return F.floor(at / 1.01)


def sides(tx: DataFrame, direction: str) -> DataFrame:
    at = F.unix_micros(ledger_time().cast("timestamp"))
    return tx.where((F.col("direction") == direction) & F.col("id").isNotNull() & ledger_time().isNotNull() & F.col("amount").isNotNull()).select(
        F.coalesce("currency", F.lit("RUB")).alias("currency"),
        F.col("id").alias(f"{direction}_id"),
        F.col("account_id").alias(f"{direction}_account"),
        at.alias(f"{direction}_us"),
        cents(F.col("amount")).alias(f"{direction}_cents"),
        *said(direction),
    )


def widest_window(lanes: DataFrame | None) -> float:
    """Seconds that two sides may be apart at most: one number for the whole ledger."""
    return float(WINDOW_S) if lanes is None else max(float(WINDOW_S), lanes.agg(F.max("window_s")).first()[0] or 0.0)


def candidates(tx: DataFrame, lanes: DataFrame | None = None, inflows: DataFrame | None = None) -> DataFrame:
    """Pairs near in time and amount, of two accounts and one currency; lanes may widen the window of time.

    Inflows are those of ``inflows`` if that is given, else of ``tx`` itself.

    An equality join on cells that are ``WIDE`` windows (the widest there is) of time and ``WIDE`` tolerances of amount
    wide, so an outflow goes to the cells at either end of its reach: one or two of each, 2.25 in all. Both sides are
    shuffled by cell with what their texts say (columns that nobody reads aren't); the side
    that was exploded is never sent whole to every task, so Spark may split a cell that holds too much. Pairs
    grow with the square of how dense transactions are, so they aren't shuffled again: lanes are the small side.
    """
    widest = int(widest_window(lanes) * 1_000_000)
    begin = lambda value, width: value - F.pmod(value, F.lit(width))
    within = lambda value, reach, width: F.explode(F.array_distinct(F.array(begin(value - reach, width), begin(value + reach, width))))
    out = sides(tx, "out").withColumn("t", within(F.col("out_us"), widest, WIDE * widest)).withColumn("c", within(amount_cell(F.col("out_cents")), 1, WIDE))
    into = sides(tx if inflows is None else inflows, "in").withColumns({"t": begin(F.col("in_us"), WIDE * widest), "c": begin(amount_cell(F.col("in_cents")), WIDE)})
    most = F.greatest("out_cents", "in_cents")
    allowed = F.least(F.lit(FEE_CENTS), F.greatest(F.lit(1), F.floor(most / FEE_SHARE).cast("bigint")))
    delta = F.abs(F.col("out_cents") - F.col("in_cents"))
    apart = F.abs(F.col("in_us") - F.col("out_us"))
    pairs = out.hint("merge").join(into, ["currency", "t", "c"]).where((F.col("out_account") != F.col("in_account")) & (delta <= allowed) & (apart <= widest))
    pairs = pairs.select(
        "out_id", "in_id", "out_account", "in_account", (apart / 1_000_000).alias("delta_s"), delta.alias("delta_cents"), allowed.alias("allowed"),
        (F.col("in_us") >= F.col("out_us")).cast("int").alias("forward"), (F.floor(F.col("in_us") / 86_400_000_000) == F.floor(F.col("out_us") / 86_400_000_000)).alias("same_day"),
        *[f"{side}_{name}" for side in ("out", "in") for name in SAID],
    )
    if lanes is None:
        return pairs.withColumn("window_s", F.lit(float(WINDOW_S)))
    pairs = pairs.join(lanes, ["out_account", "in_account"], "left").withColumn("window_s", F.coalesce("window_s", F.lit(float(WINDOW_S))))
    return pairs.where(F.col("delta_s") <= F.col("window_s"))


def with_features(pairs: DataFrame, tx: DataFrame) -> DataFrame:
    """Pairs with what their texts say; those of ``candidates`` have it."""
    if {f"{side}_{name}" for side in ("out", "in") for name in SAID} <= set(pairs.columns):
        return pairs
    return pairs.join(features(tx, "out"), "out_id").join(features(tx, "in"), "in_id")


def amount_score() -> Column:
    return F.greatest(F.lit(0.7), F.least(F.lit(1.0), 1.0 - F.col("delta_cents") / F.col("allowed")))


def scored(pairs: DataFrame) -> DataFrame:
    """The base score, added up in a fixed order, the lane's bonus, and what ranks a pair among equals."""
    s = F.col("delta_s")
    time = F.when(s <= 300, 0.25).when(s <= 1800, 0.18).when(s <= 7200, 0.12).when(s <= 86400, 0.05).otherwise(0.02)
    plus = lambda flag, value: F.when(F.col(flag), value).otherwise(0.0)
    base = F.lit(0.20) + amount_score() * 0.35 + time + plus("out_hint", 0.10) + plus("in_hint", 0.10) + plus("same_day", 0.04)
    out = pairs.withColumns({
        "base": F.least(F.lit(0.99), base),
        "hints": F.col("out_hint").cast("int") + F.col("in_hint").cast("int"),
        "ref_match": ((F.col("out_ref") != "") & (F.col("out_ref") == F.col("in_ref"))).cast("int"),
        "overlap": F.size(F.array_intersect("out_tokens", "in_tokens")),
    })
    if "lane_n" not in pairs.columns:
        return out.withColumns({"lane_n": F.lit(0).cast("long"), "lane_s": F.lit(0.0), "out_hits": F.lit(0), "in_hits": F.lit(0), "bonus": F.lit(0.0), "score": F.col("base")})
    none = F.array().cast("array<string>")
    hits = lambda side: F.size(F.array_intersect(f"{side}_words", F.coalesce(f"{side}_patterns", none)))
    out = out.withColumns({"out_hits": hits("out"), "in_hits": hits("in"), "lane_n": F.coalesce("lane_n", F.lit(0).cast("long")), "lane_s": F.coalesce("lane_s", F.lit(0.0))})
    by_hits = lambda side: F.when(F.col(f"{side}_hits") > 0, F.least(F.lit(0.03), F.lit(0.015) * F.col(f"{side}_hits"))).otherwise(0.0)
    bonus = F.least(F.lit(0.06), F.col("lane_n") * 0.008) + by_hits("out") + by_hits("in") + F.when(s <= F.col("lane_s"), 0.03).otherwise(0.0)
    out = out.withColumn("bonus", F.when(F.col("lane_n") > 0, F.least(F.lit(0.12), bonus)).otherwise(0.0))
    return out.withColumn("score", F.least(F.lit(0.99), F.col("base") + F.col("bonus")))


def one_sided() -> Column:
    """A known lane of which only one side says that it is a transfer."""
    other = F.when(F.col("out_hint"), F.col("in_lane")).otherwise(F.col("out_lane"))
    return (F.col("score") >= ONE_SIDED) & (F.col("delta_cents") == 0) & (F.col("delta_s") <= 86400) & (F.col("out_hint") != F.col("in_hint")) & other


def viable(pairs: DataFrame) -> DataFrame:
    return pairs.where((F.col("score") >= VIABLE) | one_sided())


def likely(pairs: DataFrame) -> DataFrame:
    """The pairs that are viable or counted for their accounts, without lists: few of all, so they may be written and shuffled."""
    return pairs.where(F.col("score") >= min(VIABLE, ONE_SIDED)).drop(*LISTS)


def lane_counts(pairs: DataFrame) -> DataFrame:
    """(out_account, in_account, n_pairs, n_forward): pairs over the lower threshold, and viable ones that run forward."""
    forward = ((F.col("score") >= VIABLE) | one_sided()) & (F.col("forward") == 1)
    counts = pairs.groupBy("out_account", "in_account").agg(F.count_if(F.col("score") >= ONE_SIDED).alias("n_pairs"), F.count_if(forward).alias("n_forward"))
    return counts.where((F.col("n_pairs") > 0) | (F.col("n_forward") > 0))


def rank_order() -> list[Column]:
    down = ("score", "hints", "ref_match", "overlap", "forward", "n_forward", "lane_n")
    return [*map(F.desc, down), F.asc("delta_s"), F.asc("delta_cents"), F.asc("out_id"), F.asc("in_id")]


def exact(pairs: pd.DataFrame) -> list[int]:
    """Pairs of the largest sum of scores, then the most pairs, then the best ranks; each side's rows once."""
    return exact_ranks(list(zip(pairs["out_id"], pairs["in_id"], pairs["score"], pairs["rank"])))


def exact_ranks(pairs: list[tuple[str, str, float, int]]) -> list[int]:
    bit: dict[str, int] = {}
    edges: dict[str, list[tuple[int, int, float]]] = {}
    for o, i, score, rank in pairs:
        edges.setdefault(o, []).append((rank, bit.setdefault(i, 1 << len(bit)), score))
    best: dict[int, tuple[float, int, tuple[int, ...]]] = {0: (0.0, 0, ())}
    for own in edges.values():
        new = dict(best)
        for used, (total, n, ranks) in best.items():
            for rank, b, score in own:
                if not used & b:
                    made = (round(total + score, 9), n + 1, tuple(sorted((*ranks, rank))))
                    old = new.get(used | b)
                    if old is None or (made[0], made[1], [-x for x in made[2]]) > (old[0], old[1], [-x for x in old[2]]):
                        new[used | b] = made
        best = new
    return list(max(best.values(), key=lambda v: (v[0], v[1], [-x for x in v[2]]))[2])


def assign_exactly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs chosen within each of many small components; rows come in the order of labels, so only the last of a batch may go on."""
    names = ["out_id", "in_id", "score", "rank"]
    label, own = None, []
    for batch in batches:
        found = []
        for its, *row in zip(batch["label"], *[batch[c] for c in names]):
            if its != label:
                found += best_of(own)
                label, own = its, []
            own.append(tuple(row))
        yield pd.DataFrame(found, columns=names[:2])
    yield pd.DataFrame(best_of(own), columns=names[:2])


def best_of(pairs: list[tuple[str, str, float, int]]) -> list[tuple[str, str]]:
    ranks = set(exact_ranks(sorted(pairs, key=lambda p: p[3])))
    return [p[:2] for p in pairs if p[3] in ranks]


def greedy(edges: DataFrame) -> DataFrame:
    """(out_id, in_id) as taking pairs by rank chooses them: pairs that are each other's best, round after round."""
    best = lambda side: F.min("rank").over(Window.partitionBy("label", f"{side}_id"))
    rest, chosen = edges.select("label", "out_id", "in_id", "rank"), []
    while True:
        both = written(rest.withColumns({"of_out": best("out"), "of_in": best("in")}), "greedy")
        taken = both.where("rank = of_out and rank = of_in")
        if taken.isEmpty():
            break
        chosen.append(taken.select("out_id", "in_id"))
        rest = both.join(taken.select("label", "out_id"), ["label", "out_id"], "left_anti").join(taken.select("label", "in_id"), ["label", "in_id"], "left_anti")
        rest = rest.select("label", "out_id", "in_id", "rank")
    out = edges.select("out_id", "in_id").limit(0)
    for part in chosen:
        out = out.unionByName(part)
    return out


KNOWN = ("score", "hints", "ref_match", "overlap", "forward", "n_forward", "lane_n", "delta_s", "delta_cents", "out_id", "in_id", "out_hint", "in_hint", "out_generic")


def sure(pair: Column) -> Column:
    return (pair["score"] >= AUTO) & (pair["hints"] > 0) & (pair["delta_cents"] == 0) & ~pair["out_generic"]


def ambiguity(first: Column, second: Column, least: float | None = None) -> tuple[Column, Column]:
    """Whether the best of a transaction's pairs isn't clearly so against the next, and by what it was told."""
    alone = second.isNull()
    if least is not None:  # lists are in the order of scores, so those over a threshold come first
        alone = alone | (second["score"] < least)
    steps = [(F.lit(False), alone, "single"), (F.lit(False), first["score"] - second["score"] >= MARGIN, "score_gap")]
    for name, label in (("ref_match", "bank_ref"), ("hints", "hint_count"), ("overlap", "counterparty"), ("forward", "chronology"), ("n_forward", "account_pair_chronology"), ("lane_n", "lane_prior")):
        steps.append((first[name] < second[name], first[name] != second[name], label))
    steps.append((F.lit(False), second["delta_s"] - first["delta_s"] >= TIEBREAK_S, "time_delta"))
    steps.append((first["delta_cents"] > second["delta_cents"], first["delta_cents"] != second["delta_cents"], "amount_delta"))
    unclear, by = F.lit(True), F.lit("none")
    for value, when, label in reversed(steps):
        unclear, by = F.when(when, value).otherwise(unclear), F.when(when, F.lit(label)).otherwise(by)
    return unclear, by


#: What a pair is judged against.
RIVALS = ("out_first", "out_second", "in_first", "in_second", "alt", "alt_out", "alt_in")


def judged(selected: DataFrame, edges: DataFrame, taken: DataFrame) -> DataFrame:
    """Selected pairs with their status, as they are met in the order of ranks.

    ``taken`` are the selected pairs that become links. Of a pair's rivals on either side only those count
    whose other end isn't taken by a pair of better rank.
    """
    pair = F.struct(*KNOWN)
    out = selected
    for side, other in (("out", "in"), ("in", "out")):
        used = taken.select("label", F.col(f"{other}_id"), F.col("rank").alias("used_rank"))
        own = selected.select("label", F.col(f"{side}_id"), F.col("rank").alias("own_rank"))
        rivals = edges.join(own, ["label", f"{side}_id"]).join(used, ["label", f"{other}_id"], "left")
        rivals = rivals.where(F.col("used_rank").isNull() | (F.col("used_rank") >= F.col("own_rank")))
        place = F.row_number().over(Window.partitionBy("label", f"{side}_id").orderBy("rank"))
        tops = rivals.withColumn("place", place).where("place <= 2").groupBy("label", f"{side}_id")
        named = lambda k: F.max(F.when(F.col("place") == k, pair)).alias(f"{side}_{'first' if k == 1 else 'second'}")
        out = out.join(tops.agg(named(1), named(2)), ["label", f"{side}_id"], "left")
    alt = edges.select("label", F.col("out_id").alias("alt_out"), F.col("in_id").alias("alt_in"), F.struct(*KNOWN).alias("alt"))
    out = out.withColumns({"alt_out": F.col("in_second")["out_id"], "alt_in": F.col("out_second")["in_id"]}).join(alt, ["label", "alt_out", "alt_in"], "left")

    same = lambda c: (F.col(c)["out_id"] == F.col("out_id")) & (F.col(c)["in_id"] == F.col("in_id"))
    top = F.coalesce(same("out_first") & same("in_first"), F.lit(False))
    own = F.struct(*KNOWN)
    quartet = [own, F.col("out_second"), F.col("in_second"), F.col("alt")]
    able = F.col("alt").isNotNull() & sure(quartet[0]) & sure(quartet[1]) & sure(quartet[2]) & sure(quartet[3])
    direct, cross = F.col("score") + F.col("alt")["score"], F.col("out_second")["score"] + F.col("in_second")["score"]
    scores = [q["score"] for q in quartet]
    symmetric = (F.abs(direct - cross) <= 1e-9) & (F.greatest(*scores) - F.least(*scores) <= 1e-9) & (F.greatest(*[q["delta_s"] for q in quartet]) <= 30.0)
    rule = F.when(~top | ~F.coalesce(able, F.lit(False)), "none").when(direct > cross, "2x2_total_score").when(symmetric, "2x2_deterministic_symmetry").otherwise("none")

    told = {}
    for side in ("out", "in"):
        first, second = F.col(f"{side}_first"), F.col(f"{side}_second")
        unclear, by = ambiguity(first, second)
        told[f"{side}_unclear"] = F.when(top, unclear).otherwise(True)
        told[f"{side}_tiebreak"] = F.when(top, by).otherwise("global_component")
        told[f"{side}_unclear_auto"] = F.when(top, ambiguity(first, second, AUTO)[0]).otherwise(True)
    out = out.withColumns({"override": rule, **told})
    out = out.withColumn("ambiguous", (F.col("out_unclear_auto") | F.col("in_unclear_auto")) & (F.col("override") == "none"))

    below, even, day = F.col("score") < AUTO, F.col("delta_cents") == 0, F.col("delta_s") <= 86400
    recurrent = (F.col("score") >= RECURRENT) & below & even & F.col("out_hint") & F.col("in_hint") & day & (F.col("n_pairs") >= RECURRENT_N)
    one = below & (F.col("n_pairs") >= ONE_SIDED_N) & ~F.col("out_unclear") & ~F.col("in_unclear") & one_sided()
    by_lane = (F.col("score") >= BY_LANE) & below & even & (F.col("lane_n") >= LANE_N) & (F.col("delta_s") <= F.greatest(F.lit(86400.0), F.col("lane_s")))
    by_lane = by_lane & ((F.col("out_hits") > 0) | F.col("out_hint")) & ((F.col("in_hits") > 0) | F.col("in_hint"))
    guard = F.col("out_generic") & F.col("in_hint") & (F.col("ref_match") == 0)
    auto = (((F.col("score") >= AUTO) & (F.col("hints") > 0)) | recurrent | one | by_lane) & ~F.col("ambiguous") & ~guard
    mode = F.when(by_lane, "lane_prior").when(recurrent, "recurrent").when(one, "one_sided_recurrent").otherwise("none")
    status = F.when(auto, "auto").when(F.col("score") >= VIABLE, "suggested").otherwise("dropped")
    return out.withColumns({"lane_mode": mode, "guard": guard, "status": status})


def rationale() -> Column:
    """What led to a link, as text of ``name=value`` parts in a fixed order."""
    flag = lambda c: F.col(c).cast("int").cast("string")
    whole = lambda c: F.floor(c).cast("string")
    fixed = lambda c, n: F.format_string(f"%.{n}f", c)
    parts = [
        F.concat(F.lit("amount_match="), fixed(F.col("delta_cents") / 100, 2), F.lit(" (score="), fixed(amount_score(), 2), F.lit(")")),
        F.concat(F.lit("dt="), whole("delta_s"), F.lit("s")),
        F.concat(F.lit("hints="), flag("out_hint"), F.lit("/"), flag("in_hint")),
        F.concat(F.lit("same_day="), flag("same_day")),
        F.concat(F.lit("in_after_out="), flag("forward")),
        F.concat(F.lit("ref_match="), flag("ref_match")),
        F.concat(F.lit("out_generic_no_hint="), flag("out_generic")),
        F.concat(F.lit("counterparty_overlap="), F.col("overlap").cast("string")),
        F.concat(F.lit("known_lane_marker="), flag("out_lane"), F.lit("/"), flag("in_lane")),
        F.concat(F.lit("lane_prior_confirmations="), F.col("lane_n").cast("string")),
        F.concat(F.lit("lane_prior_window_s="), whole("lane_s")),
        F.concat(F.lit("lane_prior_pattern_hits="), F.col("out_hits").cast("string"), F.lit("/"), F.col("in_hits").cast("string")),
        F.concat(F.lit("lane_prior_bonus="), fixed(F.col("bonus"), 3)),
        F.concat(F.lit("match_window_s="), whole("window_s")),
        F.concat(F.lit("ambiguous="), flag("ambiguous")),
        F.concat(F.lit("auto_guard="), F.when(F.col("guard"), "generic_outflow").otherwise("none")),
        F.concat(F.lit("auto_override="), F.col("override")),
        F.concat(F.lit("auto_lane="), F.col("lane_mode")),
        F.when(F.col("lane_mode") == "lane_prior", F.concat(F.lit("lane_count="), F.col("lane_n").cast("string"))).when(F.col("lane_mode") != "none", F.concat(F.lit("lane_count="), F.col("n_pairs").cast("string"))),
        F.concat(F.lit("tiebreak_out="), F.col("out_tiebreak")),
        F.concat(F.lit("tiebreak_in="), F.col("in_tiebreak")),
        F.concat(F.lit("component_mode="), F.when(F.col("small"), "exact").otherwise("fallback")),
        F.concat(F.lit("component_size="), F.col("outs").cast("string"), F.lit("x"), F.col("ins").cast("string"), F.lit("/"), F.col("edges").cast("string")),
    ]
    return F.concat_ws("; ", *parts)


def links(pairs: DataFrame) -> DataFrame:
    """The links of scored pairs: (out_id, in_id, status, score, fee, rationale)."""
    pairs = written(likely(pairs), "pairs")
    edges = counted(viable(pairs), lane_counts(pairs))
    labels = components(edges.select(F.col("out_id").alias("a"), F.col("in_id").alias("b")))
    return linked(edges.join(labels.withColumnRenamed("node", "out_id"), "out_id")).drop("label")


def counted(edges: DataFrame, counts: DataFrame) -> DataFrame:
    return edges.join(counts, ["out_account", "in_account"], "left").na.fill(0, ["n_pairs", "n_forward"])


def linked(edges: DataFrame) -> DataFrame:
    """The links of viable pairs with the counts of their accounts and the ``label`` of their component, with that label.

    Components share no transaction, so each is assigned by itself: small ones exactly, many in a
    function over rows in the order of labels, others by rounds of mutual best pairs. Whether a pair under the usual threshold
    becomes a link depends on pairs of better rank, so the judgement is repeated until it stays.
    """
    # One order for all components, dealt out by its ranges: a component with most of the pairs is no task's alone.
    order = rank_order()
    edges = written(edges.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id()), "edges")
    sizes = edges.groupBy("label").agg(F.countDistinct("out_id").alias("outs"), F.countDistinct("in_id").alias("ins"), F.count("*").alias("edges"), F.min("rank").alias("best"))
    small = (F.col("outs") <= EXACT_SIDE) & (F.col("ins") <= EXACT_SIDE) & (F.col("edges") <= EXACT_EDGES)
    sizes = written(sizes.withColumn("small", small), "sizes")
    one = (F.col("outs") == 1) | (F.col("ins") == 1)
    told = lambda which: edges.join(sizes.where(which).select("label"), "label", "left_semi")
    # Where all pairs share a side the best is all there is; else at most EXACT_EDGES rows are looked at together.
    alone = edges.join(sizes.where(one & F.col("small")).select("label", F.col("best").alias("rank")), ["label", "rank"], "left_semi").select("out_id", "in_id")
    few = told(~one & F.col("small")).select("label", "out_id", "in_id", "score", "rank").repartition("label").sortWithinPartitions("label")
    exactly = few.mapInPandas(assign_exactly, edges.select("out_id", "in_id").schema)
    chosen = written(alone.unionByName(exactly).unionByName(greedy(told(~F.col("small")))), "chosen")
    selected = written(edges.join(chosen, ["out_id", "in_id"]).join(sizes, "label"), "selected")
    place = ["label", "out_id", "in_id", "rank"]
    sure_links, low = selected.where(F.col("score") >= VIABLE).select(place), selected.where(F.col("score") < VIABLE).select(place).limit(0)
    while True:
        out = written(judged(selected, edges, sure_links.unionByName(low)).drop(*RIVALS), "judged")
        now = out.where((F.col("score") < VIABLE) & (F.col("status") == "auto")).select(place)
        if now.exceptAll(low).isEmpty() and low.exceptAll(now).isEmpty():
            break
        low = now
    fee = F.when(F.col("delta_cents") > 0, F.col("delta_cents") / 100)
    return out.where("status <> 'dropped'").select("label", "out_id", "in_id", "status", "score", fee.alias("fee"), rationale().alias("rationale"))
