"""Mixing sources to target weights by Poisson replication.

The mean repetition rate of a source is its target share of the output over its share of the input.
A document's count inverts the Poisson distribution of that mean at a number in [0, 1) taken from
the MD5 of seed and id, so a count depends on nothing but the id, the seed and the rate. Documents
are exploded by their counts and dealt to partitions by a second hash of seed, id and copy, and
sorted by it within each: a global shuffle in one exchange of evenly spread keys.

Sources without a weight of their own share ``rest`` in proportion to their sizes. There is one rate
for each named source and one for the rest: the driver sees as many numbers as the caller named.

Defined results: a null source belongs to the rest; a null id counts as the text of no character,
and rows that repeat an id get the same count, each; an empty table gives no rows; a weight of zero
gives no copies; a named source without rows gets none, and the output is smaller by its share. Further columns are
kept as they are, and ``copy`` and ``mix_key`` are added (or ``names``): where the documents have a column of
such a name, in whatever case, that is an error. Texts aren't looked at.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a hash that make the number: 52 bits, which a double holds exactly.
DIGITS = 13


def thresholds(rate: float) -> list[float]:
    """P(K <= 0), P(K <= 1), ... up to the first that a number below 1 can't reach."""
    out, total, k = [], 0.0, 0
    while rate > 0:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out.append(total)
        if k > rate and 1 - total < 2.0 ** -(4 * DIGITS):
            break
        k += 1
        if k > rate + 60 * math.sqrt(rate) + 60:
            break
    return out


def unit(text: Column) -> Column:
    """A number in [0, 1) from the MD5 of a text."""
    whole = F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")
    return whole.cast("double") / F.lit(float(1 << (4 * DIGITS)))


def reached(steps: list[float], u: Column) -> Column:
    """How many thresholds a number reaches. The plan holds one literal, an array, however many they are."""
    # Those that are zero are reached by every number; a large rate has many of them.
    zeros = sum(x == 0 for x in steps)
    rest = ",".join(map(repr, steps[zeros:]))
    if not rest:
        return F.lit(zeros)
    return F.lit(zeros) + F.size(F.filter(F.split(F.lit(rest), ",").cast("array<double>"), lambda x: x <= u))


def rates(docs: DataFrame, weights: Mapping[str, float], rest: float, source_col: str, size: float) -> dict[str | None, float]:
    """Mean repetitions by named source, and under None of all others; shares are of ``size`` times the input."""
    total = sum(weights.values()) + rest
    if total <= 0 or min([rest, *weights.values()]) < 0:
        raise ValueError("weights must not be negative, and some must be positive")
    named = F.when(F.col(source_col).isin(list(weights)), F.col(source_col)) if weights else F.lit(None).cast("string")
    counts = {r["name"]: r["n"] for r in docs.groupBy(named.alias("name")).agg(F.count("*").alias("n")).collect()}
    everything = sum(counts.values())
    share = {**weights, None: rest}
    return {k: share[k] / total * size * everything / n for k, n in counts.items()}


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float],
    rest: float = 0.0,
    size: float = 1.0,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    names: tuple[str, str] = ("copy", "mix_key"),
) -> DataFrame:
    """Documents repeated to the target weights and shuffled; ``size`` is the output over the input."""
    taken = {c.lower() for c in docs.columns} & {n.lower() for n in names}
    if taken or names[0].lower() == names[1].lower():
        raise ValueError(f"columns {sorted(taken)} exist already; give other names")
    rate = rates(docs, weights, rest, source_col, size)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    u = unit(F.concat(F.lit(f"{seed}:"), key))
    count = F.lit(0)
    for name, mean in rate.items():
        own = reached(thresholds(mean), u)
        here = ~F.coalesce(F.col(source_col).isin(list(weights)), F.lit(False)) if name is None else F.col(source_col) == name
        count = F.when(F.coalesce(here if weights else F.lit(True), F.lit(False)), own).otherwise(count)
    copy, mix_key = names
    copies = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    out = docs.withColumn(copy, F.explode(copies))
    out = out.withColumn(mix_key, F.md5(F.concat(F.lit(f"{seed}#"), key, F.lit("#"), F.col(copy).cast("string"))))
    return out.repartition(F.col(mix_key)).sortWithinPartitions(mix_key, copy)
