"""As-of joins: for each probe the last value known at its time, by ranges of time and not by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ranks import dealt


def asof_join(probes: DataFrame, values: DataFrame, by: list[str], at: str, order: list[str] = ()) -> DataFrame:
    """Probes with ``found``, the struct of the other columns of the last of ``values`` at or before ``at`` with equal ``by``; null where there is none.

    Both sides have the columns ``by`` and ``at``; of values of one time the last by ``order`` counts. Null keys equal
    each other; a probe without a time finds nothing, a value without one isn't found. Both sides are dealt out by ranges of key and
    time together, so one key with all the rows is spread over all tasks; the last value of each
    range and key is carried on to the ranges after it, one row for each.
    """
    rest = [c for c in values.columns if c not in (*by, at)]
    known = values.where(F.col(at).isNotNull()).select(*by, at, F.struct(*rest).alias("value"), F.lit(None).cast(_struct(probes)).alias("probe"), F.struct(*[F.col(c) for c in order], *[F.lit(0)] * (not order)).alias("tie"))
    asked = probes.where(F.col(at).isNotNull()).select(*by, at, F.lit(None).cast(known.schema["value"].dataType).alias("value"), F.struct(*probes.columns).alias("probe"), F.lit(None).cast(known.schema["tie"].dataType).alias("tie"))
    place = [*[F.col(c).asc_nulls_first() for c in by], F.col(at), F.col("probe").isNotNull().asc(), F.col("tie").asc_nulls_first()]
    rows = dealt(known.unionByName(asked), place, "asof")
    within = Window.partitionBy("part", *by).orderBy(F.col(at), F.col("probe").isNotNull(), F.col("tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("own", F.last("value", ignorenulls=True).over(within)).where("probe is not null")
    last = rows.where("value is not null").groupBy(*by, "part").agg(F.max_by("value", F.struct(at, "tie")).alias("last"))
    parts = _joined(rows.select(*by, "part").distinct(), last, [*by, "part"])
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("carried", F.last("last", ignorenulls=True).over(before)).drop("last")
    found = _joined(own, carried, [*by, "part"]).select("probe.*", F.coalesce("own", "carried").alias("found"))
    return found.unionByName(probes.where(F.col(at).isNull()).withColumn("found", F.lit(None).cast(found.schema["found"].dataType)))


def _struct(df: DataFrame) -> str:
    return df.schema.simpleString()


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join on keys of which nulls are equal."""
    renamed = right.select(*[F.col(c).alias(f"__{c}") for c in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(renamed, same, "left").drop(*[f"__{c}" for c in keys])
