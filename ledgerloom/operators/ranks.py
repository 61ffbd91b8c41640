"""Ranks within groups of any size: rows are dealt out by ranges of the whole order, so no group is one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.graph import written


def dealt(df: DataFrame, order: list[Column], name: str = "dealt") -> DataFrame:
    """``df`` written in the given order, ``part`` being the place of a row's range: all of a lesser part come before it."""
    return written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), name)


def ranked(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``rank``, from 1, of each row within its group by ``order``, which must not leave ties.

    Rows are numbered within their part and group; how many of the group lie in parts before is a sum over
    one row for each group and part.
    """
    rows = dealt(df, [*[F.col(c).asc_nulls_first() for c in by], *order])
    counts = rows.groupBy(*by, "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    place = F.row_number().over(Window.partitionBy("part", *by).orderBy(*order))
    joined = rows.withColumn("place", place)
    same = [joined[c].eqNullSafe(before[c]) for c in [*by, "part"]]
    return joined.join(before, same, "left").select(*[joined[c] for c in df.columns], (F.coalesce(before["before"], F.lit(0)) + joined["place"]).alias("rank"))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 to offset + limit of the whole order, with ``rank``; only the parts that hold them are read again.

    The counts of the parts, one number for each, come to the driver: they say which parts those are.
    """
    rows = dealt(df, order)
    counts = sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect())
    before, parts = 0, []
    for part, n in counts:
        if before < offset + limit and before + n > offset:
            parts.append((part, before))
        before += n
    if not parts:
        return df.limit(0).withColumn("rank", F.lit(0).cast("long"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    start = F.coalesce(*[F.when(F.col("part") == part, F.lit(b).cast("long")) for part, b in parts])
    told = rows.where(F.col("part").isin([part for part, _ in parts])).withColumn("rank", place + start)
    return told.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).drop("part")
