"""Which transactions to demote or promote so that a ledger's counts by key meet given ones.

Each key in order takes, of its candidates that no key before it took, the first by priority and id, as many as
it lacks. A key that shares no candidate is settled by ranks. Keys that share some are joined to components:
those of at most ``FOLDED`` rows are walked by a grouped function, larger ones in rounds, in each of
which every key that is first among the open keys of all its open candidates takes its share at once.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.graph import components, written
from ledgerloom.operators.ranks import ranked

#: Candidate rows of a component that are walked at once.
FOLDED = 5_000
TAKEN = "key string, id string, action string"


class Alignment(NamedTuple):
    """(key, id, action) of each change, (key, kind, needed, missing) of what can't be met, (key, own, given, delta) of keys that differ."""

    operations: DataFrame
    unresolved: DataFrame
    deltas: DataFrame


def candidates(rows: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keys that differ, and (key, id, priority, action, needed): what each may take, once for each transaction.

    ``rows`` has key, id, high, meaning, bank_category, bank_reference_id and ``stays``: whether the row would still be
    high were its meaning unknown. Keys of ``given`` (key, n) that no row has aren't met with: nothing could change for them.
    """
    own = rows.groupBy("key").agg(F.count_if("high").alias("own"))
    deltas = own.join(given, "key", "left").select("key", "own", F.coalesce("n", F.lit(0)).cast("long").alias("given")).withColumn("delta", F.col("own") - F.col("given")).where("delta <> 0")
    meaning = F.lower(F.trim(F.coalesce("meaning", F.lit(""))))
    moved = meaning.isin("internal_transfer", "external_transfer")
    bare = (meaning == "unknown") & (F.lower(F.trim(F.coalesce("bank_category", F.lit("")))) == "transfer") & (F.trim(F.coalesce("bank_reference_id", F.lit(""))) != "")
    demote = F.when(F.col("high") & moved & F.col("stays"), F.struct(F.lit(0).alias("priority"), F.lit("demote_internal_clear_reference").alias("action")))
    demote = demote.when(F.col("high") & moved, F.struct(F.lit(1).alias("priority"), F.lit("demote_internal").alias("action")))
    demote = demote.when(F.col("high") & bare, F.struct(F.lit(2).alias("priority"), F.lit("demote_unknown_clear_reference").alias("action")))
    promote = F.when(~F.col("high") & (meaning == "unknown"), F.struct(F.lit(0).alias("priority"), F.lit("promote_unknown").alias("action")))
    told = rows.where("coalesce(id, '') <> ''").join(deltas.select("key", "delta"), "key").withColumn("as", F.when(F.col("delta") > 0, demote).otherwise(promote)).where("as is not null")
    one = told.groupBy("key", "id").agg(F.min("as").alias("as"), F.first("delta").alias("delta"))
    return deltas, one.select("key", "id", "as.priority", "as.action", F.abs("delta").alias("needed"))


def first_of(open_: DataFrame) -> DataFrame:
    """Of each key as many candidates as it needs, by priority and id."""
    return ranked(open_, ["key"], [F.col("priority"), F.col("id")]).where("rank <= needed").select("key", "id", "action")


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    used, out = set(), []
    for key, own in rows.sort_values(["key", "priority", "id"]).groupby("key", sort=True):
        needed = int(own["needed"].iloc[0])
        for i, action in zip(own["id"], own["action"]):
            if needed == 0:
                break
            if i not in used:
                used.add(i)
                needed -= 1
                out.append((key, i, action))
    return pd.DataFrame(out, columns=["key", "id", "action"])


def in_rounds(open_: DataFrame) -> DataFrame:
    """The same for components of any size; as many rounds as the longest chain of keys that wait for one another."""
    taken = None
    open_ = written(open_, "open")
    while not open_.isEmpty():
        first = open_.groupBy("id").agg(F.min("key").alias("first"))
        ready = open_.join(first, "id").groupBy("key").agg(F.bool_and(F.col("first") == F.col("key")).alias("ready")).where("ready").select("key")
        ready = written(ready, "ready")
        own = written(first_of(open_.join(ready, "key", "left_semi")), "taken")
        taken = own if taken is None else taken.union(own)
        open_ = written(open_.join(ready, "key", "left_anti").join(own.select("id"), "id", "left_anti").select(open_.columns), "open")
    return taken if taken is not None else open_.select("key", "id", "action")


def align(rows: DataFrame, given: DataFrame, folded: int = FOLDED) -> Alignment:
    """The changes that make the counts of ``rows`` by key those of ``given``, as far as there are candidates."""
    deltas, able = candidates(rows, given)
    deltas, able = written(deltas, "deltas"), written(able, "candidates")
    several = able.groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z").select("id")
    shared = able.join(several, "id", "left_semi")
    # A transaction's keys hang together by its least one.
    least = shared.groupBy("id").agg(F.min("key").alias("least"))
    label = written(components(shared.join(least, "id").select(F.col("least").alias("a"), F.col("key").alias("b"))), "labels").withColumnRenamed("node", "key")
    alone = first_of(able.join(label, "key", "left_anti"))
    tied = able.join(label, "key")
    size = tied.groupBy("label").agg((F.count("*") <= folded).alias("small"))
    tied = written(tied.join(size, "label"), "tied")
    walked = tied.where("small").groupBy("label").applyInPandas(_walk, TAKEN)
    operations = written(alone.union(walked).union(in_rounds(tied.where("not small").select(able.columns))), "operations")
    took = operations.groupBy("key").agg(F.count("*").alias("taken"))
    short = deltas.join(took, "key", "left").withColumn("missing", F.abs("delta") - F.coalesce("taken", F.lit(0))).where("missing > 0")
    kind = F.when(F.col("delta") > 0, "demote").otherwise("promote").alias("kind")
    return Alignment(operations, short.select("key", kind, F.abs("delta").alias("needed"), "missing"), deltas)
