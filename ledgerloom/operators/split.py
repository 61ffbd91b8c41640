"""Splitting transactions that several rows of one statement fell into: each further row gets one of its own.

A step of the plan names a row, the transaction it is to leave and the key of the one it goes to. It is skipped where
the row has no owner or another one by now, where key or reference is blank, or where there is nothing to
clone. A transaction that has the key already is reused, else the first step of a key clones the one it leaves, under
an id made from account and key, and the others reuse that. So a plan that is applied again changes nothing.

The steps of a row are folded in order by an expression (a plan names a row once or a few times): a step is done if
the row's owner at that point is the one it names. Which step of a key makes the clone is a least place. A step whose
transaction isn't stored is done only where the key is.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.graph import written


class Split(NamedTuple):
    """Transactions and links after, every step with its outcome (``target`` where a row moved), and the four counts."""

    transactions: DataFrame
    links: DataFrame
    steps: DataFrame
    counts: DataFrame


def apply_steps(plan: DataFrame, transactions: DataFrame, links: DataFrame) -> Split:
    """``plan`` has place, transaction_id, account_id, statement_row_id, dedup_key and reference; places are all different.

    ``transactions`` have id, account_id, dedup_key and bank_reference_id besides what a clone takes over; ``links`` have
    transaction_id and statement_row_id. Null accounts are equal; of several transactions with a key the least id is reused.
    """
    key = F.concat_ws("|", F.coalesce("account_id", F.lit("\x00")), "dedup_key")
    steps = plan.withColumn("target_key", F.when((F.coalesce("dedup_key", F.lit("")) != "") & (F.coalesce("reference", F.lit("")) != ""), key))
    owner = links.groupBy("statement_row_id").agg(F.min("transaction_id").alias("owner"))
    stored = transactions.where("dedup_key is not null").groupBy(key.alias("target_key")).agg(F.min("id").alias("existing"))
    source = transactions.select(F.col("id").alias("transaction_id"), F.lit(True).alias("is_there"))
    steps = steps.join(owner, "statement_row_id", "left").join(stored, "target_key", "left").join(source, "transaction_id", "left")
    made = F.concat(F.lit("tx_"), F.substring(F.sha2("target_key", 256), 1, 24))
    goal = F.when(F.col("target_key").isNotNull(), F.coalesce("existing", F.when(F.col("is_there"), made)))
    steps = written(steps.withColumn("goal", goal), "steps")
    named = steps.where("goal is not null and owner is not null").groupBy("statement_row_id").agg(F.first("owner").alias("owner"), F.sort_array(F.collect_list(F.struct("place", "transaction_id", "goal"))).alias("own"))

    def done(state: Column, step: Column) -> Column:
        here, moves = state["owner"] == step["transaction_id"], step["goal"] != step["transaction_id"]
        reached = F.when(here, F.concat(state["reached"], F.array(F.struct(step["place"].alias("place"), moves.alias("applied"))))).otherwise(state["reached"])
        return F.struct(F.when(here, step["goal"]).otherwise(state["owner"]).alias("owner"), reached.alias("reached"))

    kind = plan.schema["place"].dataType.simpleString()
    start = F.struct(F.col("owner").alias("owner"), F.array().cast(f"array<struct<place: {kind}, applied: boolean>>").alias("reached"))
    folded = written(named.select("statement_row_id", "owner", F.aggregate("own", start, done).alias("end")), "folded")
    reached = folded.select(F.explode("end.reached").alias("r")).select("r.place", F.col("r.applied").alias("applied"), (~F.col("r.applied")).alias("finds_itself"))
    steps = steps.drop("owner").join(reached, "place", "left").fillna(False, ["applied", "finds_itself"])
    maker = steps.where("applied and existing is null").groupBy("target_key").agg(F.min("place").alias("maker"))
    steps = steps.join(maker, "target_key", "left").withColumn("clones", F.col("applied") & F.coalesce(F.col("place") == F.col("maker"), F.lit(False)))
    steps = written(steps.withColumn("target", F.when(F.col("applied"), F.col("goal"))), "decided")

    own = steps.where("clones").select(F.col("transaction_id").alias("id"), F.col("target").alias("new_id"), F.col("dedup_key").alias("new_key"), F.col("reference").alias("new_reference"))
    clones = transactions.join(own, "id").withColumns({"id": F.col("new_id"), "dedup_key": F.col("new_key"), "bank_reference_id": F.col("new_reference")})
    moved = folded.select("statement_row_id", F.col("owner").alias("transaction_id"), F.col("end.owner").alias("target"))
    new_links = links.join(moved, ["statement_row_id", "transaction_id"], "left").select(F.coalesce("target", "transaction_id").alias("transaction_id"), "statement_row_id").distinct()
    outcome = F.when(F.col("clones"), "cloned").when(F.col("applied"), "reused").otherwise("skipped").alias("outcome")
    counts = steps.agg(
        F.count_if("clones").alias("inserted_transactions"), F.count_if(F.col("finds_itself") | (F.col("applied") & ~F.col("clones"))).alias("reused_transactions"),
        F.count_if("applied").alias("moved_statement_links"), F.count_if(~F.col("applied")).alias("skipped_rows"),
    )
    return Split(transactions.unionByName(clones.select(transactions.columns)), new_links, steps.select("place", "statement_row_id", "transaction_id", "target", outcome), counts)
