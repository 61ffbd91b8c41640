"""Tables in the shared folder, and components of a graph given by its edges."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; only where that is unset in a local session, as in tests, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or '/tmp/checkpoints').rstrip('/')}/ledgerloom/{uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps don't repeat it, a lost executor costs one step."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that a node can reach over (a, b) edges.

    Each round hangs every node on the least of its neighbours and itself in the order of a hash, follows the
    pointers twice, and keeps of the edges those between different roots. Ids often follow time and so run along a
    chain; by a hash a chain falls to short pieces, and the rounds grow with the logarithm of the longest one. Only
    what is left is written in a round; the rounds' pointers are followed once, at the end. A node with many edges
    sends one row from each task. Edges from a node to itself count for nothing; null nodes are left out.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left, rounds = written(edges.distinct(), "edges"), []
    placed = lambda c: F.struct(F.xxhash64(c).alias("place"), F.col(c).alias("id"))
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to")).union(left.select("b", "a"))
        hung = both.groupBy("node").agg(F.min(placed("to")).alias("to"))
        hung = written(hung.select("node", F.least(placed("node"), F.col("to"))["id"].alias("label")), "hung")
        for _ in range(2):
            hung = followed(hung, hung)
        hung = written(hung, "jumped")
        rounds.append(hung)
        root = lambda side, of=hung: of.select(F.col("node").alias(side), F.col("label").alias(f"{side}_root"))
        kept = left.join(root("a"), "a").join(root("b"), "b").where("a_root <> b_root")
        left = written(kept.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    labels = rounds.pop()
    while rounds:
        labels = followed(rounds.pop(), labels)
    labels = written(labels, "roots")
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return written(labels.join(least, "label").select("node", F.col("least").alias("label")), "labels")


def followed(labels: DataFrame, above: DataFrame) -> DataFrame:
    """(node, label): the labels that the labels have in turn, where they have any."""
    above = above.select(F.col("node").alias("label"), F.col("label").alias("above"))
    return labels.join(above, "label", "left").select("node", F.coalesce("above", "label").alias("label"))
