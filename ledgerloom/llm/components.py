"""Connected components of a table of links, by hooking and pointer jumping over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of (a, b) links; the label is the least node of its component.

    Each round hangs every node on its least neighbour if that is less, follows the pointers twice,
    and replaces the links by those between the roots so found; links within a tree go. The number of
    rounds grows with the logarithm of the longest chain. Only least values are gathered, so a node
    with any number of links sends one row from each task.
    """
    spark = links.sparkSession
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    parents = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        hung = cut(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("label")), "hung")
        for _ in range(2):
            up = hung.select(F.col("node").alias("label"), F.col("label").alias("above"))
            hung = hung.join(up, "label").select("node", F.col("above").alias("label"))
        hung = cut(hung, "jumped")
        parents = hung if parents is None else cut(_follow(parents, hung), "parents")
        at = lambda side: hung.select(F.col("node").alias(side), F.col("label").alias(f"{side}_root"))
        kept = edges.join(at("a"), "a").join(at("b"), "b").where("a_root <> b_root")
        edges = cut(kept.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "links")
    return parents if parents is not None else spark.createDataFrame([], links.select(F.col("a").alias("node"), F.col("b").alias("label")).schema)


def _follow(parents: DataFrame, hung: DataFrame) -> DataFrame:
    """Earlier nodes with the labels that their roots have got."""
    up = hung.select(F.col("node").alias("label"), F.col("label").alias("above"))
    return parents.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"))
