"""Inserts, updates and deletes of a stored table, by rewriting only the parts that hold changed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.graph import written

#: Folders that a stored table is dealt out to by its key's hash.
BUCKETS = 64


def store(rows: DataFrame, key: str, path: str, buckets: int = BUCKETS) -> None:
    """A new table of rows whose keys are all different."""
    rows.withColumn("bucket", _bucket(key, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def merge(spark: SparkSession, path: str, changes: DataFrame, key: str, buckets: int = BUCKETS) -> None:
    """Apply ``changes`` to the table at ``path``: its columns and ``deleted``, true where the key is to go.

    A key occurs once among the changes. The folders that hold such keys are read, merged, written to the shared folder and
    put in the old ones' place by a dynamic partition overwrite; all other files stay as they are. A merge that is
    run again changes nothing, so one that broke off is simply repeated. One merge at a time may write to a table.
    """
    own = written(changes.withColumn("bucket", _bucket(key, buckets)), "changes")
    touched = sorted(r["bucket"] for r in own.select("bucket").distinct().collect())  # as many numbers as there are folders at most
    if not touched:
        return
    stored = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    stays = stored.join(own.select(key), key, "left_anti")
    merged = written(stays.unionByName(own.where("not coalesce(deleted, false)").drop("deleted").select(stays.columns)), "merged")
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    # A folder of which nothing is left isn't among those overwritten.
    left = {r["bucket"] for r in merged.select("bucket").distinct().collect()}
    for bucket in touched:
        if bucket not in left:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
