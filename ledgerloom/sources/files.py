"""Files of text: delimited tables as they come, and reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header, all columns as text; a byte order mark before the first name is dropped.

    Empty fields are empty texts, quoted fields may hold line ends.
    """
    table = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', emptyValue="")
    return table.toDF(*[c.removeprefix("\ufeff") for c in table.columns]).na.fill("")


def write_report(rows: DataFrame, path: str) -> None:
    """Each row as a line of JSON, nulls included."""
    packed = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
    rows.select(packed.alias("value")).write.mode("overwrite").text(path)
