"""What goes with files or statements that are deleted, table by table, and what is left.

With a statement go its rows, their links, its balances and exceptions, and the transactions that no row outside
still holds, with the transfers and exceptions of these; with a file go its statements and its own exceptions, and a batch
goes with its last file. Files and statements are deleted all at once, which comes to the same as one after the other
in any order: a transaction is held as long as any row is left.

A store is a dict of tables by the names of ``KEYS``. Ids of rows that are null never go, and a link without a
row holds its transaction. Ids that are asked for and not stored change nothing.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.graph import written

#: The columns that tell a row of each table.
KEYS = {
    "batches": ["id"], "files": ["id"], "statements": ["id"], "rows": ["id"], "links": ["transaction_id", "statement_row_id"], "transactions": ["id"],
    "transfer_links": ["id"], "snapshots": ["id"], "exceptions": ["id"], "rules": ["id"], "accounts": ["id"],
}
#: What a purge must be told.
PURGE_TOKEN = "delete-all"


def gone(store: dict[str, DataFrame], files: DataFrame | None = None, statements: DataFrame | None = None) -> dict[str, DataFrame]:
    """The keys of what goes, each once, for files and statements given by ``id``; rules and accounts stay."""
    given = lambda df, like: like.select("id").limit(0) if df is None else df.select("id").distinct()
    own_files = written(store["files"].join(given(files, store["files"]), "id", "left_semi").select("id").distinct(), "files")
    of_files = store["statements"].join(own_files.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id")
    named = store["statements"].join(given(statements, store["statements"]), "id", "left_semi").select("id")
    sheets = written(of_files.union(named).distinct(), "statements")
    of_sheets = sheets.select(F.col("id").alias("statement_id"))
    rows = written(store["rows"].join(of_sheets, "statement_id", "left_semi").select("id").distinct(), "rows")

    row_ids = rows.select(F.col("id").alias("statement_row_id"))
    links = written(store["links"].join(row_ids, "statement_row_id", "left_semi").select(*KEYS["links"]).distinct(), "links")
    held = store["links"].join(row_ids, "statement_row_id", "left_anti").select("transaction_id")
    lost = links.select("transaction_id").distinct().join(held, "transaction_id", "left_anti").withColumnRenamed("transaction_id", "id")
    alone = written(store["transactions"].join(lost, "id", "left_semi").select("id").distinct(), "alone")

    ends = store["transfer_links"].select(F.col("id").alias("link"), F.explode(F.array("transaction_out_id", "transaction_in_id")).alias("id"))
    entities = [(sheets, "statement"), (lost, "transaction"), (own_files, "import_file")]
    about = reduce(DataFrame.union, [ids.select(F.lit(kind).alias("entity_type"), F.col("id").alias("entity_id")) for ids, kind in entities])
    stay = store["files"].join(own_files, "id", "left_anti").select(F.col("batch_id").alias("id"))
    emptied = store["files"].join(own_files, "id", "left_semi").select(F.col("batch_id").alias("id")).distinct().join(stay, "id", "left_anti")
    return {
        "batches": store["batches"].join(emptied, "id", "left_semi").select("id").distinct(),
        "files": own_files,
        "statements": sheets,
        "rows": rows,
        "links": links,
        "transactions": alone,
        "transfer_links": ends.join(lost, "id", "left_semi").select(F.col("link").alias("id")).distinct(),
        "snapshots": store["snapshots"].join(of_sheets, "statement_id", "left_semi").select("id").distinct(),
        "exceptions": store["exceptions"].join(about, ["entity_type", "entity_id"], "left_semi").select("id").distinct(),
    }


def gone_with_batches(store: dict[str, DataFrame], batches: DataFrame) -> dict[str, DataFrame]:
    """The same for all files of batches; a batch goes even if it has no file."""
    ids = batches.select("id").distinct()
    files = store["files"].join(ids.select(F.col("id").alias("batch_id")), "batch_id", "left_semi").select("id")
    out = gone(store, files=files)
    return {**out, "batches": store["batches"].join(ids, "id", "left_semi").select("id").distinct()}


def left(store: dict[str, DataFrame], going: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without what goes, with all their columns."""

    def kept(name: str, rows: DataFrame) -> DataFrame:
        keys = going[name].select(*[F.col(c).alias(f"gone_{c}") for c in KEYS[name]])
        # A link may have a null side and go nevertheless.
        return rows.join(keys, reduce(and_, [F.col(c).eqNullSafe(F.col(f"gone_{c}")) for c in KEYS[name]]), "left_anti")

    return {name: kept(name, rows) if name in going else rows for name, rows in store.items()}


def counts(going: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    return reduce(DataFrame.union, [ids.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, ids in going.items()])


def purge(store: dict[str, DataFrame], confirm: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """How many rows each table had, and all tables without any; anything but the token is an error."""
    if confirm != PURGE_TOKEN:
        raise ValueError(f"a purge must be confirmed by {PURGE_TOKEN!r}")
    return counts(store), {name: rows.limit(0) for name, rows in store.items()}
