"""What the training-data operators share: tables in the shared folder and word hashing in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache, partial
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64


def shared_folder(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; only where that is unset, as in tests, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or "/tmp/checkpoints"
    return f"{base.rstrip('/')}/ledgerloom/{uuid4().hex}"


#: Tables that were written since each open ``scratch`` began, the innermost last.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``cut`` writes within are deleted at the end, but for those it is told to keep."""
    made: list[str] = []
    token = _written.set((*_written.get(), made))
    try:
        yield
    finally:
        _written.reset(token)
        context = spark.sparkContext
        for path in made:
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def goes_with_scratch(path: str) -> None:
    """Have the innermost open ``scratch`` delete a folder; without one it stays."""
    if open_ := _written.get():
        open_[-1].append(path)


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: later jobs don't repeat its work.

    Within ``scratch`` the table goes with it; with ``keep`` it goes with the scratch around that, if any.

    A table that is read again also has no partitioning that a join could rely on, so that both
    sides of the join are shuffled and Spark may split the partitions of a hot key.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    open_ = _written.get()[:-1] if keep else _written.get()
    if open_:
        open_[-1].append(path)
    with shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Queries that end within leave no shuffle files: what they made is in a table or in the driver."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _keep(batches: Iterator[pa.RecordBatch], text_col: str, judge: Callable[[pa.Array], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(judge(batch.column(text_col))))


def keep_rows(docs: DataFrame, text_col: str, judge: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows, with all their columns, whose texts ``judge`` is true for; nothing is shuffled."""
    return docs.mapInArrow(partial(_keep, text_col=text_col, judge=judge), docs.schema)


#: Bytes of texts whose n-grams are made at a time: so few that numpy's arrays of them stay in a core's cache.
BLOCK = 1 << 18


def text_blocks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``most`` bytes: first and last+1 row, UTF-8 bytes, offsets. Nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: each bit of the result depends on all bits of ``x``."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: A value for each byte, so that the polynomial hash of short strings is well spread.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, BASE, U64)
    down = np.full(size, INVERSE, U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i up to n."""
    up, down = _powers(1 << max(20, n.bit_length()))
    return up[: n + 1], down[: n + 1]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = sum of values[i] * BASE**i over s <= i < e."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values))[0][:-1], out=out[1:])
    return out


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


#: Bytes of words that are parted by white space only, A-Z read as a-z; other entries are separators.
SPACED = np.array([b not in b" \t\n\v\f\r" for b in range(256)])
#: Bytes of words made of letters and digits; every byte of a non-ASCII character counts as a letter.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
FOLDED_VALUES = BYTE_VALUES[lower_ascii()]


def words(buf: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts of a block: 64-bit hashes, start bytes, end bytes, and the text of each.

    ``inside`` says which bytes belong to words; a word never crosses the end of a text.
    """
    n = len(buf)
    if not n:
        none = np.empty(0, np.int64)
        return np.empty(0, U64), none, none, none
    own = inside[buf]
    first, last = own.copy(), own.copy()
    first[1:] &= ~own[:-1]
    last[:-1] &= ~own[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = own[edge]
    last[edge - 1] = own[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = prefix_sums(FOLDED_VALUES[buf])
    hashes = mix((sums[ends] - sums[starts]) * powers(n)[1][starts])
    return hashes, starts, ends, np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(starts, at)))


def list_array(values: pa.Array, counts: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """A list column from its flat values and the length of each list; those of ``null`` are null."""
    ends = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
    return pa.ListArray.from_arrays(ends, values, mask=None if null is None else pa.array(null))
