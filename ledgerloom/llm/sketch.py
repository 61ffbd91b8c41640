"""Arrays of a fixed size that tasks fill and Spark adds up: counts by hash cell, and filters of keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import U64, mix, shuffles_go, text_blocks

PARTS = 32
SCHEMA = "part int, salt int, cells binary"
FILTER_BITS = 1 << 24
#: Keys that a task remembers to have given.
REMEMBERED = 200_000


def pieces(cells: np.ndarray, salt: int) -> Iterator[pa.RecordBatch]:
    """An array as compressed rows of its parts; parts of zeros are left out."""
    for k, part in enumerate(np.split(cells, PARTS)):
        if part.any():
            packed = zstandard.ZstdCompressor(level=1).compress(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([salt], pa.int32()), pa.array([packed], pa.binary())], ["part", "salt", "cells"])


def unpacked(cells: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(cells), kind)


def _merge(batches: Iterator[pa.RecordBatch], kind: str, how: str) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for part, salt, cells in zip(batch.column("part").to_pylist(), batch.column("salt").to_pylist(), batch.column("cells"), strict=True):
            own = unpacked(cells.as_py(), kind)
            if (part, salt) not in sums:
                sums[part, salt] = own.copy()
            elif how == "or":
                sums[part, salt] |= own
            else:
                # Sums stay at the greatest value of the kind.
                np.add(sums[part, salt], np.minimum(own, np.iinfo(kind).max - sums[part, salt]), out=sums[part, salt])
    for (part, _), cells in sums.items():
        packed = zstandard.ZstdCompressor(level=1).compress(cells.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([0], pa.int32()), pa.array([packed], pa.binary())], ["part", "salt", "cells"])


def merged(parts: DataFrame, size: int, kind: str, how: str = "sum") -> np.ndarray:
    """The array of all tasks together, added in two steps; a task holds one copy of its parts at a time."""
    step = partial(_merge, kind=kind, how=how)
    first = parts.repartition(F.col("part"), F.col("salt")).mapInArrow(step, SCHEMA)
    second = first.repartition(F.col("part")).mapInArrow(step, SCHEMA)
    whole = np.zeros(size, kind)
    with shuffles_go(parts.sparkSession):
        for r in second.collect():  # PARTS rows at most, whatever the input
            whole[r["part"] * (size // PARTS) : (r["part"] + 1) * (size // PARTS)] = unpacked(bytes(r["cells"]), kind)
    return whole


def _key_bits(key: bytes) -> list[int]:
    low, high = int.from_bytes(key[:8], "little"), int.from_bytes(key[8:16], "little")
    return [(low + k * high) % FILTER_BITS for k in range(4)]


class KeyFilter:
    """A Bloom filter of 16-byte keys that are hashes: 2 MB, whatever the number of keys."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[b >> 3] >> (b & 7) & 1 for b in _key_bits(key))

    @staticmethod
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            for key in batch.column("key"):
                for b in _key_bits(key.as_py()):
                    bits[b >> 3] |= 1 << (b & 7)
        yield from pieces(bits, 0)

    @classmethod
    def of(cls, keys: DataFrame) -> KeyFilter:
        return cls(merged(keys.select("key").mapInArrow(cls.fill, SCHEMA), FILTER_BITS // 8, "uint8", "or"))


class NumberFilter:
    """One bit for each value that the top bits of hashed numbers take: 4 MB, whatever their number."""

    BITS = 25

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @classmethod
    def places(cls, numbers: np.ndarray) -> np.ndarray:
        return (mix(numbers.view(U64)) >> U64(64 - cls.BITS)).astype(np.int64)

    def may_hold(self, numbers: np.ndarray) -> np.ndarray:
        at = self.places(numbers)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    @classmethod
    def fill(cls, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (cls.BITS - 3), np.uint8)
        for batch in batches:
            at = cls.places(batch.column(0).to_numpy())
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield from pieces(bits, 0)

    @classmethod
    def of(cls, numbers: DataFrame) -> NumberFilter:
        return cls(merged(numbers.mapInArrow(cls.fill, SCHEMA), 1 << (cls.BITS - 3), "uint8", "or"))


def counted(texts: DataFrame, size: int, fill: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: str = "uint8") -> np.ndarray:
    """Counts by cell that ``fill`` makes of each task's texts; a count stays at the greatest value of its kind."""
    return merged(texts.mapInArrow(fill, SCHEMA), size, kind)


def _texts(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
    """Texts whose key may be among those wanted, each once in a task."""
    wanted, seen = sent.value, set()
    for batch in batches:
        keys, take = [], []
        for lo, _, buf, at in text_blocks(batch.column("text")):
            raw = buf.tobytes()
            for k in range(len(at) - 1):
                key = xxhash.xxh3_128_digest(raw[at[k] : at[k + 1]])
                if key in wanted and key not in seen:
                    if len(seen) < REMEMBERED:
                        seen.add(key)
                    keys.append(key)
                    take.append(lo + k)
        if take:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column("text").take(pa.array(take))], ["key", "text"])


@contextmanager
def keyed_texts(docs: DataFrame, wanted: DataFrame) -> Iterator[DataFrame]:
    """(key, text) of the documents whose key is among those of ``wanted``, and of few others.

    The key is the 128-bit XXH3 of the UTF-8 bytes. An equal text comes once from each task. The filter
    that the tasks read goes at the end: what is made of the texts must be written by then.
    """
    sent = docs.sparkSession.sparkContext.broadcast(KeyFilter.of(wanted))
    try:
        yield docs.select("text").mapInArrow(partial(_texts, sent=sent), "key binary, text string")
    finally:
        sent.destroy()
