"""Periodic runs of words: stretches that repeat one period at least four times, found on a harmonic grid.

Words are numbered by their text (a dictionary of the batch, so equal numbers are equal words) and hashed
by prefix sums. For each period p the grid has the points 0, p, 2p, ...: n/p of them, so n log n in all.
A run of period p that is at least 4p long holds two whole neighbouring cells of the grid with the same
hash; only such pairs of cells go on. Binary searches for the longest common extension of all (period, grid
point) pairs, to the right and to the left, run at the same time over arrays. The stretches found are
deduplicated, and then verified word by word; where hashes lied, the stretch is cut where words differ.
Of equal stretches the least period is the run's: others are its multiples.

All of this is a map over batches of rows: nothing is shuffled. Texts are taken in blocks of about
``common.text_blocks``' size and pairs in portions of ``PORTION``, so that memory is bounded by a portion or by one text.

Defined results: a null or empty text has no words and no runs; rows that repeat count each; a null id stays;
an empty table gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.llm.common import SPACED, U64, list_array, mix, powers, prefix_sums, text_blocks

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Pairs of grid points in hand at once.
PORTION = 1 << 20
#: Words as the query's contract splits them, for Java's patterns.
SEPARATORS = r"[\x20\x09-\x0D]+"


def words_of(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the words of a block of texts, and where each text's words begin (one more for the end)."""
    inside = SPACED[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def numbered(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word; equal words, and no others, have equal numbers."""
    if not len(starts):
        return np.empty(0, np.int64)
    sizes = ends - starts
    own = np.concatenate(([0], np.cumsum(sizes)))
    places = np.arange(own[-1]) + np.repeat(starts - own[:-1], sizes)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(own.astype(np.int64)), pa.py_buffer(buf[places])])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


class Hashes:
    """Hashes of the ranges of a sequence of numbers."""

    def __init__(self, numbers: np.ndarray) -> None:
        self.sums = prefix_sums(mix((numbers.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)))
        self.down = powers(len(numbers))[1]

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ranges of the given sizes from a and from b have one hash."""
        return (self.sums[a + size] - self.sums[a]) * self.down[a] == (self.sums[b + size] - self.sums[b]) * self.down[b]


def extensions(hashes: Hashes, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
    """How far the ranges from a and b (a < b) agree by hash, at most ``most``; with ``back``, of those that end there."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (low < high).any():
        half = (low + high + 1) >> 1
        shift = half if back else 0
        same = hashes.equal(a - shift, b - shift, half)
        low, high = np.where(same, half, low), np.where(same, high, half - 1)
    return low


def _portions(count: np.ndarray) -> Iterator[slice]:
    """Stretches of ``count`` that sum up to about PORTION each."""
    total, lo = np.cumsum(count), 0
    while lo < len(count):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + PORTION, "right")))
        yield slice(lo, hi)
        lo = hi


def _verified(numbers: np.ndarray, begin: int, end: int, start: int, stop: int, period: int) -> list[tuple[int, int, int]]:
    """The maximal stretches of a period within one that its hashes claim; [(start, stop, period)] itself as a rule."""
    same = numbers[start : stop - period] == numbers[start + period : stop]
    if same.all() and (start == begin or numbers[start - 1] != numbers[start - 1 + period]) and (stop == end or numbers[stop] != numbers[stop - period]):
        return [(start, stop, period)]
    same = np.concatenate(([False], numbers[begin : end - period] == numbers[begin + period : end], [False]))
    edge = np.flatnonzero(same[1:] != same[:-1]) + begin
    found = ((int(a), int(b) + period, period) for a, b in zip(edge[::2], edge[1::2]))
    return [(a, b, p) for a, b, p in found if b - a >= max(LEAST_WORDS, LEAST_PERIODS * p)]


def find_runs(numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of the runs of the texts whose words begin at ``at``, sorted by start and period."""
    hashes = Hashes(numbers)
    sizes = np.diff(at)
    periods = sizes // LEAST_PERIODS  # each text has the grids of so many periods
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    begin, end = at[:-1][text], at[1:][text]
    cells = (end - begin) // period - 1  # pairs of neighbouring whole cells
    claims = []
    for part in _portions(cells):
        count, p = cells[part], period[part]
        of = np.repeat(np.arange(len(p)), count)
        a = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * p[of] + begin[part][of]
        alike = hashes.equal(a, a + p[of], p[of])
        a, of = a[alike], of[alike]
        p, lo, hi = p[of], begin[part][of], end[part][of]
        stop = a + p + extensions(hashes, a, a + p, hi - a - p) if len(a) else a
        start = a - extensions(hashes, a, a + p, a - lo, back=True) if len(a) else a
        long = stop - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
        claims.append(np.unique(np.stack([start, stop, p, lo, hi])[:, long], axis=1))
    claims = np.unique(np.concatenate(claims, axis=1), axis=1) if claims else np.empty((5, 0), np.int64)
    runs: dict[tuple[int, int], int] = {}
    for start, stop, p, lo, hi in claims.T.tolist():
        if (start, stop) not in runs:  # else a multiple of the run's period, since claims come by start, end and period
            for s, e, own in _verified(numbers, lo, hi, start, stop, p):
                runs[s, e] = min(own, runs.get((s, e), own))
    found = np.array(sorted((s, e, p) for (s, e), p in runs.items()), np.int64).reshape(-1, 3)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found[:, 0], found[:, 1], found[:, 2]


def _runs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, at in text_blocks(batch.column("text")):
            first, last, word_at = words_of(buf, at)
            numbers = numbered(buf, first, last)
            start, stop, period = find_runs(numbers, word_at)
            begin = np.searchsorted(start, word_at)
            extra = np.zeros(len(numbers) + 1, np.int64)  # words in runs after the first period
            np.add.at(extra, start + period, 1)
            np.add.at(extra, stop, -1)
            kept = np.cumsum(extra[:-1]) == 0
            data, digests = buf.tobytes(), []
            for i in range(hi - lo):
                own = np.flatnonzero(kept[word_at[i] : word_at[i + 1]]) + word_at[i]
                digests.append(sha256(b" ".join([data[a:b] for a, b in zip(first[own].tolist(), last[own].tolist())])).hexdigest())
            base = np.repeat(word_at[:-1], np.diff(begin))
            parts = pa.StructArray.from_arrays([pa.array(start - base), pa.array(stop - start), pa.array(period)], ["start", "length", "period"])
            columns = [batch.column("id")[lo:hi], pa.array(np.diff(word_at), pa.int64()), list_array(parts, np.diff(begin)), pa.array(digests)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed_sha256) of each row.

    ``runs`` holds (start, length, period) in words, by start and then period. The digest is of the words
    that no run holds after its first period, joined by one space.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType
    run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    schema = pa.schema([("id", to_arrow_type(kind)), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed_sha256", pa.string())])
    said = f"id {kind.simpleString()}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed_sha256 string"
    return own.mapInArrow(partial(_runs, schema=schema), said)


def repeated_tail(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A tenth of the texts, chosen by the id's checksum, with a stretch of their own words repeated to the end.

    With h = crc32(id in decimal) and g = h // 10: where h % 10 is 0 and the text has n > 0 words, each word from
    a = g % n on becomes word a + (i - a) % p, p being 1 + (n - a) // (3 + g % 8). Others stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(F.col(text_col), SEPARATORS), lambda w: w != "")

    def planted(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("long")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i).cast("int"))), " ")

    made = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w))), 1)
    return F.when(h % 10 == 0, F.coalesce(made, F.col(text_col))).otherwise(F.col(text_col))
