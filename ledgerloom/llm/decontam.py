"""Benchmark passages in training texts by spaced-seed hashing.

Words are runs of letters and digits, A-Z folded. A seed is a window of ``SPAN`` words in which a
fixed mask ignores some positions; the hashes of the rest are looked up among those of the benchmark.
With the four masks every run of 14 words with two words replaced shares a seed with its original, and
every run of 16 with three (tests/llm/test_decontam.py). Around a hit the two texts are laid side by
side over the whole item, and the stretch that scores best (a point for an equal word, two off for
another) counts if it has at least ``least_words`` words, or all of a shorter item, of which the share
``least_equal`` are equal. Items of 5 to ``SPAN`` - 1 words are looked up whole.

With ``full``, as the query and the pipeline call it, any stretch of so many words with that share
counts: where the best one doesn't, the longest that does is reported. The masks ``FULL`` share a seed
with each such stretch of at least ``LONG`` words with a quarter replaced (same tests), and shorter
items of any length have masks over the whole item that leave out each possible set of replaced words.
So for the default ``least_words`` and ``least_equal`` and for stricter ones nothing is missed; for
laxer ones the seeds may miss a stretch.

A benchmark of at most ``block_words`` words (and sixteen bytes for each) is sent to the tasks whole: its
seeds are a sorted array behind a filter table, and nothing of the documents is shuffled. Beyond that
size Spark makes the seeds of the distinct items, and the tasks get only a filter of 16 MB. Seeds of
the documents that pass it are joined with the items' by hash; for each place so found the words of
both sides are cut out, joined and judged. Either way gives the same rows. Filled far beyond a hundred
million words the filter lets all seeds of the documents through, which costs a shuffle, not results.

Defined results: a null or empty text matches nothing, nor does such an item, nor, without ``full``, a
text or an item of fewer than 5 words; of equal items each is reported; a null id is reported as null; repeated rows are answered each;
of the places where an item occurs in a text, the one with the most equal words is reported, then the
first; empty tables give no rows. Only the named columns are read
and compared; what is dropped is dropped by the text alone, whatever the other columns hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.llm.common import ALNUM, U64, cut, keep_rows, list_array, mix, text_blocks, words
from ledgerloom.llm.exact import sha256
from ledgerloom.llm.sketch import NumberFilter, keyed_texts

SPAN, SHORTEST = 10, 5
#: Kept positions of each mask.
MASKS = ((0, 1, 2, 7, 8, 9), (0, 1, 2, 5, 7, 9), (0, 1, 2, 5, 6, 9), (0, 3, 5, 6, 8, 9))
#: Kept positions of each mask of a full search, and the words of a stretch from which on they find it.
FULL = (
    (0, 1, 2, 4, 6, 7), (0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 7, 8), (0, 1, 3, 6, 8, 9),
    (0, 1, 2, 5, 6, 7), (0, 1, 3, 7, 9, 10), (0, 1, 3, 5, 6, 7), (0, 1, 2, 9, 10, 11),
)
LONG = 12
FACTORS = mix(np.arange(1, LONG + 1, dtype=U64)) | U64(1)
HITS = "id {0}, item_id {1}, equal_words int, aligned_words int, first_byte int, end_byte int"


def seeds(hashes: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """A hash of the kept words of each window; empty if there are fewer words than the window has."""
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.empty(0, U64)
    total = np.full(n, salt, U64)
    for p in mask:
        total += hashes[p : p + n] * FACTORS[p]
    return mix(total)


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks over all of a short item: with any quarter of its words replaced one of them is untouched."""
    parts = np.array_split(np.arange(n), min(n, n // 4 + 3)) if n >= 4 else [np.arange(n)]
    return [tuple(np.concatenate(kept).tolist()) for kept in combinations(parts, len(parts) - n // 4)]


def all_masks(full: bool = False) -> list[tuple[tuple[int, ...], int | None]]:
    """The spaced masks, for long items, then those of each length of a short item, with the length."""
    if full:
        return [*((m, None) for m in FULL), *((m, n) for n in range(1, LONG) for m in short_masks(n))]
    return [*((m, None) for m in MASKS), *((tuple(range(n)), n) for n in range(SHORTEST, SPAN))]


class Seeds:
    """Seeds of a block of the benchmark: sorted hashes with the item and word of each."""

    def __init__(self, items: list[tuple[object, str]], full: bool = False) -> None:
        self.ids = [i for i, _ in items]
        self.full, self.masks = full, all_masks(full)
        self.words: list[np.ndarray] = []
        own: list[list[tuple[np.ndarray, int]]] = [[] for _ in self.masks]
        for k, (_, text) in enumerate(items):
            buf = np.frombuffer((text or "").encode(), np.uint8)
            hashes = words(buf, np.array([0, len(buf)]), ALNUM)[0]
            self.words.append(hashes)
            for m, (mask, size) in enumerate(self.masks):
                if size is None and len(hashes) >= (LONG if full else SPAN):
                    own[m].append((seeds(hashes, mask, m), k))
                elif size == len(hashes):
                    own[m].append((seeds(hashes, mask, m)[:1], k))
        self.tables = [self._table(rows) for rows in own]

    def _table(self, rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, ...] | None:
        if not rows:
            return None
        keys = np.concatenate([s for s, _ in rows])
        item = np.concatenate([np.full(len(s), k, np.int32) for s, k in rows])
        word = np.concatenate([np.arange(len(s), dtype=np.int32) for s, _ in rows])
        order = np.argsort(keys, kind="stable")
        return keys[order], item[order], word[order]

    def filters(self) -> list[tuple[np.ndarray, U64] | None]:
        """For each mask a flag for each value of the top bits of its seeds."""
        out = []
        for table in self.tables:
            if table is None:
                out.append(None)
                continue
            bits = min(26, max(16, int(len(table[0]) * 32).bit_length()))
            flags = np.zeros(1 << bits, bool)
            flags[table[0] >> U64(64 - bits)] = True
            out.append((flags, U64(64 - bits)))
        return out

    def hits(self, hashes: np.ndarray, flags: list[tuple[np.ndarray, U64] | None]) -> np.ndarray:
        """Distinct (item, word of the texts that lies under the item's first word)."""
        found = []
        for m, ((mask, _), table, quick) in enumerate(zip(self.masks, self.tables, flags, strict=True)):
            if table is None or quick is None:
                continue
            own = seeds(hashes, mask, m)
            at = np.flatnonzero(quick[0][own >> quick[1]])
            lo, hi = np.searchsorted(table[0], own[at], "left"), np.searchsorted(table[0], own[at], "right")
            n = hi - lo
            entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack([table[1][entry], np.repeat(at, n) - table[2][entry]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Of all stretches the one of the best score, the first among equals, and of it the longest."""
    sums = np.concatenate(([0], np.cumsum(np.where(equal, 1, -2))))
    low = np.minimum.accumulate(sums)
    end = int((sums - low).argmax())
    return int(np.flatnonzero(sums[: end + 1] == low[end])[0]), end


def longest_stretch(equal: np.ndarray, least_equal: float) -> tuple[int, int]:
    """Of the stretches with the share ``least_equal`` of equal words the longest, the first among equals; (0, 0) if there is none."""
    share = Fraction(least_equal).limit_denominator(10_000)
    sums = np.concatenate(([0], np.cumsum(np.where(equal, share.denominator, 0) - share.numerator)))
    # The last end of each begin: the last place from which on some sum is as great.
    later = np.maximum.accumulate(sums[::-1])[::-1]
    ends = len(later) - np.searchsorted(later[::-1], sums, "left") - 1
    begin = int((ends - np.arange(len(sums))).argmax())
    return begin, int(ends[begin])


def judge(equal: np.ndarray, item_words: int, least_words: int, least_equal: float, full: bool = False) -> tuple[int, int, int] | None:
    """(equal words, first, end) of the best stretch, if it counts, or with ``full`` of the longest that counts."""
    for a, b in (best_stretch(equal), longest_stretch(equal, least_equal)) if full else (best_stretch(equal),):
        same = int(equal[a:b].sum())
        if b > a and b - a >= min(least_words, item_words) and same >= least_equal * (b - a):
            return same, a, b
    return None


def found_in(own: Seeds, flags: list[tuple[np.ndarray, U64] | None], texts: pa.Array, least_words: int, least_equal: float) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, item, equal words, aligned words, first byte, end byte) for each text of a column and item in it."""
    for lo, _, buf, at in text_blocks(texts):
        hashes, starts, ends, text = words(buf, at, ALNUM)
        best: dict[tuple[int, int], tuple] = {}
        for item, diagonal in own.hits(hashes, flags).tolist():
            theirs = own.words[item]
            # A hit may lie across the end of a text; each text under the item is judged by itself.
            a, b = max(0, diagonal), min(len(hashes), diagonal + len(theirs))
            for t in np.unique(text[a:b]).tolist():
                first, end = a + int(np.searchsorted(text[a:b], t, "left")), a + int(np.searchsorted(text[a:b], t, "right"))
                equal = hashes[first:end] == theirs[first - diagonal : end - diagonal]
                if (said := judge(equal, len(theirs), least_words, least_equal, own.full)) is None:
                    continue
                same, x, y = said
                new = (same, -int(starts[first + x] - at[t]), y - x, int(ends[first + y - 1] - at[t]))
                if new > best.get((t, item), (0,)):
                    best[t, item] = new
        for (t, item), (same, first, size, end) in sorted(best.items()):
            yield lo + t, item, same, size, -first, end


def _match(batches: Iterator[pa.RecordBatch], sent: Broadcast, least_words: int, least_equal: float, kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    own: Seeds = sent.value
    flags = own.filters()
    for batch in batches:
        ids = batch.column("id")
        rows = [(ids[t].as_py(), own.ids[item], *rest) for t, item, *rest in found_in(own, flags, batch.column("text"), least_words, least_equal)]
        if rows:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "item_id", "equal_words", "aligned_words", "first_byte", "end_byte"])


def _clean(texts: pa.Array, sent: Broadcast, least_words: int, least_equal: float) -> np.ndarray:
    out = np.ones(len(texts), bool)
    out[[t for t, *_ in found_in(sent.value, sent.value.filters(), texts, least_words, least_equal)]] = False
    return out


def small_enough(benchmark: DataFrame, text_col: str, block_words: int) -> bool:
    """Whether the benchmark may be held by the driver and by each task."""
    size = F.sum(F.size(F.split(text_col, r"[^\p{L}\p{N}]+"))), F.sum(F.octet_length(text_col))
    n_words, n_bytes = benchmark.where(F.col(text_col).isNotNull()).agg(*size).first()
    return (n_words or 0) <= block_words and (n_bytes or 0) <= 16 * block_words


def all_seeds(benchmark: DataFrame, item_col: str, text_col: str, full: bool) -> Broadcast:
    """The seeds of a benchmark that is small enough."""
    items = benchmark.select(F.col(item_col).alias("id"), F.col(text_col).alias("text")).collect()
    return benchmark.sparkSession.sparkContext.broadcast(Seeds([(r["id"], r["text"]) for r in items], full))


class SeedFilter(NumberFilter):
    """A filter of seeds: 16 MB, whatever their number."""

    BITS = 27


def _item_seeds(batches: Iterator[pa.RecordBatch], full: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = batch.column("item_key"), batch.column("text")
        for k in range(len(batch)):
            own = Seeds([(None, texts[k].as_py())], full)
            for m, table in enumerate(own.tables):
                if table is not None:
                    n = len(table[0])
                    columns = [pa.array(table[0].view(np.int64)), pa.array([keys[k].as_py()] * n, pa.binary()), pa.array(table[2])]
                    columns += [pa.array(np.full(n, v, np.int32)) for v in (m, len(own.words[0]))]
                    yield pa.RecordBatch.from_arrays(columns, ["seed", "item_key", "item_word", "mask", "item_words"])


def _text_seeds(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
    """Seeds of the texts that the benchmark may have, with the text's key and the word that each begins at."""
    quick, masks = sent.value
    for batch in batches:
        for _, _, buf, at in text_blocks(batch.column("text")):
            hashes, _, _, text = words(buf, at, ALNUM)
            before = np.searchsorted(text, np.arange(len(at) - 1), "left")
            for m, mask in masks:
                own = seeds(hashes, mask, m)
                where = np.flatnonzero(quick.may_hold(own))
                where = where[text[where] == text[where + mask[-1]]]
                if not len(where):
                    continue
                met, of = np.unique(text[where], return_inverse=True)
                keys = pa.array([xxhash.xxh3_128_digest(buf[at[t] : at[t + 1]]) for t in met.tolist()], pa.binary())
                columns = [keys.take(pa.array(of)), pa.array(own[where].view(np.int64)), pa.array((where - before[text[where]]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "seed", "word"])


def _text_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of each text with their first and end bytes."""
    for batch in batches:
        for lo, hi, buf, at in text_blocks(batch.column("text")):
            hashes, starts, ends, text = words(buf, at, ALNUM)
            n = np.bincount(text, minlength=hi - lo)
            columns = [batch.column("key").slice(lo, hi - lo), list_array(pa.array(hashes.view(np.int64)), n)]
            columns += [list_array(pa.array((x - at[text]).astype(np.int32)), n) for x in (starts, ends)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "words", "starts", "ends"])


def _judged(batches: Iterator[pa.RecordBatch], least_words: int, least_equal: float, full: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        get = lambda name, k: batch.column(name)[k].values.to_numpy()  # noqa: B023, E731
        take, out = [], []
        for k in range(len(batch)):
            said = judge(get("words", k) == get("theirs", k), batch.column("item_words")[k].as_py(), least_words, least_equal, full)
            if said is not None:
                take.append(k)
                out.append((said[0], said[2] - said[1], int(get("starts", k)[said[1]]), int(get("ends", k)[said[2] - 1])))
        if take:
            columns = [batch.column(name).take(pa.array(take)) for name in ("key", "item_key")] + [pa.array(c, pa.int32()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "item_key", "equal_words", "aligned_words", "first_byte", "end_byte"])


def joined(docs: DataFrame, benchmark: DataFrame, text_col: str, item_text_col: str, least_words: int, least_equal: float, full: bool) -> DataFrame:
    """(text_digest, item_digest, equal_words, ...): a row for each distinct text and distinct item in it, by joins."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    items = benchmark.select(sha256(F.col(item_text_col)).alias("item_key"), F.col(item_text_col).alias("text")).where("text is not null")
    items = cut(items.dropDuplicates(["item_key"]), "items")
    theirs = cut(items.mapInArrow(partial(_item_seeds, full=full), "seed long, item_key binary, item_word int, mask int, item_words int"), "item-seeds")
    # At most one row for each mask there is.
    used = sorted(r["mask"] for r in theirs.select("mask").distinct().collect())
    sent = spark.sparkContext.broadcast((SeedFilter.of(theirs.select("seed")), [(m, all_masks(full)[m][0]) for m in used]))
    # Copies of a text have the same rows, which become one before anything is joined.
    ours = cut(texts.mapInArrow(partial(_text_seeds, sent=sent), "key binary, seed long, word int").distinct(), "text-seeds")
    sent.destroy()
    places = ours.join(theirs, "seed").select("key", "item_key", "item_words", (F.col("word") - F.col("item_word")).alias("diagonal"))
    places = cut(places.distinct(), "places")
    with keyed_texts(texts, places.select("key").distinct()) as kept:
        kept = cut(kept.dropDuplicates(["key"]), "texts")
    own = cut(kept.mapInArrow(_text_words, "key binary, words array<long>, starts array<int>, ends array<int>"), "text-words")
    first = F.greatest("diagonal", F.lit(0))
    end = F.least(F.size("words"), F.col("diagonal") + F.col("item_words"))
    part = lambda name: F.slice(name, first + 1, end - first).alias(name)
    sides = places.join(own, "key").select("key", "item_key", "item_words", (first - F.col("diagonal")).alias("skipped"), *map(part, ("words", "starts", "ends")))
    items = items.withColumnRenamed("item_key", "key").mapInArrow(_text_words, "key binary, words array<long>, starts array<int>, ends array<int>")
    items = cut(items.select(F.col("key").alias("item_key"), F.col("words").alias("all")), "item-words")
    sides = sides.join(items, "item_key").withColumn("theirs", F.slice("all", F.col("skipped") + 1, F.size("words"))).drop("all", "skipped")
    step = partial(_judged, least_words=least_words, least_equal=least_equal, full=full)
    found = sides.mapInArrow(step, "key binary, item_key binary, equal_words int, aligned_words int, first_byte int, end_byte int")
    best = F.max(F.struct("equal_words", (-F.col("first_byte")).alias("back"), "aligned_words", "end_byte")).alias("best")
    found = found.groupBy("key", "item_key").agg(best).join(kept.select("key", sha256(F.col("text")).alias("text_digest")), "key")
    found = found.select(
        "text_digest", F.col("item_key").alias("item_digest"), "best.equal_words", "best.aligned_words", (-F.col("best.back")).alias("first_byte"), "best.end_byte"
    )
    return cut(found, "found")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least_words: int = 12,
    least_equal: float = 0.75,
    block_words: int = 2_000_000,
    full: bool = False,
) -> DataFrame:
    """(id, item_id, equal_words, aligned_words, first_byte, end_byte): a row for each text and item in it; ``full`` misses no stretch that counts."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if small_enough(benchmark, item_text_col, block_words):
        kinds = [to_arrow_type(own.schema["id"].dataType), to_arrow_type(benchmark.schema[item_col].dataType), *[pa.int32()] * 4]
        schema = HITS.format(own.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString())
        sent = all_seeds(benchmark, item_col, item_text_col, full)
        return own.mapInArrow(partial(_match, sent=sent, least_words=least_words, least_equal=least_equal, kinds=kinds), schema)
    found = joined(own, benchmark, "text", item_text_col, least_words, least_equal, full)
    items = benchmark.select(F.col(item_col).alias("item_id"), sha256(F.col(item_text_col)).alias("item_digest"))
    named = own.select("id", sha256(F.col("text")).alias("text_digest")).join(found, "text_digest").join(items, "item_digest")
    return named.select("id", "item_id", "equal_words", "aligned_words", "first_byte", "end_byte")


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least_words: int = 12,
    least_equal: float = 0.75,
    block_words: int = 2_000_000,
    full: bool = False,
) -> DataFrame:
    """The documents without any item of the benchmark, with all their columns."""
    if small_enough(benchmark, item_text_col, block_words):
        sent = all_seeds(benchmark, item_col, item_text_col, full)
        return keep_rows(docs, text_col, partial(_clean, sent=sent, least_words=least_words, least_equal=least_equal))
    found = joined(docs, benchmark, text_col, item_text_col, least_words, least_equal, full).select("text_digest").distinct()
    return docs.join(found, sha256(docs[text_col]) == found["text_digest"], "left_anti")
