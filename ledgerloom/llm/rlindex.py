"""Repeated substrings of a corpus by a run-length index, cut into parts that meet by content.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. A transform of the
whole corpus doesn't fit one task, and a shuffle of all its suffixes is many times the corpus, so the
index is built in parts between which no match can lie:

* Every string of ``length`` bytes names its anchor, the substring of ``anchor`` bytes of least hash
  within it. Equal strings have equal anchors in the same place. Anchors are about every
  (length - anchor) / 2 bytes, and each stands for the range of strings that name it.
* Of an anchor whose whole range of strings is found again byte for byte all strings are repeated: the
  inner parts of long matches, by far the most, are settled by counting hashes.
* Where an anchor is found again but not its whole range, at the ends of matches, the ranges
  are laid below each other, aligned at the anchor, and a positional run-length Burrows-Wheeler
  transform runs over their columns: rows are kept in the order of their reversed prefixes, a column
  is handled by its runs of equal bytes, and only at run ends is a match length computed from those
  between the runs; within a run it is carried over. The streamed matching statistics, how far back each
  row equals its neighbours, say for each column which strings of ``length`` bytes occur again.

A part is as many anchors as make ``PANEL`` rows. An anchor with more rows than that is dealt by the
hashes of its strings instead, so that no group has to fit a task. Hashes that decide are 128 bits:
two of 64, of the anchor and of the range, or one of 128.

Defined results: a null text is empty; a text shorter than ``length`` keeps all its bytes; rows that
repeat are texts like any other, so each is found in the other and goes; overlaps within one text
count; a null id is reported as null; an empty table gives no rows. Only the two named columns are
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ALNUM, BYTE_VALUES, U64, cut, list_array, mix, powers, prefix_sums, text_blocks, words
from ledgerloom.llm.sketch import keyed_texts

PANEL = 20_000
#: Bytes of texts that are looked at together.
BLOCK = 1 << 19
#: No byte of UTF-8: stands where a row of a panel has no byte.
NOTHING = 255
ANCHORS = "id {0}, n_bytes long, key binary, sha256 string, anchor array<long>, range array<long>, place array<int>, first array<int>, last array<int>"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values, from least values to the left and right within blocks of that width."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, U64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(buf: np.ndarray, at: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of the texts of a block: (text, hash of the anchor, its place, first and last string that name it), by place."""
    none = np.empty(0, np.int64)
    if len(buf) < length:
        return none, none.view(U64), none, none, none
    sums = prefix_sums(BYTE_VALUES[buf])
    own = mix((sums[anchor:] - sums[:-anchor]) * powers(len(buf))[1][: len(buf) - anchor + 1])
    # Half of the hash, then the place: the least is the first of least hash.
    ranked = (own & U64(0xFFFFFFFF00000000)) | np.arange(len(own), dtype=U64)
    place = (sliding_least(ranked, length - anchor + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    whole = np.zeros(len(place), bool)
    sizes = np.diff(at)
    for d in np.flatnonzero(sizes >= length):
        whole[at[d] : at[d + 1] - length + 1] = True
    starts = np.flatnonzero(whole)
    if not len(starts):
        return none, none.view(U64), none, none, none
    named = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (named[1:] != named[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(starts)) - 1
    text = np.searchsorted(at, starts[begin], "right") - 1
    return text, own[named[begin]], named[begin], starts[begin], starts[end]


def _anchors(batches: Iterator[pa.RecordBatch], length: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, at in text_blocks(batch.column("text"), BLOCK):
            text, key, place, first, last = anchors(buf, at, length, anchor)
            raw = buf.tobytes()
            whole = [raw[at[k] : at[k + 1]] for k in range(hi - lo)]
            ranges = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)), U64, len(first))
            count, base = np.bincount(text, minlength=hi - lo), at[text]
            ints = [list_array(pa.array(x - base, pa.int32()), count) for x in (place, first, last)]
            longs = [list_array(pa.array(x.view(np.int64)), count) for x in (key, ranges)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(lo, hi - lo), pa.array(np.diff(at), pa.int64()), pa.array([xxhash.xxh3_128_digest(t) for t in whole], pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in whole]), *longs, *ints],
                ["id", "n_bytes", "key", "sha256", "anchor", "range", "place", "first", "last"],
            )


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the ranges whose ends are to be found."""
    for batch in batches:
        columns: list[list] = [[], [], [], [], []]
        for text, ends in zip(batch.column("text"), batch.column("ends").to_pylist(), strict=True):
            raw = text.as_py().encode()
            for e in ends:
                for column, value in zip(columns, (e["anchor"], e["row"], e["first"], e["place"] - e["first"], raw[e["first"] : e["last"] + length]), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "row", "first", "before", "bytes"])


def repeated(panel: np.ndarray, length: int) -> np.ndarray:
    """Whether another row equals a row in the ``length`` columns from each on; ``panel`` is columns by rows.

    ``order`` are the rows by their reversed prefixes, and ``since[i]`` the column from which on row i of
    that order equals the one before it. A run of equal bytes in a column stays together in the next
    order, so its values are kept; the first of a run comes after the end of the previous run of its byte,
    and its value is the greatest since that end.
    """
    columns, rows = panel.shape
    found = np.zeros((columns - length + 1, rows), bool)
    order, since = np.arange(rows), np.zeros(rows, np.int32)
    if rows < 2:
        return found
    for k in range(columns):
        bytes_ = panel[k, order]
        begin = np.flatnonzero(np.concatenate(([True], bytes_[1:] != bytes_[:-1])))
        symbol = bytes_[begin]
        size = np.diff(np.append(begin, rows))
        by_symbol = np.argsort(symbol, kind="stable")
        most = np.maximum.reduceat(since, begin)
        # Runs in their new order; the first of each byte has no row of its byte before it.
        after = np.flatnonzero(symbol[by_symbol][1:] == symbol[by_symbol][:-1]) + 1
        run, previous = by_symbol[after], by_symbol[after - 1]
        carried = since.copy()
        carried[begin] = k + 1
        if len(run):
            # Runs with the same byte are never neighbours, so some run lies between.
            between = np.maximum.reduceat(most, np.stack([previous + 1, run], axis=1).ravel())[::2]
            carried[begin[run]] = np.maximum(between, since[begin[run]])
        starts = np.cumsum(size[by_symbol]) - size[by_symbol]
        taken = np.repeat(begin[by_symbol] - starts, size[by_symbol]) + np.arange(rows)
        order, since = order[taken], carried[taken]
        if k + 1 >= length:
            long = since <= k + 1 - length
            long[0] = False
            found[k + 1 - length, order[long]] = True
            found[k + 1 - length, order[np.flatnonzero(long) - 1]] = True
    return found


def panel_spans(first: list[int], before: list[int], ranges: list[bytes], length: int, anchor: int) -> tuple[list[int], list[int], list[int]]:
    """(row, start, end) of the stretches of repeated strings, over ranges aligned at their anchors."""
    reach = length - anchor
    panel = np.full((reach + length, len(ranges)), NOTHING, np.uint8)
    for i, (b, raw) in enumerate(zip(before, ranges, strict=True)):
        panel[reach - b : reach - b + len(raw), i] = np.frombuffer(raw, np.uint8)
    found = repeated(panel, length)
    top = np.array([reach - b for b in before])
    strings = np.array([len(r) - length + 1 for r in ranges])
    column = np.arange(len(found))[:, None]
    found &= (column >= top) & (column < top + strings)
    flags = np.zeros((len(ranges), len(found) + 2), np.int8)
    flags[:, 1:-1] = found.T
    turn = np.diff(flags, axis=1)
    row, a = np.nonzero(turn == 1)
    b = np.nonzero(turn == -1)[1]
    start = np.array(first)[row] + a - top[row]
    return row.tolist(), start.tolist(), (start + (b - a) + length - 1).tolist()


def _panels(batches: Iterator[pa.RecordBatch], length: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Spans of rows sorted by anchor: whole anchors are taken together until they make a panel."""
    held: list[tuple] = []

    def spans(own: list[tuple]) -> pa.RecordBatch:
        _, rows, first, before, ranges = zip(*own, strict=True)
        row, start, end = panel_spans(list(first), list(before), list(ranges), length, anchor)
        return pa.RecordBatch.from_arrays([pa.array([rows[i] for i in row], pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["row", "start", "end"])

    for batch in batches:
        for entry in zip(*(batch.column(c).to_pylist() for c in ("anchor", "row", "first", "before", "bytes")), strict=True):
            if len(held) >= PANEL and entry[0] != held[-1][0]:
                yield spans(held)
                held = []
            held.append(entry)
    if held:
        yield spans(held)


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The hash of each string of the ranges."""
    for batch in batches:
        for row, first, raw in zip(*(batch.column(c).to_pylist() for c in ("row", "first", "bytes")), strict=True):
            n = len(raw) - length + 1
            hashes = [xxhash.xxh3_128_digest(raw[i : i + length]) for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array(range(first, first + n), pa.int32()), pa.array(hashes, pa.binary())], ["row", "start", "hash"])


def merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs of bytes; spans that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        out = [merge([(s["start"], s["end"]) for s in row]) for row in batch.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array([[{"start": a, "end": b} for a, b in r] for r in out], runs), pa.array([sum(b - a for a, b in r) for r in out], pa.int64())], ["row", "runs", "n_removed"]
        )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, runs in zip(batch.column("text"), batch.column("runs").to_pylist(), strict=True):
            raw, own, at = text.as_py().encode(), hashlib.sha256(), 0
            for r in runs:
                own.update(raw[at : r["start"]])
                at = r["end"]
            own.update(raw[at:])
            out.append(own.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out)], ["row", "kept"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, anchor: int | None = None, panel: int = PANEL) -> tuple[DataFrame, DataFrame]:
    """The rows (row, id, n_bytes, key, sha256) and their spans (row, start, end), unmerged, in bytes."""
    anchor = anchor or max(1, length // 4)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = own.mapInArrow(partial(_anchors, length=length, anchor=anchor), ANCHORS.format(own.schema["id"].dataType.simpleString()))
    rows = cut(found.withColumn("row", F.monotonically_increasing_id()), "anchors")
    each = rows.select("row", F.explode(F.arrays_zip("anchor", "range", "place", "first", "last")).alias("e")).select("row", "e.*")
    ranges = cut(each.groupBy("anchor", "range").agg(F.count("*").alias("n"), F.min("row").alias("stands")), "ranges")
    again = cut(ranges.groupBy("anchor").agg(F.sum("n").alias("all"), F.sum((F.col("n") == 1).cast("long")).alias("ends")).where("all > 1"), "again")
    told = cut(ranges.join(again, "anchor").select("anchor", "range", "n", "stands", "ends"), "told")
    each = cut(each.join(told, ["anchor", "range"]), "found")
    inner = each.where("n > 1").select("row", F.col("first").alias("start"), (F.col("last") + length).alias("end"))

    # Ranges found once, and of the others that have such an anchor one that stands for its equals.
    entry = ["anchor", "row", "place", "first", "last"]
    standing = each.where("n > 1 and ends > 0 and row = stands").dropDuplicates(["anchor", "range"])
    ends = each.where("n = 1").select(entry).unionByName(standing.select(entry)).join(rows.select("row", "key"), "row")
    wanted = cut(ends.groupBy("key").agg(F.collect_list(F.struct("anchor", "row", "place", "first", "last")).alias("ends")), "ends")
    with keyed_texts(own, wanted) as texts:
        joined = texts.dropDuplicates(["key"]).join(wanted, "key").select("text", "ends")
        contexts = joined.mapInArrow(partial(_contexts, length=length), "anchor long, row long, first int, before int, bytes binary")
        contexts = cut(contexts, "contexts")
    wide = again.where(F.col("all") > panel).select("anchor")
    wide = cut(wide, "wide")
    span = "row long, start int, end int"
    usual = contexts if wide.isEmpty() else contexts.join(wide, "anchor", "left_anti")
    outer = usual.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(partial(_panels, length=length, anchor=anchor), span)
    spans = inner.unionByName(outer)
    if not wide.isEmpty():
        strings = cut(contexts.join(wide, "anchor", "left_semi").mapInArrow(partial(_strings, length=length), "row long, start int, hash binary"), "strings")
        more = cut(strings.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "repeated")
        spans = spans.unionByName(strings.join(more, "hash").select("row", "start", (F.col("start") + length).alias("end")))
    return rows.select("row", "id", "n_bytes", "key", "sha256"), cut(spans, "spans")


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, anchor: int | None = None, panel: int = PANEL) -> DataFrame:
    """(id, key, n_bytes, n_removed, runs, kept_sha256) of each row; ``runs`` are the maximal stretches to remove, in bytes.

    ``key`` is the 128-bit XXH3 of the text.
    """
    rows, spans = repeated_spans(docs, id_col, text_col, length, anchor, panel)
    each = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    merged = cut(each.mapInArrow(_merged, "row long, runs array<struct<start: int, end: int>>, n_removed long"), "merged")
    told = cut(rows.join(merged, "row", "left"), "told")
    partial_ = told.where("n_removed < n_bytes").select("row", "key", "runs")
    with keyed_texts(docs.select(F.col(text_col).alias("text")), partial_) as texts:
        kept = texts.join(partial_, "key").select("row", "text", "runs").mapInArrow(_kept, "row long, kept string").dropDuplicates(["row"])
        kept = cut(kept, "kept")
    gone = F.when(F.col("n_removed") == F.col("n_bytes"), F.sha2(F.lit(""), 256))
    return told.join(kept, "row", "left").select(
        "id", "key", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("runs", F.array().cast("array<struct<start: int, end: int>>")).alias("runs"),
        F.coalesce("kept", gone, "sha256").alias("kept_sha256"),
    )


#: Characters of a word's code, six bits each: two of 2**18 different words have the same one time in 2**18.
CODE = 6
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each word of letters and digits, A-Z folded, as ``CODE`` characters, and the keys of the texts."""
    for batch in batches:
        for _, _, buf, at in text_blocks(batch.column("text"), BLOCK):
            hashes, _, _, text = words(buf, at, ALNUM)
            codes = ALPHABET[((hashes[:, None] >> (U64(6) * np.arange(CODE, dtype=U64))) & U64(63)).astype(np.int64)]
            ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(at) - 1)))).astype(np.int64) * CODE
            raw = buf.tobytes()
            keys = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            column = pa.LargeStringArray.from_buffers(len(keys), pa.py_buffer(ends.tobytes()), pa.py_buffer(codes.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), column.cast(pa.string())], ["id", "text"])


def _passages(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The words within runs of at least so many whole words."""
    for batch in batches:
        out = []
        for row in batch.column("spans").to_pylist():
            runs = merge([(-(-s["start"] // CODE), s["end"] // CODE) for s in row])
            out.append(sum(b - a for a, b in runs if b - a >= least))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.int64())], ["row", "n_passage_words"])


def repeated_passages(docs: DataFrame, text_col: str = "text", least: int = 51) -> DataFrame:
    """(key, n_passage_words): for each text that has any, the words in passages of ``least`` words and more that occur again.

    The same index over the texts' words in place of their bytes: spacing and punctuation don't matter. A
    passage may occur again in the same text. Equal texts have one row; ``key`` is the text's 128-bit XXH3.
    """
    # Written, so that no task needs a process for the codes and another for what is made of them.
    coded = cut(docs.select(F.col(text_col).alias("text")).mapInArrow(_coded, "id binary, text string"), "coded")
    rows, spans = repeated_spans(coded, "id", "text", length=least * CODE)
    each = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    found = each.mapInArrow(partial(_passages, least=least), "row long, n_passage_words long").where("n_passage_words > 0")
    return rows.select("row", F.col("id").alias("key")).join(found, "row").groupBy("key").agg(F.max("n_passage_words").alias("n_passage_words"))
