"""MinHash fingerprints of documents, their likeness, and near copies found by signature bands.

A text's set holds its shingles of five words (A-Z read as a-z; of fewer words, all of them as one). Each of
``PERMUTATIONS`` multiply-add hashes orders the shingles, and a signature is the least value under each, computed
for a block of texts at a time. A fingerprint is one byte of each least value, in hex. The share of equal bytes,
less what chance gives, estimates the Jaccard similarity of two sets: the standard error is 0.044 at worst.

``BANDS`` keys of ``ROWS`` least values each lead from a text to its near copies. Spark gathers the least
document of each key, joins it with the key's others, and the exact Jaccard similarity of both texts' sets is
verified. A band of any size costs its documents' rows: pairs within a band are never made. These links are where the
exact join of ``simjoin`` begins: it finds those that share no band, or no near head, and gives each document its class.

``edited_fingerprints`` compares each document with the next one. Spark deals the documents out by ranges of
descending id, so that the next document is the next row; the last row of a partition and the first of the
one after it are kept aside in a small table (two rows a partition) and joined. Texts are shuffled once.

Defined results: a null text is empty; an empty text has an empty set, all of which are alike (1.0) and like no
other (0.0). Rows of equal ids are ordered by text; null ids come last. Rows that repeat count each. A table of one row
is its own next. An empty table gives no rows. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.llm.common import BLOCK, SPACED, U64, cut, list_array, mix, scratch, text_blocks, words
from ledgerloom.llm.simjoin import text_components
from ledgerloom.llm.sketch import keyed_texts

#: Words of a shingle, and the least similarity of near copies.
SHINGLE, LEAST_JACCARD = 5, 0.75
PERMUTATIONS, BANDS, ROWS = 128, 21, 6
#: Multipliers (odd) and addends of the hashes, from one seed.
_SEED = np.random.default_rng(20_131)
MULTIPLIERS = _SEED.integers(0, 1 << 64, PERMUTATIONS, dtype=U64) | U64(1)
ADDENDS = _SEED.integers(0, 1 << 64, PERMUTATIONS, dtype=U64)
#: Of two different least values so many bytes are equal by chance.
CHANCE = 1 / 256
NOTHING = U64((1 << 64) - 1)


def shingles(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of the texts of a block, one after another, and where each text's begin (one more for the end)."""
    hashes, _, _, text = words(buf, at, SPACED)
    n = np.bincount(text, minlength=len(at) - 1)
    begin = np.concatenate(([0], np.cumsum(np.where(n >= SHINGLE, n - SHINGLE + 1, n > 0))))
    alone = np.zeros(begin[-1], bool)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    alone[begin[short]] = True
    total = np.zeros(begin[-1], U64)
    if (windows := len(hashes) - SHINGLE + 1) > 0:
        rolled = hashes[:windows]
        for k in range(1, SHINGLE):
            rolled = rolled * U64(0xD1342543DE82EF95) + hashes[k : k + windows]
        total[~alone] = rolled[text[:windows] == text[SHINGLE - 1 :]]
    # A short text's words are followed by the numbers of the places that are left.
    first, sums = (np.cumsum(n) - n)[short], np.zeros(len(short), U64)
    for k in range(SHINGLE if len(short) else 0):
        sums = sums * U64(0xD1342543DE82EF95) + np.where(k < n[short], hashes[np.minimum(first + k, len(hashes) - 1)], U64(k))
    total[alone] = sums
    return mix(total), begin


def signatures(texts: pa.Array) -> np.ndarray:
    """The least value of each text's shingles under each hash; ``NOTHING`` throughout for an empty set."""
    out = np.full((len(texts), PERMUTATIONS), NOTHING)
    for lo, hi, buf, at in text_blocks(texts, BLOCK):
        values, begin = shingles(buf, at)
        full = np.flatnonzero(np.diff(begin))
        if len(full):
            own = np.empty(len(values), U64)
            for k in range(PERMUTATIONS):
                np.multiply(values, MULTIPLIERS[k], out=own)
                own += ADDENDS[k]
                out[lo + full, k] = np.minimum.reduceat(own, begin[full])
    return out


def marks(signature: np.ndarray) -> np.ndarray:
    """A byte for each least value: the fingerprints of some signatures."""
    return (mix(signature) & U64(255)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated similarity of fingerprints in rows; empty sets are like each other only."""
    share = (a == b).mean(axis=1)
    found = np.clip((share - CHANCE) / (1 - CHANCE), 0.0, 1.0)
    nothing = marks(np.full((1, PERMUTATIONS), NOTHING))
    empty_a, empty_b = (a == nothing).all(axis=1), (b == nothing).all(axis=1)
    return np.where(empty_a != empty_b, 0.0, found)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of each signature."""
    own = signature[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    total = np.broadcast_to(np.arange(BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15), own.shape[:2]).copy()
    for k in range(ROWS):
        total = mix(total * U64(0xD1342543DE82EF95) + own[:, :, k])
    return total.view(np.int64)


def hexed(rows: np.ndarray) -> list[str]:
    spelled, size = rows.tobytes().hex(), 2 * rows.shape[1]
    return [spelled[i : i + size] for i in range(0, len(spelled), size)]


def text_keys(texts: pa.Array) -> pa.Array:
    """The keys by which ``keyed_texts`` knows texts."""
    return pa.array([xxhash.xxh3_128_digest(t) for t in texts.cast(pa.large_binary()).to_pylist()], pa.binary())


def _bands(signature: np.ndarray) -> pa.Array:
    """The band keys of each text; none for an empty set."""
    full = (signature != NOTHING).any(axis=1)
    return list_array(pa.array(band_keys(signature[full]).reshape(-1)), full * BANDS)


def _printed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "")
        signature = signatures(texts)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(hexed(marks(signature))), text_keys(texts), _bands(signature)], schema=schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, key, bands) of each row, by a map without a shuffle; ``key`` is of the text's bytes."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("fingerprint", pa.string()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])
    return own.mapInArrow(partial(_printed, schema=schema), f"id {kind.simpleString()}, fingerprint string, key binary, bands array<bigint>")


#: What is said of each document and the next one, after its id.
SAID = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, key binary, bands array<bigint>"
KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64())]


def _compared(ids: pa.Array, texts: pa.Array, after: pa.Array) -> list[pa.Array]:
    """Columns of ``SAID`` for texts, each with the text after it in ``after``."""
    own, following = texts.to_pylist(), after.to_pylist()
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(own, following, strict=True)]
    digests = [sha256(t.encode()).hexdigest() for t in edited]
    signature = signatures(texts)
    print_, print_edited = marks(signature), marks(signatures(pa.array(edited, pa.string())))
    near_next = likeness(print_, np.concatenate([print_[1:], marks(signatures(after[len(after) - 1 :]))]))
    return [
        ids, pa.array([len(t) for t in own], pa.int64()), pa.array(digests), pa.array(hexed(print_)), pa.array(hexed(print_edited)),
        pa.array(likeness(print_, print_edited)), pa.array(near_next), text_keys(texts), _bands(signature),
    ]


#: Rows that are compared at once; a partition's texts are never all in memory.
ROWS_AT_ONCE = 2_000


def _in_order(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of a partition in order, each compared with the next; the first and the last one's texts are told besides."""
    part, ids, texts, first = TaskContext.get().partitionId(), None, None, None
    edge = lambda kind, i, t: pa.RecordBatch.from_arrays([i, *(pa.nulls(1, f.type) for f in list(schema)[1:-3]), pa.array([part], pa.int64()), pa.array([kind]), t], schema=schema)
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
            new_ids, new_texts = batch.column("id")[lo : lo + ROWS_AT_ONCE], pc.fill_null(batch.column("text")[lo : lo + ROWS_AT_ONCE], "")
            if first is None:
                first = edge("first", new_ids[:1], new_texts[:1])
                yield first
                ids, texts = new_ids, new_texts
            else:
                ids, texts = pa.concat_arrays([ids, new_ids]), pa.concat_arrays([texts, new_texts])
            if (n := len(ids)) > 1:
                rest = [pa.nulls(n - 1, f.type) for f in list(schema)[-3:]]
                yield pa.RecordBatch.from_arrays([*_compared(ids[:-1], texts[:-1], texts[1:]), *rest], schema=schema)
            ids, texts = ids[-1:], texts[-1:]
    if first is not None:
        yield edge("last", ids, texts)


def _across(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield pa.RecordBatch.from_arrays(_compared(*(batch.column(c)[i : i + 1] for c in ("id", "text", "after"))), schema=schema)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: its fingerprint, that of its edited text, and its likeness to that and to the next document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of the
    next document's by descending id; after the last comes the first. Columns: id and those of ``SAID``.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = own.schema["id"].dataType
    order = [F.col("id").desc_nulls_last(), F.col("text")]
    names = [c.split()[0] for c in SAID.split(", ")]
    plain = pa.schema([pa.field("id", to_arrow_type(kind)), *(pa.field(n, k) for n, k in zip(names, KINDS, strict=True))])
    wide = pa.schema([*plain, ("part", pa.int64()), ("edge", pa.string()), ("text", pa.string())])
    dealt = own.repartitionByRange(order[0]).sortWithinPartitions(*order)
    table = cut(dealt.mapInArrow(partial(_in_order, schema=wide), f"id {kind.simpleString()}, {SAID}, part long, edge string, text string"), "in-order")
    firsts = table.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("after"))
    lasts = table.where("edge = 'last'").select("id", "part", "text")
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbers = lasts.select("part")  # one row a partition
    following = numbers.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(parts)).alias("next_part"))
    pairs = lasts.join(following, "part").join(firsts, "next_part").select("id", "text", "after")
    stitched = pairs.mapInArrow(partial(_across, schema=plain), f"id {kind.simpleString()}, {SAID}")
    return table.where("edge is null").drop("part", "edge", "text").unionByName(stitched)


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = np.zeros(batch.num_rows)
        # Each text is followed by its head's; a row is compared as soon as both sets are made.
        row = pa.array(np.arange(2 * batch.num_rows).reshape(2, -1).T.reshape(-1))
        texts = pa.concat_arrays([batch.column(c).cast(pa.large_string()) for c in ("text", "head_text")]).take(row)
        first = None
        for lo, hi, buf, at in text_blocks(texts, BLOCK):
            value, begin = shingles(buf, at)
            for k in range(hi - lo):
                own = np.unique(value[begin[k] : begin[k + 1]])
                if (lo + k) % 2 == 0:
                    first = own
                    continue
                both = np.concatenate((first, own))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                near[(lo + k) // 2] = shared / max(1, len(both) - shared)
        own = ["key", "head_key", "head_id"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, own), pa.array(near)], [*own, "jaccard"])


def band_heads(docs: DataFrame, printed: DataFrame, text_col: str = "text", least: float = LEAST_JACCARD) -> DataFrame:
    """(key, head_key, head_id): the near copies among texts and the heads of their bands.

    ``printed`` has id, key and bands of the rows of ``docs``. The head of a band is its document of least id; a text
    heads its own bands only where no other comes first. A near copy has a Jaccard similarity of ``least`` or
    more, computed from the texts. These are links that a fingerprint finds at once, not all: see ``near_heads``.
    """
    kind = printed.schema["id"].dataType.simpleString()
    texts = cut(printed.where(F.size("bands") > 0).groupBy("key").agg(F.min("id").alias("id"), F.first("bands").alias("bands")), "texts")
    keys = texts.where("id is not null").select("key", "id", F.explode("bands").alias("band"))
    heads = cut(keys.groupBy("band").agg(F.min("id").alias("head_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "head_id"), "heads")
    # What shares a band with another is little beside all keys: the heads' texts are looked up among that.
    shared = cut(keys.join(heads, "band"), "shared-bands")
    first = cut(shared.where("id = head_id").groupBy("band").agg(F.min("key").alias("head_key")), "head-keys")
    pairs = cut(shared.join(first, "band").where("key <> head_key").select("key", "head_key", "head_id").distinct(), "band-pairs")
    wanted = pairs.select("key").union(pairs.select("head_key")).distinct()
    with keyed_texts(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), wanted) as found:
        once = cut(found.groupBy("key").agg(F.first("text").alias("text")), "band-texts")
    with_own = pairs.join(once, "key")
    both = with_own.join(once.select(F.col("key").alias("head_key"), F.col("text").alias("head_text")), "head_key")
    verified = both.select("key", "head_key", "head_id", "text", "head_text").mapInArrow(_jaccard, f"key binary, head_key binary, head_id {kind}, jaccard double")
    return verified.where(F.col("jaccard") >= least).drop("jaccard")


def near_heads(docs: DataFrame, printed: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``printed`` with ``near_id`` and ``near_class``.

    ``near_class`` is the least id that the row's text reaches by near copies of near copies, its own included, and loses no
    link: those that the bands lead to are completed by the exact join of ``simjoin``. An empty set reaches none but its row,
    and null ids count where a class has no other. ``near_id`` names one near copy: the least id that has the row's
    text, or heads a band of it and is a near copy; null where that is no other.

    Intermediate tables that this makes itself go at the end.
    """
    spark = docs.sparkSession
    with scratch(spark):
        links = cut(band_heads(docs, printed, text_col), "near", keep=True)
    with scratch(spark):
        classes = text_components(docs, links.select(F.col("key").alias("a"), F.col("head_key").alias("b")), id_col, text_col, SHINGLE, round(100 * LEAST_JACCARD))
        found = links.groupBy("key").agg(F.min("head_id").alias("near_id"))
        first = printed.groupBy("key").agg(F.min("id").alias("first_id"), F.first(F.size("bands") == 0).alias("bare"))
        told = cut(first.join(found, "key", "left").join(classes, "key"), "told", keep=True)
    joined = printed.drop("bands").join(told, "key")
    least = F.least("first_id", "near_id")
    near, own = F.when(least < F.col("id"), least), F.when(F.col("bare"), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(*[c for c in printed.columns if c not in ("key", "bands")], near.alias("near_id"), own.alias("near_class"))
