"""Alignment of two tokenizers' tokens of the same texts, and how often each pair of tokens meets.

Both tokenizers cut the same bytes, a space and the text. Tokens are the nodes of a bipartite graph
with an edge wherever an A and a B token overlap; union-find over arrays gives its connected
components, which are exactly the least groups that no token of either side leaves. The members of a
component are then expanded to links: the occurrence pairs of an A and a B token whose ranges end
together, which can only be a component's last ones.

Texts are taken in blocks of whole texts (``BLOCK`` bytes, or one longer text). A block keeps its
distinct pairs of identifiers with their numbers, each text the places of its own pairs among them.
Spark adds the pairs' numbers up over all blocks, joins them back to the blocks that hold them, and a
text's figures are summed beside its block: what is shuffled is distinct pairs of blocks, not links, and
a pair that is in every block is a hot key of a join that Spark may split, never a group.

A's tokens come from a faster library where the driver has proved, from the vocabulary, that both give
the same (``ranked``), and from its own otherwise. Long texts are handed to the tokenizers in pieces cut before single spaces between letters: there both
begin a new token anyway (for B this is read off its vocabulary), so a piece's memory is bounded.

Defined results: texts that are null or empty, or whose tokens' bytes joined differ from a space and the
text (B may change characters), have no tokens: zeros, and '' for the groups. Special tokens' strings are
plain text. Rows that repeat count each; a null id stays; an empty table gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.llm.common import cut, list_array, shuffles_go
from ledgerloom.llm.tokens import PATTERN, byte_letters

#: Bytes of the texts that are aligned at once, and characters of a piece of a text.
BLOCK, PIECE = 4 << 20, 50_000
#: Where both tokenizers begin a token: before a space that stands alone between two letters.
LONE_SPACE = regex.compile(r"(?<=\p{L}) (?=\p{L})")


#: What the faster library takes quadratic time for.
LONG_PART = 1000
LONG_SPACE = re.compile(rf"\s{{{LONG_PART}}}")


def _last_parts(entry: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What merging by rank makes of an entry's bytes before the entry itself."""
    parts = [entry[i : i + 1] for i in range(len(entry))]
    own = ranks[entry]
    while True:
        rank, i = min(((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1)), default=(own, 0))
        if rank >= own:
            return parts
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def ranked_file(file_a: str) -> dict[bytes, int]:
    """The byte strings of A's vocabulary with their identifiers, but for the added tokens."""
    with open(file_a, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {letter: b for b, letter in byte_letters().items()}
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(byte_of[c] for c in entry): i for entry, i in spec["model"]["vocab"].items() if entry not in special}


@lru_cache(4)
def ranked(file_a: str) -> dict[bytes, int] | None:
    """The byte strings of A's vocabulary with their identifiers, if merging by the least identifier gives A's tokens; else None.

    It does where texts are split by the published pattern alone, bytes come before the merges' results, these are
    numbered in the merges' order, and each entry, by itself, comes to the two parts of its own merge: merges inside
    an entry's bytes don't depend on what is around them, so no other pair ever makes that entry.
    """
    with open(file_a, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    byte_of = {letter: b for b, letter in byte_letters().items()}
    said = lambda entry: bytes(byte_of[c] for c in entry)
    pairs = [tuple(map(said, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    ranks = ranked_file(file_a)
    merged = [ranks.get(a + b) for a, b in pairs]
    singles = [ranks.get(bytes([b])) for b in range(256)]
    if None in merged or None in singles or len(ranks) != 256 + len(pairs) or [*sorted(singles), *merged] != sorted({*singles, *merged}):
        return None
    return ranks if all(_last_parts(a + b, ranks) == [a, b] for a, b in pairs) else None


class Tokenizers:
    """Both tokenizers, with the bytes of each of their entries; ``fast`` says that A's file is ``ranked``."""

    def __init__(self, file_a: str, file_b: str, fast: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.fast = None
        if fast:
            import tiktoken

            self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranked_file(file_a), special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        byte_of = {letter: b for b, letter in byte_letters().items()}
        self.bytes_a = [b""] * (1 + max(self.a.get_vocab().values()))
        for entry, i in self.a.get_vocab().items():
            if all(c in byte_of for c in entry):
                self.bytes_a[i] = bytes(byte_of[c] for c in entry)
        piece = self.b.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:-1], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in own]) for own in (self.bytes_a, self.bytes_b))
        #: Whether no entry of B goes on after a space inside it.
        self.cuts = not any(" " in entry.lstrip(b" ").decode("latin-1") for entry in self.bytes_b)
        spelled = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        #: Identifiers in decimal with the mark that follows: 3 * id + 0, 1, 2 for ``,`` ``|`` ``;``.
        self.spelled = [s + mark for s in spelled for mark in ",|;"]

    def pieces(self, text: str) -> list[str]:
        """The text cut before lone spaces, these left out: A gets a space before each piece, and B adds one."""
        if len(text) <= PIECE or not self.cuts:
            return [text]
        out, at = [], 0
        while len(text) - at > PIECE and (m := LONE_SPACE.search(text, at + PIECE)):
            out.append(text[at : m.start()])
            at = m.end()
        return [*out, text[at:]]

    def encode_a(self, piece: str) -> list[int]:
        if self.fast is None or max(map(len, piece.split()), default=0) >= LONG_PART or LONG_SPACE.search(piece):
            return self.a.encode(piece, add_special_tokens=False).ids
        return self.fast.encode_ordinary(piece)

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Identifiers of A and of B of each text; none where they don't spell a space and the text."""
        for text in texts:
            a: list[int] = []
            b: list[int] = []
            for piece in self.pieces(text) if text else ():
                a += self.encode_a(f" {piece}")
                b += self.b.encode(piece, num_threads=1)
            own = f" {text}".encode() if text else b""
            same = b"".join(map(self.bytes_a.__getitem__, a)) == own == b"".join(map(self.bytes_b.__getitem__, b))
            yield (a, b) if same else ([], [])


@lru_cache(2)
def tokenizers(file_a: str, file_b: str, fast: bool = False) -> Tokenizers:
    return Tokenizers(file_a, file_b, fast)


def united(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over arrays: the least node of the component of each of ``n`` nodes under the edges (u, v)."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up


class Aligned(NamedTuple):
    """Of the texts of a block: the group of each token, groups being numbered in order, and the groups' last tokens."""

    group_a: np.ndarray
    group_b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray


def aligned(ends_a: np.ndarray, ends_b: np.ndarray) -> Aligned:
    """Groups of tokens that end at the given bytes; both sides cover the same bytes."""
    n_a, n_b = len(ends_a), len(ends_b)
    if not n_a:
        none = np.empty(0, np.int64)
        return Aligned(none, none, none, none)
    first = np.searchsorted(ends_b, np.concatenate(([0], ends_a[:-1])), "right")
    count = np.searchsorted(ends_b, ends_a, "left") - first + 1
    u = np.repeat(np.arange(n_a), count)
    v = np.arange(len(u)) - np.repeat(np.cumsum(count) - count - first, count)
    root = united(n_a + n_b, u, v + n_a)
    number = np.cumsum(root[:n_a] == np.arange(n_a)) - 1  # a component's least node is its first A token
    group = number[root]
    group_a, group_b = group[:n_a], group[n_a:]
    last = lambda side: np.flatnonzero(np.diff(side, append=-1))
    return Aligned(group_a, group_b, last(group_a), last(group_b))


class Block(NamedTuple):
    """The tokens of some texts: identifiers, where each text's begin (one more for the end), and the alignment."""

    a: np.ndarray
    b: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray
    found: Aligned


def block_of(own: Tokenizers, texts: list[str]) -> Block:
    sides_a, sides_b = [], []
    for a, b in own.encode(texts):
        sides_a.append(np.array(a, np.int64))
        sides_b.append(np.array(b, np.int64))
    at_a, at_b = (np.concatenate(([0], np.cumsum([len(x) for x in side]))).astype(np.int64) for side in (sides_a, sides_b))
    a, b = np.concatenate(sides_a), np.concatenate(sides_b)
    return Block(a, b, at_a, at_b, aligned(np.cumsum(own.size_a[a]), np.cumsum(own.size_b[b])))


def spell(own: Tokenizers, block: Block) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each text: a group's A identifiers, its B identifiers, then the next group."""
    group_a, group_b, last_a, last_b = block.found
    n_a = np.diff(last_a, prepend=-1)
    n_b = np.diff(last_b, prepend=-1)
    begin = np.cumsum(n_a + n_b) - n_a - n_b
    codes = np.empty(len(group_a) + len(group_b), np.int64)
    mark_a, mark_b = np.zeros(len(group_a), np.int64), np.zeros(len(group_b), np.int64)
    mark_a[last_a], mark_b[last_b] = 1, 2
    codes[begin[group_a] + np.arange(len(group_a)) - (last_a + 1 - n_a)[group_a]] = 3 * block.a + mark_a
    codes[(begin + n_a)[group_b] + np.arange(len(group_b)) - (last_b + 1 - n_b)[group_b]] = 3 * block.b + mark_b
    at, said = block.at_a + block.at_b, own.spelled.__getitem__
    return ["".join(map(said, codes[lo:hi].tolist()))[:-1] for lo, hi in zip(at[:-1], at[1:])]


def _blocks(batches: Iterator[pa.RecordBatch], files: tuple[str, str, bool]) -> Iterator[tuple[pa.Array, Block, Tokenizers]]:
    own = tokenizers(*files)
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(texts):
            before = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, before + BLOCK, "right")))
            yield batch.column("id")[lo:hi], block_of(own, texts[lo:hi].to_pylist()), own
            lo = hi


def _spelled(batches: Iterator[pa.RecordBatch], files: tuple[str, str, bool]) -> Iterator[pa.RecordBatch]:
    for ids, block, own in _blocks(batches, files):
        yield pa.RecordBatch.from_arrays([ids, pa.array(spell(own, block), pa.string())], ["id", "groups"])


def token_groups(docs: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, groups) of each row: its groups spelled as ``a1,a2|b1;a3|b2,b3`` in decimal identifiers."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(partial(_spelled, files=(file_a, file_b, ranked(file_a) is not None)), f"id {own.schema['id'].dataType.simpleString()}, groups string")


def _counted(batches: Iterator[pa.RecordBatch], files: tuple[str, str, bool], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row for each text, with the places of its pairs in the block's list, and one for that list."""
    number = TaskContext.get().partitionId() << 32
    for ids, block, own in _blocks(batches, files):
        n, (_, _, last_a, last_b) = len(ids), block.found
        codes, slot, totals = np.unique(block.a[last_a] << 32 | block.b[last_b], return_inverse=True, return_counts=True)
        at = np.searchsorted(last_a, block.at_a)  # a text's last token ends a group
        text_of = np.repeat(np.arange(n), np.diff(at))
        held, times = np.unique(text_of * (len(codes) + 1) + slot, return_counts=True)
        each = np.bincount(held // (len(codes) + 1), minlength=n)
        n_a, n_b, n_groups = np.diff(block.at_a), np.diff(block.at_b), np.diff(at)
        digests = [sha256(s.encode()).hexdigest() if s else "" for s in spell(own, block)]
        slots = list_array(pa.array((held % (len(codes) + 1)).astype(np.int32)), each)
        lists = [slots, list_array(pa.array(times.astype(np.int32)), each)]
        rest = [pa.nulls(n, schema.field(name).type) for name in ("pairs", "totals")]
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(n, number)), *map(pa.array, (n_a, n_b, n_groups)), pa.array(digests), *lists, *rest], schema=schema)
        if len(codes):
            own_row = [pa.array([number]), *(pa.nulls(1, schema.field(i).type) for i in range(2, 8)), *(list_array(pa.array(x.astype(np.int64)), np.array([len(x)])) for x in (codes, totals))]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, schema.field("id").type), *own_row], schema=schema)
        number += 1


def _summed(texts: pa.Table, pairs: pa.Table, schema: pa.Schema) -> pa.Table:
    """Texts of a block with the sums over their links of what is known of the block's pairs."""
    place = pairs.column("slot").to_numpy()
    n, best = np.zeros((2, len(place)), np.int64)
    n[place], best[place] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy()
    held, times = (texts.column(c).combine_chunks() for c in ("slots", "times"))
    at = np.concatenate(([0], np.cumsum(pc.list_value_length(held).to_numpy(zero_copy_only=False)))).astype(np.int64)
    held, times = (x.flatten().to_numpy(zero_copy_only=False) for x in (held, times))
    sums = [pa.array(np.diff(np.concatenate(([0], np.cumsum(times * known[held])))[at]), pa.int64()) for known in (best, n)]
    plain = [texts.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_groups")]
    return pa.table([*plain, *sums, texts.column("groups_sha256")], schema=schema)


def align_tokenizers(docs: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """What each text's alignment has, and the pairs of identifiers with their numbers of links over all texts.

    First (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): ``n_best`` links have a pair
    whose number is the highest of its B identifier's, and ``count_sum`` adds up the numbers of the links'
    pairs. Then (a_id, b_id, n, best). ``file_a`` is a byte-level BPE .json and ``file_b`` a sentencepiece
    model, both at places that every executor has.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    columns = "block long, n_a long, n_b long, n_groups long, groups_sha256 string, slots array<int>, times array<int>, pairs array<long>, totals array<long>"
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64())] * 2
    id_kind = own.schema["id"].dataType
    id_field = pa.field("id", to_arrow_type(id_kind))
    schema = pa.schema([id_field, *(pa.field(c.split()[0], kind) for c, kind in zip(columns.split(", "), kinds))])
    table = cut(own.mapInArrow(partial(_counted, files=(file_a, file_b, ranked(file_a) is not None), schema=schema), f"id {id_kind.simpleString()}, {columns}"), "aligned")
    listed = table.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "totals")).alias("slot", "x"))
    held = listed.select("block", "slot", F.col("x.pairs").alias("pair"), F.col("x.totals").alias("total"))
    summed = cut(held.groupBy("pair").agg(F.sum("total").alias("n")), "pair-numbers")
    summed = summed.withColumn("b_id", F.col("pair").bitwiseAND(0xFFFFFFFF))
    most = summed.groupBy("b_id").agg(F.max("n").alias("most"))
    numbers = cut(summed.join(most, "b_id").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "pair-best")
    known = held.join(numbers, "pair").select(F.col("block").alias("held_by"), "slot", "n", "best")
    texts = table.where("pairs is null").drop("pairs", "totals")
    out = pa.schema([id_field, *(pa.field(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), pa.field("groups_sha256", pa.string())])
    said = f"id {id_kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    with shuffles_go(docs.sparkSession):
        rows = texts.groupBy("block").cogroup(known.groupBy("held_by")).applyInArrow(partial(_summed, schema=out), said)
    pairs = numbers.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"), "n", (F.col("best") == 1).alias("best"))
    return rows, pairs
