"""Token counts by heap-and-linked-list byte-pair merging.

Symbols of a pre-token are a doubly linked list and adjacent pairs with a rank lie in a heap; the
pair of lowest rank, leftmost among equals, is popped and merged, its new neighbours are pushed, and
entries whose symbols have changed meanwhile are skipped. The count is the initial symbols less the
merges: no identifiers are made. A pre-token of n bytes takes O(n log n), however long it is.

Counting is a map over batches of rows without a shuffle; each task keeps the counts of the short
pre-tokens it has met, at most ``MEMO`` of them.

Defined results: a null text is empty and has 0 tokens; rows that repeat count each; an empty table
gives no rows; only the two named columns are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the published pattern by which byte-level BPE splits texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens of at most so many characters are remembered, and so many of them.
SHORT, MEMO = 48, 400_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable, else from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}


class Counter:
    """Counts tokens as the tokenizers library does for a byte-level BPE file."""

    def __init__(self, file: str) -> None:
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.letters = [letters[b] for b in range(256)]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marks = special
        self.split = regex.compile(PATTERN).findall
        self.memo: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Tokens of one pre-token."""
        symbols: list[str | None] = [self.letters[b] for b in word.encode()]
        n, ranks = len(symbols), self.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(ranks[p], i, *p) for i in range(n - 1) if (p := (symbols[i], symbols[i + 1])) in ranks]
        heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            merges += 1
            symbols[i], symbols[j] = left + right, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (symbols[i], symbols[k])) in ranks:
                    heappush(heap, (ranks[p], i, *p))
            if (h := before[i]) >= 0 and (p := (symbols[h], symbols[i])) in ranks:
                heappush(heap, (ranks[p], h, *p))
        return n - merges

    def plain(self, text: str) -> int:
        memo, words = self.memo, self.split(text)
        try:
            return sum(map(memo.__getitem__, words))
        except KeyError:
            pass
        total = 0
        for word in words:
            if (n := memo.get(word)) is None:
                n = self.merged(word)
                if len(word) <= SHORT:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[word] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if self.special is None or not any(mark in text for mark in self.marks):
            return self.plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.plain(text[at:])


@lru_cache(2)
def counter(file: str) -> Counter:
    return Counter(file)


def _count(batches: Iterator[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
    own = counter(file)
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "")
        n_tokens = pa.array([own.count(t.as_py()) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pc.binary_length(texts).cast(pa.int64()), n_tokens], ["id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row; ``file`` is a byte-level BPE .json that every executor has."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(partial(_count, file=file), f"id {kind}, n_bytes long, n_tokens long")
