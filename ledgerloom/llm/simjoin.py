"""Jaccard join of word n-gram sets and its components, by set-relation skipping.

The join is exact: two documents link when intersection over union of their sets reaches the
threshold. Sets are ordered by a rough frequency, rarest first; sets that link share one of the first
``n - ceil(t n) + 1`` elements of that order (their prefixes), which make an index of lists.

Skipping by position: an entry of a list knows its set's size and its place in the order. What two sets
can still share from a common element on is at most what the shorter rest holds; entries are blocked
by size, the smaller set of a pair must have the element within the first seventh (for 0.75), and pairs
of entries whose rests are too short are skipped.

Skipping by answers: sets that are likely alike (equal MinHash values) are first compared with a few
others each, and linked sets form classes. A list all of whose sets are in one class is
skipped as a whole, and in others only pairs of sets of different classes are looked at: that a set
belongs with its likes answers for all the pairs among them.

Answers from a like set's answers: sets that share MinHash values with one set form its family, whether
they link or not. A large family isn't paired set by set. It is cut into portions; of the first set of a
portion, what it has in common with a given set is computed, and the others' answers follow from how they
differ from the first: |T & S| = |T & B| - |B - S| + |(B - T) & (B - S)| + |(T - B) & (S - B)|. A list of a
family whose sets are all of the class of the given one is skipped. Only pairs of small families are
verified one by one.

Frequencies come from counts by hash cell of all sets of the corpus, an array of fixed size; any order
gives the same result, the counts only keep frequent passages out of the prefixes.

Defined results: a text without words (null, empty, white space) has the empty set and links with
nothing; one of fewer words than n has its whole sequence as its only element; component_id is the
least id in the component, null ids not counted unless all are null; repeated rows are equal sets and
so linked; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import BLOCK, SPACED, U64, cut, list_array, mix, scratch, text_blocks, words
from ledgerloom.llm.components import components
from ledgerloom.llm.exact import may_hold
from ledgerloom.llm.sketch import NumberFilter, counted, keyed_texts, pieces

#: Elements are counted by the top bits of their hashes, in two bytes for each cell.
CELLS = 1 << 24
CELL_SHIFT = U64(64 - 24)
MINS = 12
#: MinHash values that two sets share if they are compared before the lists are read, and partners of a set then.
LIKELY, PARTNERS = 5, 6
#: MinHash values that a set shares with the one that its family is named after.
FAMILY = 3
#: Sets are verified in portions of about so many, and sets that are held against a portion in parts of so many.
PORTION, PART = 400, 4000
#: Sets of a family that is met as a whole.
LARGE = 50
#: Parts of the elements whose lists are gathered one after another: so much less of them is on disk at a time.
PASSES = 4
#: Sets that a task remembers to have met.
REMEMBERED = 200_000
SETS = "id {0}, n long, key binary, signature binary, mins array<long>, prefix array<long>"


def shingles(buf: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts of a block, by text and value: values, and the text of each."""
    hashes, _, _, text = words(buf, at, SPACED)
    factors = mix(np.arange(1, n + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)
    count = np.bincount(text, minlength=len(at) - 1)
    first = np.cumsum(count) - count
    values, owner = [], []
    if (windows := len(hashes) - n + 1) > 0:
        own = text[:windows] == text[n - 1 :]
        values.append(sum(hashes[j : j + windows] * factors[j] for j in range(n))[own])
        owner.append(text[:windows][own])
    for size in range(1, n):
        short = np.flatnonzero(count == size)
        values.append(sum((hashes[first[short] + j] * factors[j] for j in range(size)), np.full(len(short), size, U64)))
        owner.append(short)
    value, of = mix(np.concatenate(values)), np.concatenate(owner)
    if (of[1:] < of[:-1]).any():
        order = np.argsort(of, kind="stable")
        value, of = value[order], of[order]
    bound = np.searchsorted(of, np.arange(len(at))).tolist()
    for lo, hi in pairwise(bound):
        if hi - lo > 1:
            value[lo:hi].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[new], of[new]


def _count(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    cells, seen = np.zeros(CELLS, np.uint16), 0
    for batch in batches:
        for _, _, buf, at in text_blocks(batch.column("text"), BLOCK):
            value, _ = shingles(buf, at, n)
            own, times = np.unique((value >> CELL_SHIFT).astype(np.int32), return_counts=True)
            cells[own] = np.minimum(cells[own] + times, 65535)
            seen += len(value)
    yield from pieces(cells, seen % 8)


def levels(cells: np.ndarray) -> np.ndarray:
    """0 for cells of common size; for those above, how often twice the excess that chance explains."""
    middle = float(cells.mean())
    slack = 6 * np.sqrt(middle) + 6
    over = np.maximum((np.arange(65536) - middle) / slack, 1e-9)
    return np.where(over <= 1, 0, np.minimum(15, 1 + np.log2(np.maximum(over, 1)))).astype(np.uint8)[cells]


def _sets(batches: Iterator[pa.RecordBatch], n: int, threshold: float, sent: Broadcast) -> Iterator[pa.RecordBatch]:
    level = sent.value
    seeds = mix(np.arange(1, MINS + 1, dtype=U64) * U64(0xA0761D6478BD642F))
    seen: set[bytes] = set()
    for batch in batches:
        for lo, hi, buf, at in text_blocks(batch.column("text"), BLOCK):
            value, of = shingles(buf, at, n)
            size = np.bincount(of, minlength=hi - lo)
            end = np.cumsum(size)
            full = np.flatnonzero(size)
            mins = np.stack([np.minimum.reduceat(mix(value ^ s), (end - size)[full]) for s in seeds], axis=1) if len(full) else np.empty((0, MINS), U64)
            # Rarest first, then by value, text after text.
            rank = of * 16 + level[(value >> CELL_SHIFT).astype(np.int64)]
            if hi - lo <= 4096:
                rank = rank.astype(np.uint16)  # numpy sorts these by digits
            ordered = value[np.argsort(rank, kind="stable")].view(np.int64)
            keep = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
            raw, whole = buf.tobytes(), value.tobytes()
            keys, signatures, met = [], [], size == 0
            for k, (a, b, begin, stop) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), (end - size).tolist(), end.tolist(), strict=True)):
                keys.append(xxhash.xxh3_128_digest(raw[a:b]))
                if begin == stop:
                    signatures.append(None)
                    continue
                signatures.append(s := xxhash.xxh3_128_digest(whole[8 * begin : 8 * stop]))
                # A set that this task has met before stands for its equals.
                met[k] = s in seen
                if len(seen) < REMEMBERED:
                    seen.add(s)
            keep[met] = 0
            prefix = ordered[np.arange(len(of)) - (end - size)[of] < keep[of]]
            all_mins = list_array(pa.array(mins.view(np.int64).reshape(-1)), np.where(size > 0, MINS, 0), size == 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), all_mins, list_array(pa.array(prefix), keep, met)],
                ["id", "n", "key", "signature", "mins", "prefix"],
            )


class Lists:
    """Values of several sets as one index of lists."""

    def __init__(self, sets: list[tuple[int, np.ndarray]], of: int) -> None:
        values = np.concatenate([x for _, x in sets]) if sets else np.empty(0, U64)
        owner = np.repeat([k for k, _ in sets], [len(x) for _, x in sets]).astype(np.int64)
        order = np.argsort(values, kind="stable")
        self.values, self.owner, self.of = values[order], owner[order], of

    def common(self, theirs: np.ndarray) -> np.ndarray:
        """How many of the values each set has."""
        lo, hi = np.searchsorted(self.values, theirs, "left"), np.searchsorted(self.values, theirs, "right")
        n = hi - lo
        return np.bincount(self.owner[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], minlength=self.of)


def differences(base: np.ndarray, other: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Of two sorted sets the size of what they share, what only the second has, and what only the first has."""
    at = np.minimum(np.searchsorted(base, other), len(base) - 1)
    both = base[at] == other
    alone = np.ones(len(base), bool)
    alone[at[both]] = False
    return int(both.sum()), other[~both], base[alone]


class Hubs:
    """The sets of a portion: the first as it is, those like it by their differences from it, others whole."""

    def __init__(self) -> None:
        self.rows: list[int] = []
        self.classes: list[int] = []
        self.sets: list[np.ndarray] = []
        self.sizes: np.ndarray | None = None

    def add(self, row: int, class_: int, values: np.ndarray) -> None:
        self.rows.append(row)
        self.classes.append(class_)
        self.sets.append(values.copy())
        self.sizes = None

    def _index(self) -> None:
        more, less, whole = [], [], []
        self.shared = np.zeros(len(self.sets), np.int64)
        self.like = np.zeros(len(self.sets), bool)
        for k, own in enumerate(self.sets):
            same, plus, minus = differences(self.sets[0], own)
            if len(plus) + len(minus) < len(own):
                self.like[k], self.shared[k] = True, same
                more.append((k, plus))
                less.append((k, minus))
            else:
                whole.append((k, own))
        self.more, self.less, self.whole = (Lists(x, len(self.sets)) for x in (more, less, whole))
        self.sizes = np.array([len(x) for x in self.sets])
        self.distinct = set(self.classes)

    def links(self, theirs: np.ndarray, percent: int) -> np.ndarray:
        """Which of the sets link with another; the first set's answer is computed, the others' follow from it."""
        if self.sizes is None:
            self._index()
        same, plus, minus = differences(self.sets[0], theirs)
        # What the first set lacks of itself in the other: |B| - |B & S| for each like set S.
        common = np.where(self.like, same - self.sizes[0] + self.shared, 0)
        if len(self.more.values):
            common += self.more.common(plus)
        if len(self.less.values):
            common += self.less.common(minus)
        if len(self.whole.values):
            common += self.whole.common(theirs)
        return np.flatnonzero((common > 0) & (100 * common >= percent * (self.sizes + len(theirs) - common)))


class Joined:
    """Classes that links have joined within a group."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        while x in self.above:
            x = self.above[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two weren't joined before."""
        x, y = self.root(x), self.root(y)
        if x != y:
            self.above[max(x, y)] = min(x, y)
        return x != y


def _verify(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links among rows sorted by group and role: the hubs of a group come before what is held against them.

    Of the links between classes those are named that join two which no earlier link of the group has joined.
    """
    at_hand, hubs, joined = None, Hubs(), Joined()
    for batch in batches:
        groups = list(zip(*(batch.column(c).to_pylist() for c in ("hub", "portion", "part")), strict=True))
        roles, rows, classes = (batch.column(c).to_pylist() for c in ("role", "row", "class"))
        a, b = [], []
        for lo, hi, buf, at in text_blocks(batch.column("text"), BLOCK):
            value, of = shingles(buf, at, n)
            bound = np.searchsorted(of, np.arange(hi - lo + 1))
            for k in range(hi - lo):
                own, i = value[bound[k] : bound[k + 1]], lo + k
                if groups[i] != at_hand:
                    at_hand, hubs, joined = groups[i], Hubs(), Joined()
                if roles[i] == 0:
                    hubs.add(rows[i], classes[i], own)
                elif hubs.rows:
                    for h in hubs.links(own, percent).tolist():
                        if joined.join(hubs.classes[h], classes[i]):
                            a.append(hubs.rows[h])
                            b.append(rows[i])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _entries(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
    """Entries of the lists that are wanted, and of few others."""
    for batch in batches:
        prefix = batch.column("prefix")
        size = pc.list_value_length(prefix).to_numpy()
        element = prefix.flatten().to_numpy()
        at = np.arange(len(element)) - np.repeat(np.cumsum(size) - size, size)
        take = sent.value.may_hold(element)
        of = pa.array(np.repeat(np.arange(len(size)), size)[take])
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in ("row", "n")), pa.array(at[take]), pa.array(element[take])], ["row", "n", "at", "element"])


class Join:
    """The steps of the join over one table of documents; rows of its sets are numbered."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> None:
        self.spark, self.n, self.percent = docs.sparkSession, n, percent
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        context = self.spark.sparkContext
        sent = context.broadcast(levels(counted(self.docs.select("text"), CELLS, partial(_count, n=n), "uint16")))
        sets = self.docs.mapInArrow(partial(_sets, n=n, threshold=percent / 100, sent=sent), SETS.format(self.docs.schema["id"].dataType.simpleString()))
        self.sets = cut(sets.withColumn("row", F.monotonically_increasing_id()), "sets")
        sent.destroy()

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The (a, b) pairs of rows that link. The text of a goes to each portion of its partners."""
        pairs = cut(pairs.select("a", "b").distinct(), "pairs")
        count = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / PORTION).cast("int").alias("portions"))
        portion = F.pmod(F.xxhash64("b"), F.col("portions")).cast("int").alias("portion")
        spokes = pairs.join(cut(count, "hubs"), "a").select(F.col("a").alias("hub"), portion, F.lit(0).alias("part"), F.lit(1).alias("role"), F.col("b").alias("row"), F.col("b").alias("class"))
        group = spokes.select("hub", "portion", "part").distinct()
        hubs = group.select("hub", "portion", "part", F.lit(0).alias("role"), F.col("hub").alias("row"), F.col("hub").alias("class"))
        return self.dealt(spokes.unionByName(hubs))

    def verify_units(self, pairs: DataFrame, members: DataFrame) -> DataFrame:
        """Links of (row, class, unit) with the members (row, class, unit): portions of a unit against parts of its rows."""
        pairs = cut(pairs.distinct(), "pairs")
        times = lambda df, size, name: df.groupBy("unit").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
        counts = cut(times(pairs, PART, "parts").join(times(members, PORTION, "portions"), "unit"), "portions")
        each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
        own = lambda name: F.pmod(F.xxhash64("row"), F.col(name)).cast("int")
        side = lambda df, portion, part, role: df.join(counts, "unit").select(F.col("unit").alias("hub"), portion.alias("portion"), part.alias("part"), F.lit(role).alias("role"), "row", "class")
        spokes = side(pairs, each("portions"), own("parts"), 1)
        hubs = side(members, own("portions"), each("parts"), 0)
        return self.dealt(spokes.unionByName(hubs))

    def dealt(self, sides: DataFrame) -> DataFrame:
        wanted = cut(sides.join(self.sets.select("row", "key"), "row"), "wanted")
        with keyed_texts(self.docs, wanted) as texts:
            both = wanted.join(texts.dropDuplicates(["key"]), "key").select("hub", "portion", "part", "role", "row", "class", "text")
            sorted_ = both.repartition("hub", "portion", "part").sortWithinPartitions("hub", "portion", "part", "role")
            return cut(sorted_.mapInArrow(partial(_verify, n=self.n, percent=self.percent), "a long, b long"), "verified")

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The (a, b) pairs of rows that can still link by what their whole prefixes share; no text is read for it.

        What two sets share beyond both prefixes lies, as their order is one, beyond the one that ends first.
        Prefixes are compared by 16 bits of each element, and elements of one set that these confuse count as shared.
        """
        pairs = cut(pairs.select("a", "b").distinct(), "sharing")
        bits = F.transform("prefix", lambda x: F.shiftright(F.shiftleft(x, 48), 48).cast("smallint"))
        own = self.sets.where("prefix is not null").select("row", "n", bits.alias("bits"))
        side = lambda name: own.select(F.col("row").alias(name), F.struct("n", "bits").alias(f"of_{name}"))
        both = cut(pairs.join(side("a"), "a"), "one-side").join(side("b"), "b")
        beyond = lambda c: F.col(f"{c}.n") - F.size(f"{c}.bits")
        confused = F.size("of_a.bits") - F.size(F.array_distinct("of_a.bits"))
        most = F.size(F.array_intersect("of_a.bits", "of_b.bits")) + confused + F.greatest(beyond("of_a"), beyond("of_b"))
        t = self.percent
        return cut(both.where((100 + t) * most >= t * (F.col("of_a.n") + F.col("of_b.n"))).select("a", "b"), "possible")

    def rows_of(self, known: DataFrame) -> DataFrame:
        """Links of texts, by their keys in ``known`` (a, b), as links of rows."""
        rows = cut(self.sets.where("signature is not null").groupBy("key").agg(F.min("row").alias("row")), "rows")
        at = lambda name: rows.select(F.col("key").alias(name), F.col("row").alias(f"row_{name}"))
        return cut(known.join(at("a"), "a").join(at("b"), "b").select(F.col("row_a").alias("a"), F.col("row_b").alias("b")), "known")

    def equal_sets(self) -> DataFrame:
        own = self.sets.where("signature is not null").select("signature", "row")
        first = cut(own.groupBy("signature").agg(F.min("row").alias("a"), F.count("*").alias("k")).where("k > 1").drop("k"), "equal")
        return cut(own.join(first, "signature").where("a <> row").select("a", F.col("row").alias("b")), "equals")

    def alike(self, classes: DataFrame, salt: int) -> DataFrame:
        """(a, b, equal): for each set b others a of different classes that share ``FAMILY`` MinHash values and more.

        Each list of equal values stands under two of its sets: one chosen by a hash of list and set, so that
        the sets of a large group get different partners, and one chosen by a hash of the set alone, so that
        they get the same. The pairs are no more than twice the sets' values.
        """
        own = self.sets.where("prefix is not null").select("row", "mins")
        own = own.join(classes.withColumnRenamed("node", "row"), "row", "left").select("row", "mins", F.coalesce("label", "row").alias("class"))
        each = cut(own.select("row", "class", F.posexplode("mins").alias("k", "value")), "mins")
        # Least values of single numbers, which Spark gathers by hash; of rows with equal hashes any will do.
        first = lambda name, *keys: [F.min_by(c, F.xxhash64(F.lit(salt), *keys)).alias(f"{name}_{c}") for c in ("row", "class")]
        heads = each.groupBy("k", "value").agg(*first("f", "k", "row"), *first("g", "row"), F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi")
        head = lambda name: F.struct(F.col(f"{name}_row").alias("row"), F.col(f"{name}_class").alias("class"))
        heads = cut(heads.select("k", "value", F.array(head("f"), head("g")).alias("heads")), "firsts")
        pairs = each.join(heads, ["k", "value"]).select("row", "class", F.explode("heads").alias("head"))
        pairs = pairs.where("class <> head.class").select("row", F.col("head.row").alias("a")).distinct()
        mins = lambda name, as_name: self.sets.select(F.col("row").alias(name), F.col("mins").alias(as_name))
        both = cut(pairs, "tries").join(mins("row", "mins"), "row").join(mins("a", "a_mins"), "a")
        equal = F.size(F.filter(F.arrays_zip("mins", "a_mins"), lambda z: z["mins"] == z["a_mins"]))
        return cut(both.select("a", F.col("row").alias("b"), equal.alias("equal")).where(F.col("equal") >= FAMILY), "alike")

    def partners(self, alike: DataFrame) -> DataFrame:
        """(a, b): of each set up to ``PARTNERS`` that are likely to link with it."""
        place = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("equal"), "a"))
        return alike.where(F.col("equal") >= LIKELY).withColumn("place", place).where(F.col("place") <= PARTNERS).select("a", "b")

    def families(self, alike: DataFrame, salt: int) -> DataFrame:
        """(row, family) of each set that is like others: the one of least hash among those and itself."""
        order = lambda c: F.struct(F.xxhash64(F.lit(salt), c).alias("h"), F.col(c).alias("row"))
        return alike.groupBy(F.col("b").alias("row")).agg(F.min(order("a")).alias("best")).select("row", F.least("best", order("row"))["row"].alias("family"))

    def left(self, classes: DataFrame, families: DataFrame) -> DataFrame:
        """Links between sets of different classes that share an element of their prefixes.

        Entries of small families are paired; a family of ``LARGE`` sets and more is met as a whole: of each
        list it has, by block, the bounds that its entries allow, and a set within them is held against the
        family, unless its entries there are all of the set's class. Within a family the sets of the class
        that most belong to are only held against by the others.
        """
        t = self.percent
        own = self.sets.where("prefix is not null")
        members = own.select("row").join(classes.withColumnRenamed("node", "row"), "row", "left").join(families, "row", "left")
        members = cut(members.select("row", F.coalesce("label", "row").alias("class"), F.coalesce("family", "label", "row").alias("unit")), "members")
        # Lists with sets of more than one class; the others hold no new answer. They are found a part of the elements at a time.
        # A set without a link is a class of its own; only the others, and few besides, are shuffled to meet their class.
        told, lists = may_hold(own.select("row", "prefix"), F.col("row"), classes, F.col("node"), "linked"), None
        for part in range(PASSES):
            here = lambda x: F.pmod(x, F.lit(PASSES)) == part  # noqa: B023, E731
            alone = told.where("not linked").select(F.col("row").alias("class"), F.explode("prefix").alias("element")).where(here(F.col("element")))
            linked = told.where("linked").select("row", F.filter("prefix", here).alias("some")).join(members.select("row", "class"), "row").select("class", F.explode("some").alias("element"))
            each = alone.unionByName(linked).groupBy("element").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
            found = cut(each.where("lo < hi").select("element"), "lists")
            lists = found if lists is None else lists.unionByName(found)
        sent = self.spark.sparkContext.broadcast(NumberFilter.of(lists))
        entries = own.select("row", "n", "prefix").mapInArrow(partial(_entries, sent=sent), "row long, n long, at long, element long")
        entries = entries.join(lists, "element").join(members, "row")
        counts = members.groupBy("unit", "class").agg(F.count("*").alias("k"))
        large = counts.groupBy("unit").agg(F.sum("k").alias("all"), F.max_by("class", F.struct("k", "class")).alias("main")).where(F.col("all") >= LARGE)
        large = cut(large.select("unit", "main"), "large")
        # Sizes of a block differ by less than the threshold allows: partners are in the same block or the next.
        block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / t)) + 1e-9)
        entries = entries.join(large, "unit", "left").withColumns({"block": block, "rest": F.col("n") - F.col("at")})
        entries = cut(entries, "entries")
        sent.destroy()
        # Of both sizes together so much must be in common.
        enough = lambda rest, sizes: (100 + t) * rest >= t * sizes

        few = entries.where("main is null")
        small = few.where(enough(F.col("rest"), 2 * F.col("n"))).select(
            "element", F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("block"), *[F.col(c).alias(f"small_{c}") for c in ("row", "n", "class", "rest")]
        )
        both = small.join(few, ["element", "block"]).where(
            (F.col("class") != F.col("small_class"))
            & ((F.col("small_n") < F.col("n")) | ((F.col("small_n") == F.col("n")) & (F.col("small_row") < F.col("row"))))
            & (100 * F.col("small_n") >= t * F.col("n"))
            & enough(F.least("rest", "small_rest"), F.col("n") + F.col("small_n"))
        )
        links = self.verify(self.possible(both.select(F.col("row").alias("a"), F.col("small_row").alias("b"))))
        if large.isEmpty():
            return links

        bounds = entries.where("main is not null").groupBy("element", "block", F.col("unit").alias("their_unit")).agg(
            F.max("rest").alias("their_rest"), F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.min("class").alias("lo"), F.max("class").alias("hi")
        )
        sides = entries.withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
        here = F.when(F.col("unit") == F.col("their_unit"), F.col("class") != F.col("main")).otherwise(F.col("main").isNull() | (F.col("unit") < F.col("their_unit")))
        met = sides.join(cut(bounds, "bounds"), ["element", "block"]).where(
            here
            & ((F.col("lo") != F.col("class")) | (F.col("hi") != F.col("class")))
            & (F.col("least_n") * t <= 100 * F.col("n"))
            & (100 * F.col("most_n") >= t * F.col("n"))
            & enough(F.least("rest", "their_rest"), F.col("n") + F.col("least_n"))
        )
        pairs = met.select("row", "class", F.col("their_unit").alias("unit"))
        return links.unionByName(self.verify_units(pairs, members.join(large.select("unit"), "unit", "left_semi")))


def _labelled(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, rounds: int, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, n, key, label) of each row and (label, component_id); both stay when this ends."""
    with scratch(docs.sparkSession):
        join = Join(docs, id_col, text_col, n, percent)
        links = join.equal_sets()
        if known is None:
            classes = links.select(F.col("b").alias("node"), F.col("a").alias("label")).union(links.select("a", "a").distinct())
        else:
            links = links.unionByName(join.rows_of(known))
            classes = components(links)
        families = docs.sparkSession.createDataFrame([], "row long, family long")
        for salt in range(rounds):
            alike = join.alike(classes, salt)
            families = families if salt else cut(join.families(alike, salt), "families")
            if known is None:
                links = links.unionByName(join.verify(join.partners(alike)))
                classes = components(links)
        links = links.unionByName(join.left(classes, families))
        classes = components(links)
        own = join.sets.select("row", "id", "n", "key").join(classes.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))
        own = cut(own, "labelled", keep=True)
        least = cut(own.groupBy("label").agg(F.min("id").alias("component_id")), "least", keep=True)
    return own, least


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75, rounds: int = 1
) -> DataFrame:
    """(id, n_shingles, component_id) of each row; sets link when 100 * intersection >= percent * union."""
    own, least = _labelled(docs, id_col, text_col, n, percent, rounds)
    return own.join(least, "label").select("id", F.col("n").alias("n_shingles"), "component_id")


def text_components(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """(key, component_id) of each different text, as ``jaccard_components`` has them; the key is the 128-bit XXH3 of its bytes.

    ``known`` has links (a, b) of texts' keys that were verified before. They stand in for the comparisons of likely
    pairs that come first; no link depends on them.
    """
    own, least = _labelled(docs, id_col, text_col, n, percent, 1, known)
    return own.groupBy("key").agg(F.min("label").alias("label")).join(least, "label").select("key", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75, rounds: int = 1) -> DataFrame:
    """One document of each component, with all its columns: that of the least id, null ids last.

    Texts without words link with nothing and stay. Only what goes, and the few documents that a filter
    confuses with it, is shuffled with its text.
    """
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    own = cut(docs.select(F.monotonically_increasing_id().alias("number"), columns, F.col(id_col).alias("id")), "numbered")
    texts = own.select("number", F.col("doc").getField(text_col).alias("text"))
    found = jaccard_components(texts, "number", "text", n, percent, rounds).select(F.col("id").alias("number"), "component_id")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "number")
    told = cut(own.select("number", "id").join(found, "number"), "told")
    stays = cut(told.groupBy("component_id").agg(F.min(order).alias("least")).select("component_id", F.col("least.number").alias("stays")), "stays")
    gone = cut(told.join(stays, "component_id").where("number <> stays").select("number"), "gone")
    told = may_hold(own, F.col("number"), gone, F.col("number"), "hit")
    return told.where("not hit").select("doc.*").unionByName(told.where("hit").join(gone, "number", "left_anti").select("doc.*"))
