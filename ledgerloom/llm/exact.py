"""Exact duplicates by a log-structured merge index of digests.

Every task is a memtable: it flushes the digests of its documents as one sorted run, a Parquet file
with a Bloom filter and the least and greatest digest of each row group. One pass over the documents deals
its tasks' runs out to ``FLUSHES`` flushes. Flushes stand in tiers: where a tier has ``fan`` of them, they are
merged into one of the next tier, and of equal digests a merge keeps the identifier that stays and adds up
the counts. Digests with more than one document are hits. Only texts that may be hits, told by a filter that
grows with the hits up to 64 MB, are shuffled, and compared byte by byte before anything is dropped. (With
far more than a hundred million hits that filter is full: all texts are shuffled then, and the result is the same.)

All steps are DataFrame operations. Groups are pre-aggregated before the shuffle, so that a text
with a third of all rows sends one row from each task, and the join that gives each document its
answer reads both sides from tables, so that Spark may split a hot digest.

Defined results: a null text is an empty text; a null id never stays unless all ids of its group
are null, and of ids that tie, rows with equal id and text, each has the same answer. Only the two
named columns are read, so further columns of any name don't matter. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, goes_with_scratch, scratch, shared_folder, shuffles_go

Digest = Callable[[Column], Column]
#: Bits of a filter: 4 MB at least, 64 MB at most, and between these sixteen for each key.
FILTER_BITS, MOST_BITS = 1 << 25, 1 << 29
#: Flushes that one pass over the documents makes, fewer where it has fewer tasks.
FLUSHES = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def filter_bits(keys: int) -> int:
    return min(max(MOST_BITS, FILTER_BITS), max(FILTER_BITS, 1 << (16 * keys).bit_length()))


def may_hold(rows: DataFrame, key: Column, held: DataFrame, held_key: Column, name: str, n_bits: int | None = None) -> DataFrame:
    """``rows`` with a flag whether ``held`` may have the key: always where it has, and for few others.

    The filter is a bitmap cut into rows of 4 KB, at most 16,384 of them, which is what the join broadcasts.
    """
    n_bits = n_bits or FILTER_BITS
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(n_bits)) + 1
    bits = held.select(place(held_key).alias("p")).groupBy(F.bitmap_bucket_number("p").alias(f"{name}_bucket"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(f"{name}_bits"))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring(F.col(f"{name}_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    flag = F.coalesce(F.bit_get(byte, (at % 8).cast("int")) == 1, F.lit(False))
    told = rows.withColumn(f"{name}_bucket", F.bitmap_bucket_number(place(key)))
    return told.join(F.broadcast(bits), f"{name}_bucket", "left").withColumn(name, flag).drop(f"{name}_bucket", f"{name}_bits")


#: How runs are written; a run's Bloom filter is as large as its digests ask for, not a megabyte for each file.
OPTIONS = {"compression": "zstd", "parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


class MergeIndex:
    """Runs of (digest, id, copies) under one folder, each sorted by digest, in tiers of ``fan`` flushes or merges."""

    def __init__(self, spark: SparkSession, folder: str | None = None, keep: str = "largest", fan: int = 4) -> None:
        if keep not in ("largest", "smallest"):
            raise ValueError(f"keep must be largest or smallest, not {keep}")
        self.spark, self.folder, self.fan = spark, folder or shared_folder(spark), fan
        goes_with_scratch(self.folder)
        self.stays = F.max if keep == "largest" else F.min
        self.flushed: list[str] = []
        self.tiers: list[list[str]] = [[]]

    def _write(self, rows: DataFrame, path: str) -> str:
        rows.sortWithinPartitions("digest").write.options(**OPTIONS).parquet(path)
        return path

    def _merge(self, paths: list[str], path: str) -> str:
        rows = self.spark.read.parquet(*paths)
        return self._write(rows.groupBy("digest").agg(self.stays("id").alias("id"), F.sum("copies").alias("copies")), path)

    def flush(self, rows: DataFrame) -> None:
        """Write (digest, id) rows as sorted runs, one for each task, and merge the tiers that are full."""
        self._take(self._write(rows.withColumn("copies", F.lit(1).cast("long")), f"{self.folder}/flush={len(self.flushed)}"))

    def flush_parts(self, rows: DataFrame, parts: int) -> None:
        """The same as ``parts`` flushes by one pass over the rows: each task's run goes whole to one of them."""
        base = f"{self.folder}/parts={len(self.flushed)}"
        part = F.pmod(F.spark_partition_id(), F.lit(parts))
        runs = rows.withColumns({"copies": F.lit(1).cast("long"), "part": part}).sortWithinPartitions("part", "digest")
        runs.write.options(**OPTIONS).partitionBy("part").parquet(base)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(base)
        made = [f.getPath().getName() for f in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path) if f.isDirectory()]
        if not made:  # no rows at all
            self.flush(rows.limit(0))
        for name in sorted(made, key=lambda n: int(n.partition("=")[2])):
            self._take(f"{base}/{name}")

    def _take(self, path: str) -> None:
        """A flush joins the first tier, and full tiers are merged."""
        self.flushed.append(path)
        self.tiers[0].append(path)
        for level, tier in enumerate(self.tiers):
            if len(tier) >= self.fan:
                if level + 1 == len(self.tiers):
                    self.tiers.append([])
                self.tiers[level + 1].append(self._merge(tier, f"{self.folder}/tier={level + 1}/merge={len(self.flushed)}"))
                self.tiers[level] = []

    def rows(self) -> DataFrame:
        """Every (digest, id) that was flushed."""
        return self.spark.read.parquet(*self.flushed).select("digest", "id")

    def compact(self) -> DataFrame:
        """What all tiers hold, merged: a row for each digest with the id that stays and the copies."""
        live = [p for tier in self.tiers for p in tier]
        if len(live) == 1 and not self.tiers[0]:  # merged already
            return self.spark.read.parquet(*live)
        top = self._merge(live, f"{self.folder}/all={len(self.flushed)}")
        self.tiers = [[] for _ in self.tiers] + [[top]]
        return self.spark.read.parquet(top)

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """Every (digest, id) that was flushed with these digests; Bloom filters and sorted row groups skip the rest."""
        return self.rows().where(F.col("digest").isin([bytearray(d) for d in digests]))


def _answers(docs: DataFrame, id_col: str, text_col: str, keep: str, digest: Digest) -> DataFrame:
    """(digest, id, keep_id, group_size) of each document, from the index and the bytes of its hits."""
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = own.select(digest(F.col("text")).alias("digest"), "id", "text")
    index = MergeIndex(docs.sparkSession, keep=keep)
    with shuffles_go(docs.sparkSession):
        index.flush_parts(keyed.select("digest", "id"), FLUSHES)
        level = index.compact()
    hits = level.where("copies > 1").select("digest")

    # Each distinct text of a hit once from each task; a digest of several texts is taken apart by text.
    likely = may_hold(keyed.select("digest", "text"), F.col("digest"), hits, F.col("digest"), "hit", filter_bits(hits.count())).where("hit")
    texts = cut(likely.groupBy("digest", "text").count().select("digest"), "texts")
    shared = cut(texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "shared")
    answers = index.rows().join(level.select("digest", F.col("id").alias("keep_id"), F.col("copies").alias("group_size")), "digest")
    if not shared.isEmpty():
        apart = keyed.join(shared, "digest", "left_semi")
        classes = apart.groupBy("digest", "text").agg(index.stays("id").alias("keep_id"), F.count("*").alias("group_size"))
        told = apart.join(cut(classes, "classes"), ["digest", "text"]).select("digest", "id", "keep_id", "group_size")
        answers = answers.join(shared, "digest", "left_anti").unionByName(told)
    return answers.select("digest", "id", "keep_id", "group_size")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", digest: Digest = sha256
) -> DataFrame:
    """For each document (id, keep_id, group_size, kept, digest); equal texts share keep_id.

    ``digest`` may be any function of the text: texts that only share it are told apart by their bytes.
    """
    kept = F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")
    with scratch(docs.sparkSession):
        answers = cut(_answers(docs, id_col, text_col, keep, digest), "answers", keep=True)
    return answers.select("id", "keep_id", "group_size", kept, "digest")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The documents that stay, with all their columns; of rows that tie by id and text one stays.

    A document without copies isn't shuffled, nor is one that the filters know to go: of a text with
    a third of all rows one is, and the few that a filter confuses with it.
    """
    with scratch(docs.sparkSession):
        answers = cut(_answers(docs, id_col, text_col, keep, sha256), "answers", keep=True)
    hits = answers.where("group_size > 1").select("digest")
    bits = filter_bits(answers.where("group_size > 1 and id <=> keep_id").count())
    # What stays of the digests that the filter takes for hits, whether they are or not.
    kept = answers.where(F.col("id").eqNullSafe(F.col("keep_id"))).select("digest", "id")
    stays = may_hold(kept, F.col("digest"), hits, F.col("digest"), "hit", bits).where("hit").select(F.col("digest").alias("stays_digest"), F.col("id").alias("stays_id"))
    stays = cut(stays.distinct(), "stays")

    pair = lambda d, i: F.struct(F.col(d), F.col(i).isNull(), F.col(i))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    own = docs.select(whole, F.col(id_col).alias("id"), sha256(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"))
    told = may_hold(own, F.col("digest"), hits, F.col("digest"), "hit", bits)
    told = may_hold(told, pair("digest", "id"), stays, pair("stays_digest", "stays_id"), "stay", bits)
    same = (F.col("digest") == F.col("stays_digest")) & F.col("id").eqNullSafe(F.col("stays_id"))
    one = told.where("hit and stay").join(stays, same, "left_semi").dropDuplicates(["digest", "id"])
    return told.where("not hit").select("doc.*").unionByName(one.select("doc.*"))
