from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.llm import exact
from ledgerloom.llm.exact import MergeIndex, drop_exact_duplicates, exact_duplicates, may_hold, sha256
from ledgerloom.llm.queries import op8_exact

ROWS = [(1, "a"), (5, "a"), (3, "a"), (2, "b"), (4, None), (6, ""), (None, "b"), (7, "x" * 200_000), (8, "x" * 200_000), (9, "x" * 199_999), (9, "c"), (9, "c"), (None, "d")]


def brute(rows, keep=max):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    stays = {t: keep((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((i, stays[t or ""], len(groups[t or ""]), i == stays[t or ""]) for i, t in rows)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, digest string, id int")


def found(df):
    return Counter((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())


def test_against_brute_force(spark):
    docs = frame(spark, ROWS)
    assert found(exact_duplicates(docs)) == brute(ROWS)
    assert found(exact_duplicates(docs, keep="smallest")) == brute(ROWS, min)
    assert exact_duplicates(docs.limit(0)).collect() == []


def test_texts_that_share_a_digest_are_told_apart(spark):
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 1))
    rows = [(i, f"t{i % 40}") for i in range(120)]
    assert found(exact_duplicates(frame(spark, rows), digest=weak)) == brute(rows)


def test_index_takes_further_flushes(spark):
    index = MergeIndex(spark)
    for ids in ((1, 2), (3,)):
        index.flush(spark.createDataFrame([(i, "same") for i in ids], "id long, t string").select(sha256(F.col("t")).alias("digest"), "id"))
    (row,) = index.compact().collect()
    assert (row["id"], row["copies"]) == (3, 3)
    assert index.lookup([bytes(row["digest"])]).count() == 3 and index.lookup([b"\0" * 32]).count() == 0


def test_tiers_are_merged(spark):
    index = MergeIndex(spark, fan=2)
    for i in range(5):
        index.flush(spark.createDataFrame([(i, "same"), (i, f"own {i}")], "id long, t string").select(sha256(F.col("t")).alias("digest"), "id"))
    assert [len(t) for t in index.tiers] == [1, 0, 1]
    assert sorted((r["id"], r["copies"]) for r in index.compact().collect()) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (4, 5)]
    assert index.rows().count() == 10


def test_a_filter_misses_nothing(spark):
    rows = spark.range(3000).select(F.col("id").alias("k"), F.lit(1).alias("x"))
    told = may_hold(rows, F.col("k"), rows.where("k % 3 = 0"), F.col("k"), "here").collect()
    assert all(r["here"] for r in told if r["k"] % 3 == 0) and len(told) == 3000
    assert sum(r["here"] for r in told) < 1100
    assert not any(r["here"] for r in may_hold(rows, F.col("k"), rows.limit(0), F.col("k"), "here").collect())


def test_dropping(spark, monkeypatch):
    docs = frame(spark, ROWS)
    want = sorted({(i, t or "") for i, t in ROWS if i == max((j for j, u in ROWS if (u or "") == (t or "") and j is not None), default=None)}, key=str)
    for bits in (exact.FILTER_BITS, 8):  # so few bits that the filter confuses texts
        monkeypatch.setattr(exact, "FILTER_BITS", bits)
        kept = drop_exact_duplicates(docs)
        assert kept.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=str) == want
    assert drop_exact_duplicates(docs.limit(0)).collect() == []


def test_the_query_flushes_merges_and_asks_the_filter(spark, tmp_path, monkeypatch):
    """Several flushes by one pass, tiers that fill, texts told by the filter of hits, and nothing left but the answer."""
    made, asked = [], []

    class Watched(MergeIndex):
        def __init__(self, *args, **named):
            super().__init__(*args, **named)
            made.append(self)

        def _merge(self, paths, path):
            self.merged = [*getattr(self, "merged", []), (len(paths), path.removeprefix(self.folder))]
            return super()._merge(paths, path)

    def watched(rows, key, held, held_key, name, n_bits=None):
        asked.append((rows.columns, n_bits))
        return may_hold(rows, key, held, held_key, name, n_bits)

    monkeypatch.setattr(exact, "MergeIndex", Watched)
    monkeypatch.setattr(exact, "may_hold", watched)
    frame(spark, ROWS * 20).repartition(20).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a task for each file
    try:
        found_rows = op8_exact(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (index,) = made
    assert len(index.flushed) == exact.FLUSHES
    assert [n for n, _ in index.merged] == [4, 4, 4, 4, 4] and [len(t) for t in index.tiers] == [0, 0, 1]
    assert asked == [(["digest", "text"], exact.FILTER_BITS)]
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found_rows) == brute(ROWS * 20)
    path = spark._jvm.org.apache.hadoop.fs.Path(index.folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_a_filter_grows_with_its_keys_up_to_a_bound():
    assert [exact.filter_bits(n) for n in (0, 1000, 10**7, 10**12)] == [1 << 25, 1 << 25, 1 << 28, 1 << 29]
