"""The registered queries of the training-data operators: one for each, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import pii, quality, secrets, sql
from ledgerloom.llm.align import align_tokenizers
from ledgerloom.llm.common import cut, documents, scratch
from ledgerloom.llm.decontam import contaminated
from ledgerloom.llm.exact import exact_duplicates
from ledgerloom.llm.fingerprints import edited_fingerprints, near_heads
from ledgerloom.llm.mixing import mix_sources
from ledgerloom.llm.periods import periodic_runs, repeated_tail
from ledgerloom.llm.rlindex import remove_repeated, repeated_passages
from ledgerloom.llm.simjoin import jaccard_components
from ledgerloom.llm.tokens import count_tokens
from ledgerloom.llm.warc import read_bundles, write_bundles

#: Production parameters: the mixture, the limit of tokens, and the shortest payload that may be revisited.
WEIGHTS = {"src0": 0.10, "src1": 0.15, "src2": 0.15}
REST, MIX_SEED = 0.60, 7
TOKENIZER, TOKEN_LIMIT = "byte_bpe_50k.json", 512
#: The tokenizer that op11 aligns with ``TOKENIZER``.
OTHER_TOKENIZER = "piece_bpe_32k.model"
MIN_PAYLOAD = 0
#: Bytes of a string that must not occur twice.
REPEAT_BYTES = 400
#: Words of a passage that is also reported where it occurs twice: more than fifty.
PASSAGE_WORDS = 51
#: The most labelled documents that the classifier is fitted on.
TRAINING_ROWS = 3000


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    network = quality.train(docs, labels.where(~quality.held_out(F.col("doc_id"))), most_rows=TRAINING_ROWS)
    scored = quality.score(docs, network)
    return scored.select(F.col("id").alias("doc_id"), quality.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = read_bundles(write_bundles(pages, min_bytes=MIN_PAYLOAD))
    return records.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, sf_dir))
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *map(count, pii.BASE_KINDS), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir), WEIGHTS, REST, seed=MIX_SEED)
    return mixed.select("doc_id", "source", "copy", "mix_key", "text")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.find_secrets(documents(spark, sf_dir))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    counts = [count(i).alias(f"n_{k.name}") for i, k in enumerate(secrets.BASE)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("found")).alias("spans"), F.coalesce("verdicts", F.lit("")).alias("verdicts"), "n_live", "n_example")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), full=True)
    return found.withColumnRenamed("id", "doc_id")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    with scratch(spark):
        found = cut(remove_repeated(docs, length=REPEAT_BYTES), "repeats", keep=True)
    with scratch(spark):
        passages = cut(repeated_passages(docs, least=PASSAGE_WORDS), "passages", keep=True)
    words = F.coalesce("n_passage_words", F.lit(0)).alias("n_passage_words")
    return found.join(passages, "key", "left").select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("runs").cast("long").alias("n_spans"), "kept_sha256", words
    )


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(documents(spark, sf_dir), keep="largest")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only this query needs the vocabularies

    counted = count_tokens(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only this query and op9 need the vocabularies

    with scratch(spark):
        rows, _ = align_tokenizers(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), public_tokenizers.path(OTHER_TOKENIZER))
        return cut(rows.withColumnRenamed("id", "doc_id"), "alignment", keep=True)


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", repeated_tail().alias("text"))
    found = periodic_runs(docs)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    longest = F.sort_array(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"])))
    first = found.withColumn("first", F.get(longest, F.lit(0)))
    length, start, period = -F.col("first.col1"), F.col("first.start"), F.col("first.period")
    return first.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), "collapsed_sha256",
    )


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    with scratch(spark):
        found = cut(near_heads(docs, edited_fingerprints(docs)), "near-heads", keep=True)
    return found.withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_warc, op3_pii, op4_mixing, op5_secrets, op6_decontamination, op7_repeats, op8_exact, op9_tokens, op10_jaccard, op11_align, op12_periods, op13_fingerprints)}


def oracle_sql() -> dict[str, str]:
    return sql.ORACLES
