import hashlib
from collections import Counter

import pytest
from test_decontam import brute as brute_items
from test_simjoin import brute as brute_components

import corpus_pipeline
from ledgerloom.llm import mixing, quality
from ledgerloom.llm.common import documents
from ledgerloom.llm.queries import MIX_SEED, REST, WEIGHTS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents as they come and after each stage, written and read again."""
    docs, out = documents(spark, SF), []
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns(steps):
    assert all(df.columns == steps[0].columns for df in steps[1:-1])


def test_quality(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("crc32(cast(doc_id as string)) % 3 <> 1")
    scores = quality.score(steps[0], quality.train(steps[0], labels)).collect()
    assert sorted(d for d, _ in rows(steps[1])) == sorted(r["id"] for r in scores if r["score"] >= 0.5)
    told = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [told[r["id"]] == int(r["score"] >= 0.5) for r in scores if r["id"] in told]
    assert sum(right) >= 0.9 * len(right)


def test_exact(steps):
    best = {}
    for d, t in rows(steps[1]):
        best[t] = max(d, best.get(t, d))
    assert sorted(d for d, _ in rows(steps[2])) == sorted(best.values())


def test_near(steps):
    want = {c for _, _, c in brute_components(rows(steps[2]))}
    assert sorted(d for d, _ in rows(steps[3])) == sorted(want)


def test_benchmark(spark, steps):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    short = [(d, t) for d, t in rows(steps[3]) if len(t) < 2500]
    dirty = {d for d, _, _ in brute_items(short, items)}
    kept = {d for d, _ in rows(steps[4])}
    assert {d for d, _ in short} - kept == dirty


def test_mixing(steps):
    docs = steps[4].collect()
    named = Counter(r["source"] if r["source"] in WEIGHTS else None for r in docs)
    total = sum(WEIGHTS.values()) + REST
    want = Counter()
    for r in docs:
        name = r["source"] if r["source"] in WEIGHTS else None
        rate = {**WEIGHTS, None: REST}[name] / total * len(docs) / named[name]
        u = int(hashlib.md5(f"{MIX_SEED}:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        want[r["doc_id"]] += sum(x <= u for x in mixing.thresholds(rate))
    got = Counter(r["doc_id"] for r in steps[5].collect())
    assert got == +want
