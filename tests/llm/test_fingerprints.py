from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
import regex

from ledgerloom.llm import fingerprints as fp
from ledgerloom.llm import queries, simjoin
from ledgerloom.llm.common import cut
from test_simjoin import brute

WORD = regex.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rows):
    """(id, text, edited, next) in the order of descending ids, nulls last."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    after = [t for _, t in order[1:] + order[:1]]
    return [(i, t, t[: len(t) - len(t) // 2] + b[: len(t) // 2], b) for (i, t), b in zip(order, after)]


def test_likeness_is_near_jaccard():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    off = []
    for share in (0.0, 0.2, 0.5, 0.8, 0.95, 1.0):
        for _ in range(20):
            a = list(rng.choice(words, 300))
            b = a[: int(300 * share)] + list(rng.choice(words, 300 - int(300 * share)))
            texts = [" ".join(a), " ".join(b)]
            m = fp.marks(fp.signatures(pa.array(texts)))
            off.append(fp.likeness(m[:1], m[1:])[0] - jaccard(*texts))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.05


def test_shingles_are_sets_of_words():
    """Equal sets, and no others here, have equal signatures."""
    texts = ["a b c d e f", "A  b\tc d E f", "a b c d e", "a b", "b a", "a", "", " \n", "a b c d e f a b c d e f", "a b c d", "ab c d", "\x1fa b", "é è"]
    rows = [r.tobytes() for r in fp.signatures(pa.array(texts))]
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            assert (rows[i] == rows[j]) == (shingle_set(x) == shingle_set(y)), (x, y)


def test_empty_sets():
    m = fp.marks(fp.signatures(pa.array(["", " ", "a"])))
    assert fp.likeness(m, m).tolist() == [1.0, 1.0, 1.0]
    assert fp.likeness(m[[0, 0, 2]], m[[1, 2, 1]]).tolist() == [1.0, 0.0, 0.0]


ROWS = [(5, "one two three four five six"), (9, None), (None, "last of all"), (7, "tie b"), (7, "tie a"), (7, "tie a"), (3, "é" * 7), (2, "a"), (-4, "x y " * 700), (1, "")]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_edited(spark, monkeypatch, parts):
    monkeypatch.setattr(fp, "ROWS_AT_ONCE", 2)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = spark.createDataFrame([(i, t, 1, "e") for i, t in ROWS], "doc_id long, text string, part int, edge string").repartition(3)
        got = fp.edited_fingerprints(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = edited(ROWS)
    m, e, n = (fp.marks(fp.signatures(pa.array([w[k] for w in want]))) for k in (1, 2, 3))
    rows = zip(want, fp.hexed(m), fp.hexed(e), fp.likeness(m, e).tolist(), fp.likeness(m, n).tolist())
    assert sorted((r.id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got if r.id is not None) == sorted(
        (w[0], len(w[1]), sha256(w[2].encode()).hexdigest(), a, b, x, y) for w, a, b, x, y in rows if w[0] is not None
    )
    assert [r.n_chars for r in got if r.id is None] == [11]


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    (row,) = fp.edited_fingerprints(docs).collect()
    assert row.edited_sha256 == sha256(b"abab").hexdigest() and row.near_next == 1.0
    assert fp.edited_fingerprints(docs.limit(0)).collect() == []
    assert fp.near_heads(docs.limit(0), fp.fingerprints(docs.limit(0))).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op13_fingerprints(spark, sf).collect()}
    assert len(got) == len(docs)
    by_print = {}
    for i, text, own, after in edited(docs):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha256(own.encode()).hexdigest())
        assert abs(r.near_edited - jaccard(text, own)) < 0.2 and abs(r.near_next - jaccard(text, after)) < 0.2
        assert by_print.setdefault(text, r.fingerprint) == r.fingerprint
    texts = dict(docs)
    for i, r in got.items():
        if r.near_id is not None:
            assert r.near_id < i and jaccard(texts[i], texts[r.near_id]) >= 0.75
    first = {}
    for i, t in sorted(docs):
        if i != first.setdefault(t, i):
            assert got[i].near_id is not None


def test_near_copies(spark):
    """Copies with a word replaced lead to their least; bands of others don't; counts grow with documents, not pairs."""
    base = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(60)] + [(100 + i, f"alone {i} " * 3) for i in range(5)] + [(200, None), (201, ""), (None, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = {r.id: r.near_id for r in fp.near_heads(docs, fp.fingerprints(docs)).collect()}
    assert all(near[i] is not None and near[i] < i for i in range(1, 60)) and near[0] is None
    assert all(near[100 + i] is None for i in range(5)) and near[200] is None


def test_near_classes_lose_no_link(spark):
    """Chains of texts at 0.82, 0.74 and 0.9, under heads that are not always near: the classes that all pairs give."""
    rng, texts = np.random.default_rng(11), []
    for k in range(80):
        base = [f"g{k}w{i}" for i in range(104)]
        texts += [" ".join(f"x{k}y{i}" if i in at else w for i, w in enumerate(base)) for at in ((), (20, 60), (20, 60, 90))]
    docs = list(zip(rng.permutation(len(texts)).tolist(), texts, strict=True))
    odd = [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A\tb"), (1004, "a b"), (None, "a b")]
    frame = spark.createDataFrame(docs + odd, "doc_id long, text string").repartition(3)
    got = sorted((r.id, r.near_class) for r in fp.near_heads(frame, fp.fingerprints(frame)).collect() if r.id is not None)
    assert got == sorted((i, c) for i, _, c in brute(docs)) + [(1000, 1000), (1001, 1001), (1002, 1002), (1003, 1003), (1004, 1003), (1004, 1003)]


def test_links_that_share_no_band(spark):
    """Pairs of texts at 0.753: bands miss some, the classes none."""
    docs = []
    for k in range(400):
        base = [f"g{k}w{i}" for i in range(75)]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(f"x{k}" if i in (20, 50) else w for i, w in enumerate(base)))]
    assert 0.75 <= jaccard(docs[0][1], docs[1][1]) < 0.76
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = fp.near_heads(frame, fp.fingerprints(frame)).collect()
    assert {(r.id, r.near_class) for r in rows} == {(i, i - i % 2) for i, _ in docs}
    assert any(r.near_id is None for r in rows if r.id % 2)


def test_heads_are_gathered_by_hash(spark, monkeypatch):
    """Least values of bands and of MinHash lists go through hash aggregates: neither is sorted."""
    plans = {}

    def watched(df, name, keep=False):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name, keep)

    monkeypatch.setattr(fp, "cut", watched)
    monkeypatch.setattr(simjoin, "cut", watched)
    texts = [" ".join(f"g{k % 7}w{i}" if i != k else "x" for i in range(100)) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fp.near_heads(docs, fp.fingerprints(docs))
    for name in ("heads", "firsts"):
        assert "HashAggregate" in plans[name] and "SortAggregate" not in plans[name]
