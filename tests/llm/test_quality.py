import zlib

import numpy as np
import pyarrow as pa

from ledgerloom.llm import quality
from ledgerloom.llm.common import documents

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    network = quality.train(docs, labels.where(~quality.held_out(labels["doc_id"])))
    told = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    scores = {r["id"]: r["score"] for r in quality.score(docs, network).collect()}
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores.values())
    right = [(scores[d] >= 0.5) == bool(y) for d, y in told.items()]
    assert np.mean(right) >= 0.95


def test_gradients_against_differences():
    texts = ["abcabc!! x", "hello world, this is a text of some length", ""]
    raw = [t.encode() for t in texts]
    laid = quality.layout(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    y, w = np.array([0, 1, 1], np.float32), quality.start(1)

    def loss(w):
        p = quality.head(w, quality.pooled(w, *laid))[1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = quality.gradients(w, *laid, y)
    for name in ("filters", "hidden", "out", "embed"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        up, down = ({k: v.astype(np.float64 if k != "embed" else np.float32) for k, v in w.items()} for _ in range(2))
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        assert np.isclose((loss(up) - loss(down)) / 2e-3, g[name][at], rtol=0.1, atol=2e-3)


def test_a_text_scores_alike_in_any_batch():
    rng = np.random.default_rng(0)
    texts = ["".join(chr(c) for c in rng.integers(32, 400, n)) for n in (0, 1, 7, 8, 23, 24, 25, 33, 500)]
    network = quality.Network(0.5, quality.start(3))
    together = quality.probabilities(pa.array([*texts, None]), network)
    alone = [quality.probabilities(pa.array([t]), network)[0] for t in texts]
    assert np.allclose(together[:-1], alone, atol=1e-5) and np.isclose(together[-1], together[0])


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a", 0), (None, None, 1), (2, "b" * 300_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.train(docs, labels)).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.train(docs, ones)).collect()} == {1.0}
    assert quality.score(docs.limit(0), quality.Network()).collect() == []


def plain(w, raw):
    """The score of a text by loops over chunks, bytes and lags."""
    chunks = max(1, -(-(len(raw) - 16) // 8))
    pool = np.zeros(quality.FILTERS)
    for c in range(chunks):
        seen = []
        for block in range(c, c + 3):
            at = [block * 8 + i for i in range(8)]
            seen += [w["embed"][raw[i] if i < len(raw) else quality.PAD] for i in at]
            same = [sum(block >= 3 and i < len(raw) and raw[i] == raw[i - lag] for i in at) / 8 for lag in quality.LAGS]
            seen.append(np.array(same))
        pool = np.maximum(pool, np.concatenate(seen) @ w["filters"] + w["shift"])
    hidden = np.maximum(pool @ w["hidden"] + w["hidden_shift"], 0)
    return 1 / (1 + np.exp(-(hidden @ w["out"] + w["out_shift"][0])))


def test_convolution_against_loops(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab é€x. "), n)) for n in (0, 1, 9, 16, 17, 24, 25, 26, 40, 41, 100, 333, 700)]
    w = quality.start(7)
    want = [plain(w, t.encode()) for t in texts]
    network = quality.Network(0.5, w)
    assert np.allclose(quality.probabilities(pa.array(texts), network), want, atol=1e-5)
    for piece in (1, 2, 3, 5, 16):  # as texts longer than a piece are scored
        monkeypatch.setattr(quality, "PIECE", piece)
        alone = [quality.probabilities(pa.array([t]), network)[0] for t in texts]
        assert np.allclose(alone, want, atol=1e-5)
        laid = quality.layout(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]))
        assert np.allclose(np.maximum(quality.best_chunks(w, *laid)[1], 0), quality.pooled(w, *laid), atol=1e-5)


def test_a_text_of_twenty_megabytes():
    import resource

    network = quality.Network(0.5, quality.start(3))
    text = "some words that go on and on " * 700_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    quality.probabilities(pa.array([text, "x"]), network)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # kilobytes


def test_the_bound_of_bytes_leaves_out_whole_texts(spark):
    docs = spark.createDataFrame([(i, ("good words " if i % 2 else "zzzz!!!! ") * 20) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert quality.train(docs, labels, most_bytes=10).weights == {}
    assert quality.train(docs, labels, most_bytes=10).prior == 0.5
    assert quality.train(docs, labels).weights


def test_a_text_above_the_bound_is_passed_over(spark):
    """Wherever in the order the long text stands, the others are learned from."""
    rows = [(i, ("good words here " if i % 2 else "zzzz qqqq ") * 8) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    for long in range(0, 40, 13):
        docs = spark.createDataFrame([(i, t * 400 if i == long else t) for i, t in rows], "doc_id long, text string")
        network = quality.train(docs, labels, most_bytes=20_000)
        assert network.weights and abs(network.prior - 0.5) < 0.05
