from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import periods, queries

WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """(start, length, period) of the runs, by walking every period."""
    runs = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i > start and i + p - start >= max(6, 4 * p):
                runs.setdefault((start, i + p), p)
            i = max(i, start + 1)
    return sorted((s, e - s, p) for (s, e), p in runs.items())


def collapsed(words, runs):
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def found(texts):
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    start, stop, period = periods.find_runs(np.array([x for t in texts for x in t], np.int64), at)
    of = np.searchsorted(at, start, "right") - 1
    out = [[] for _ in texts]
    for k, s, e, p in zip(of.tolist(), start.tolist(), stop.tolist(), period.tolist()):
        out[k].append((s - int(at[k]), e - s, p))
    return [sorted(x) for x in out]


repeated = st.builds(lambda a, u, n, b: [*a, *(u * n)[: n + len(u)], *b], st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 40), st.lists(st.integers(0, 3), max_size=9))


@given(st.lists(st.one_of(repeated, st.lists(st.integers(0, 2), max_size=60)), min_size=1, max_size=4), st.sampled_from([3, 1 << 20]))
@settings(max_examples=300, deadline=None)
def test_runs(texts, portion):
    before, periods.PORTION = periods.PORTION, portion
    try:
        assert found(texts) == [brute(t) for t in texts]
    finally:
        periods.PORTION = before


def test_hashes_that_lie(monkeypatch):
    """Where every hash is equal, the words decide."""
    monkeypatch.setattr(periods.Hashes, "equal", lambda self, a, b, size: np.ones(len(a), bool))
    texts = [[1, 2, 1, 2, 1, 2, 1, 2, 3, 3, 3, 3, 3, 3], [1, 2, 3, 4, 5, 6, 7, 8], [5] * 9]
    assert found(texts) == [brute(t) for t in texts]


def test_words_of_long_sequences_over_two_letters():
    """Sums modulo 2**64 collide on this sequence; the result doesn't."""
    thue_morse = [i.bit_count() & 1 for i in range(1 << 12)]
    (runs,) = found([[*thue_morse, *[7, 8, 9] * 30, *thue_morse]])
    assert runs == [(1 << 12, 90, 3)]


TEXTS = [None, "", " \t\n", "a a a a a", "a a a a a a", "x " + "b c d " * 9 + "y", "é É é É é É é É é", "one\x0btwo one\x0ctwo one\rtwo one two", "w " * 3000 + "end"]


def test_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 7 if i else None, t, 5, "n") for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, runs int, n_words string")
    want = []
    for i, t in enumerate(TEXTS * 2):
        words = WORD.findall(t or "")
        runs = brute(words)
        want.append((i % 7 if i else None, len(words), [tuple(r) for r in runs], sha256(collapsed(words, runs).encode()).hexdigest()))
    got = [(r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed_sha256) for r in periods.periodic_runs(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periods.periodic_runs(docs.limit(0)).collect() == []


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()
    want = {}
    for d in docs:
        words = planted(d.doc_id, d.text)
        if len(words) > 1500:
            continue
        runs = brute(words)
        s, n, p = min(((s, n, p) for s, n, p in runs), key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        said = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2])))
        want[d.doc_id] = (len(runs), s, n, p, 1000 * n // p if runs else None, sha256(said.encode()).hexdigest(), sha256(collapsed(words, runs).encode()).hexdigest())
    got = queries.op12_periods(spark, f"/root/testdata/{sf}").collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got if r.doc_id in want} == want
    assert sum(w[0] > 0 for w in want.values()) > 10
