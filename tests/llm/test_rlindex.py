import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import rlindex
from ledgerloom.llm.rlindex import merge, remove_repeated, repeated, sliding_least
from ledgerloom.llm.rlindex import merge, remove_repeated, repeated, sliding_least


def brute(docs, length):
    raw = [(t or "").encode() for _, t in docs]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(docs, raw, strict=True):
        runs = merge([(i, i + length) for i in range(len(r) - length + 1) if seen[r[i : i + length]] > 1])
        at, kept = 0, b""
        for a, b in runs:
            kept, at = kept + r[at:a], b
        out.append((d, len(r), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept + r[at:]).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, length):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcdé\n") for _ in range(n))
    passages = [some(rng.randint(length // 2, 3 * length)) for _ in range(5)]
    docs = [(-1, None), (-2, ""), (None, "x" * (3 * length)), (-3, "xy" * length), (-4, some(length - 1)), (-5, passages[0]), (-5, passages[0])]
    for d in range(50):
        parts = [some(rng.randint(0, 2 * length))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            if rng.random() < 0.5:
                k = rng.randrange(len(p))
                p = p[:k] + "Z" + p[k + 1 :]
            parts += [p[rng.randint(0, 10) :], some(rng.randint(0, length))]
        docs.append((d, "".join(parts)))
    docs.append((50, docs[20][1]))
    return docs


@pytest.mark.parametrize(("seed", "length", "anchor", "panel"), [(1, 24, 5, 20_000), (2, 24, 6, 3), (3, 400, None, 20_000)])
def test_against_brute_force(spark, seed, length, anchor, panel):
    docs = corpus(seed, length)
    frame = spark.createDataFrame([(*d, "k", 0) for d in docs], "doc_id long, text string, key string, row int")
    got = remove_repeated(frame, length=length, anchor=anchor, panel=panel).collect()
    assert sorted([(r["id"], r["n_bytes"], r["n_removed"], len(r["runs"]), r["kept_sha256"]) for r in got], key=str) == brute(docs, length)


def test_empty_table(spark):
    assert remove_repeated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_short_texts_only(spark):
    docs = [(i, f"{i % 7:03d} " * 50) for i in range(20)]
    got = remove_repeated(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    assert sorted([(r["id"], r["n_bytes"], r["n_removed"], len(r["runs"]), r["kept_sha256"]) for r in got], key=str) == brute(docs, 400)
    assert {(r["n_bytes"], r["n_removed"]) for r in got} == {(200, 0)}


def test_panels_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        rows, columns, length = rng.integers(1, 12), 14, int(rng.integers(2, 7))
        panel = rng.integers(0, 3, (columns, rows)).astype(np.uint8)
        if rows > 4:
            panel[3:11, 1] = panel[3:11, 3]
        got = repeated(panel, length)
        for c in range(columns - length + 1):
            strings = [panel[c : c + length, r].tobytes() for r in range(rows)]
            assert got[c].tolist() == [strings.count(s) > 1 for s in strings]


def test_sliding_least():
    rng = np.random.default_rng(1)
    for n, w in [(5, 5), (17, 4), (30, 1), (31, 7)]:
        x = rng.integers(0, 99, n).astype(np.uint64)
        assert sliding_least(x, w).tolist() == [x[i : i + w].min() for i in range(n - w + 1)]


def test_passages_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "Ünder", "x1", "dog", "runs", "at", "b", "night"])
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 52, 80)]
    docs = [(0, None), (1, ""), (2, "one two")]
    for d in range(40):
        own = [word() for _ in range(rng.randint(0, 60))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            own += p + [word() for _ in range(rng.randint(0, 9))]
        docs.append((3 + d, "".join(w.upper() * (rng.random() < 0.1) or w for w in [x + rng.choice([" ", ", ", "\n", "-"]) for x in own])))
    docs.append((99, docs[5][1]))
    worded = {d: re.findall("[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for d, t in docs}
    places = {}
    for d, w in worded.items():
        for p in range(len(w) - 50):
            places.setdefault(tuple(w[p : p + 51]), []).append((d, p))
    covered = {d: set() for d in worded}
    for found in places.values():
        if len(found) > 1:
            for d, p in found:
                covered[d] |= set(range(p, p + 51))
    key = lambda t: xxhash.xxh3_128_digest((t or "").encode())
    want = {key(t): len(covered[d]) for d, t in docs if covered[d]}
    got = rlindex.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {bytes(r["key"]): r["n_passage_words"] for r in got.collect()} == want and want
