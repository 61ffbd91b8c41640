import random
import re

import numpy as np
import pytest

from ledgerloom.llm import simjoin
from ledgerloom.llm.components import components
from ledgerloom.llm.simjoin import jaccard_components


def shingle_set(text):
    w = re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs, percent=75):
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted([(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))], key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    word = lambda: rng.choice(vocabulary)
    passage = [word() for _ in range(30)]
    docs = [(-1, None), (-2, ""), (-3, " \n\t"), (None, "one"), (-4, "One"), (-5, "one two three four"), (-6, "a b c d e f"), (-6, "a b c d e f")]
    while len(docs) < n:
        base = [word() for _ in range(rng.choice([3, 8, 20, 60, 120]))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = word()
            docs.append((rng.randint(0, 10**6) if rng.random() < 0.97 else None, rng.choice([" ", "\n"]).join(own)))
    return docs


@pytest.mark.parametrize(("seed", "rounds", "large"), [(1, 1, 50), (2, 0, 50), (3, 1, 2)])
def test_against_brute_force(spark, monkeypatch, seed, rounds, large):
    monkeypatch.setattr(simjoin, "LARGE", large)
    monkeypatch.setattr(simjoin, "PORTION", 3)
    docs = corpus(seed, 160)
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, row int, label string")
    got = jaccard_components(frame, rounds=rounds).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_chains(spark):
    rng = random.Random(0)
    order = rng.sample(range(200), 200)
    links = [(order[i], order[i + 1]) for i in range(199) if i % 50 != 49]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = {x: min(order[i - i % 50 : i - i % 50 + 50]) for i, x in enumerate(order)}
    assert got == want


def near_copies(seed, n, words=120, replaced=7):
    """Copies of one text, each with some words replaced: most share much and yet don't link."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    docs = []
    for d in range(n):
        own = list(base)
        for at in rng.sample(range(words), rng.randint(0, replaced)):
            own[at] = f"x{rng.randrange(10**6)}" if rng.random() < 0.8 else f"w{rng.randrange(words)}"
        docs.append((d, " ".join(own)))
    return docs


@pytest.mark.parametrize("replaced", [5, 9, 30])
def test_a_large_group_of_copies_that_do_not_link(spark, monkeypatch, replaced):
    monkeypatch.setattr(simjoin, "PORTION", 60)
    monkeypatch.setattr(simjoin, "PART", 50)
    paired = []
    verify = simjoin.Join.verify

    def counting(self, pairs):
        pairs = pairs.distinct().cache()
        paired.append(pairs.count())
        return verify(self, pairs)

    monkeypatch.setattr(simjoin.Join, "verify", counting)
    docs = near_copies(replaced, 300, replaced=replaced) + [(1000 + d, t) for d, t in near_copies(99, 20)]
    got = jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute(docs)
    assert sorted(map(tuple, got), key=str) == want
    if replaced == 9:
        assert len({c for *_, c in want}) > 50
    # Pairs that are verified one by one grow with the sets, not with their square.
    assert sum(paired) <= 10 * len(docs)


def test_answers_from_differences():
    rng = random.Random(5)
    for _ in range(50):
        base = set(rng.sample(range(200), 60))
        sets = [set(rng.sample(sorted(base), 50)) | set(rng.sample(range(400), rng.choice([1, 8, 60]))) for _ in range(12)]
        hubs = simjoin.Hubs()
        for k, x in enumerate(sets[:-1]):
            hubs.add(k, k, np.array(sorted(x), np.uint64))
        theirs = sets[-1]
        want = [k for k, x in enumerate(sets[:-1]) if 100 * len(x & theirs) >= 55 * len(x | theirs)]
        assert hubs.links(np.array(sorted(theirs), np.uint64), 55).tolist() == want


def test_dropping_with_nulls_ties_and_clashing_columns(spark):
    docs = [(None, "a b c d e f", "x"), (7, "a b c d e f", "y"), (7, "a b c d e f", "y"), (8, None, None), (9, "", None), (None, "other words", None), (3, "z " * 50_000, "n")]
    frame = spark.createDataFrame([(d, t, x, 1, 2) for d, t, x in docs], "doc_id long, text string, number string, id int, row int")
    kept = simjoin.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(7, "a b c d e f"), (8, None), (9, ""), (None, "other words"), (3, "z " * 50_000)], key=str)
    assert simjoin.drop_near_duplicates(frame.limit(0)).collect() == []


def test_a_shared_passage_alone_reads_no_text(spark, monkeypatch):
    """Texts that share a passage and cannot link by their prefixes aren't verified; one that links is."""
    paired = []
    verify = simjoin.Join.verify
    monkeypatch.setattr(simjoin.Join, "verify", lambda self, pairs: (paired.append(pairs.distinct().count()), verify(self, pairs))[1])
    own = lambda k, n=100: " ".join(f"d{k}w{i}" for i in range(n))
    docs = [(k, f"{own(k)} " + " ".join(f"p{k // 2}q{i}" for i in range(12))) for k in range(24)] + [(100, own(100)), (101, own(100, 90))]
    got = jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), rounds=0).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs)
    assert paired == [1]
