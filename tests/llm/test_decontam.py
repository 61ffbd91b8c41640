import itertools
import random
import re

import numpy as np
import pytest

from ledgerloom.llm.decontam import FULL, LONG, MASKS, SHORTEST, SPAN, contaminated, drop_contaminated, short_masks


@pytest.mark.parametrize(("length", "replaced"), [(14, 2), (16, 3)])
def test_masks_find_every_run(length, replaced):
    kept = [sum(1 << (i + p) for p in mask) for mask in MASKS for i in range(length - mask[-1])]
    for places in itertools.combinations(range(length), replaced):
        assert any(not k & sum(1 << p for p in places) for k in kept)


def split(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, least_words=12, least_equal=0.75):
    out = set()
    for d, text in docs:
        own = split(text)
        for i, item in items:
            theirs, best = split(item), 0
            masks = MASKS if len(theirs) >= SPAN else [tuple(range(len(theirs)))] if len(theirs) >= SHORTEST else []
            for diagonal in range(-len(theirs), len(own)):
                pairs = [(j + diagonal, j) for j in range(len(theirs)) if 0 <= j + diagonal < len(own)]
                same = {j for p, j in pairs if own[p] == theirs[j]}
                if not any(all(j + p in same for p in m) for m in masks for j in range(len(theirs) - m[-1])):
                    continue
                score, stretch = 0, None
                for a in range(len(pairs)):
                    for b in range(a + 1, len(pairs) + 1):
                        hit = sum(j in same for _, j in pairs[a:b])
                        if (s := 3 * hit - 2 * (b - a)) > score:
                            score, stretch = s, (hit, b - a)
                if stretch and stretch[1] >= min(least_words, len(theirs)) and stretch[0] >= least_equal * stretch[1]:
                    best = max(best, stretch[0])
            if best:
                out.add((d, i, best))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 7, 9, 10, 13, 20, 30])))) for i in range(24)]
    items += [(24, items[5][1]), (25, None), (26, "")]
    docs = [(0, None), (1, ""), (2, "one"), (None, items[3][1]), (3, items[7][1]), (3, items[7][1])]
    for d in range(10, 60):
        parts = [word() for _ in range(rng.randint(0, 20))]
        for _ in range(rng.randint(0, 2)):
            w = split(rng.choice(items[:24])[1])
            w = w[rng.randint(0, 3) :] if rng.random() < 0.3 else w
            parts += [word() if rng.random() < 0.12 else x.upper() if rng.random() < 0.2 else x + "," for x in w]
            parts += [word() for _ in range(rng.randint(0, 9))]
        docs.append((d, " ".join(parts)))
    docs.append((99, " ".join(word() for _ in range(60_000)) + " " + items[-4][1]))
    frame = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute([d for d in docs if d[0] != 99], items)
    for block_words in (10**6, 40):
        rows = contaminated(frame, bench, block_words=block_words).collect()
        assert {(r["id"], r["item_id"], r["equal_words"]) for r in rows if r["id"] != 99} == want
        assert sum(r["id"] == 3 and r["item_id"] == 7 for r in rows) == 2
        assert any(r["id"] == 99 for r in rows)
        texts = dict(docs)
        for r in rows:
            assert len(split(texts[r["id"]].encode()[r["first_byte"] : r["end_byte"]].decode())) == r["aligned_words"]
    assert contaminated(frame.limit(0), bench).collect() == [] == contaminated(frame, bench.limit(0)).collect()
    assert np.all([len(m) == 6 for m in MASKS])


def brute_full(docs, items, least_words=12, least_equal=0.75):
    """Pairs with any stretch that counts, without seeds."""
    out = set()
    for d, text in docs:
        own = split(text)
        for i, item in items:
            theirs = split(item)
            least = min(least_words, len(theirs))
            for diagonal in range(1 - len(theirs), len(own)):
                same = [own[j + diagonal] == w for j, w in enumerate(theirs) if 0 <= j + diagonal < len(own)]
                if any(sum(same[a:b]) >= least_equal * (b - a) for a in range(len(same)) for b in range(a + least, len(same) + 1)):
                    out.add((d, i))
    return out


def test_full_masks_find_every_stretch():
    # Longer stretches hold one of these, or one of their lengths with fewer words replaced.
    for length in (12, 16, 20):
        kept = [sum(1 << (i + p) for p in mask) for mask in FULL for i in range(length - mask[-1])]
        for places in itertools.combinations(range(length), length // 4):
            assert any(not k & sum(1 << p for p in places) for k in kept)
    for length in range(1, LONG):
        for places in itertools.combinations(range(length), length // 4):
            assert any(not set(mask) & set(places) for mask in short_masks(length))


def test_full_finds_all_replacements(spark):
    items = [(n, " ".join(f"w{n}x{j}" for j in range(n))) for n in (*range(1, 17), 20)]
    docs = []
    for n, item in items:
        w = item.split()
        cases = [c for r in range(n // 4 + 1) for c in itertools.combinations(range(n), r)]
        for places in random.Random(n).sample(cases, min(len(cases), 600)):
            docs.append((len(docs), n, " ".join(["before", *("zz" if j in places else x for j, x in enumerate(w)), "after"])))
    frame = spark.createDataFrame([(d, t) for d, _, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["id"], r["item_id"]) for r in contaminated(frame, bench, full=True).collect()}
    assert got == {(d, n) for d, n, _ in docs}
    assert drop_contaminated(frame, bench, full=True).collect() == []


def test_full_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3)))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 4, 6, 8, 11, 12, 13, 16, 25])))) for i in range(30)] + [(30, None), (31, "")]
    docs = [(0, None), (1, "")]
    for d in range(2, 60):
        parts = [word() for _ in range(rng.randint(0, 9))]
        for _ in range(2):
            w = split(rng.choice(items[:30])[1])
            parts += [word() if rng.random() < 0.22 else x for x in w[rng.choice([0, 0, 1, 3]) :]] + [word() for _ in range(rng.randint(0, 5))]
        docs.append((d, " ".join(parts)))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_full(docs, items)
    rows = contaminated(frame, bench, full=True).collect()
    assert {(r["id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)
    assert {r["doc_id"] for r in drop_contaminated(frame, bench, full=True).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    for r in rows:
        assert len(split(dict(docs)[r["id"]].encode()[r["first_byte"] : r["end_byte"]].decode())) == r["aligned_words"]
        assert 4 * r["equal_words"] >= 3 * r["aligned_words"]
    # A benchmark of more words than may be broadcast is joined instead, with the same rows; copies are answered each.
    twice = frame.union(frame).withColumn("text_digest", frame["doc_id"])
    for own in (frame, twice):
        assert sorted(contaminated(own, bench, full=True, block_words=9).collect()) == sorted(rows * (own.count() // frame.count()))
    clean = drop_contaminated(twice, bench, full=True, block_words=9)
    assert clean.columns == twice.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(2 * [d for d in {d for d, _ in docs} - {d for d, _ in want}])
    assert contaminated(frame.limit(0), bench, full=True, block_words=9).collect() == []
