import random
import re
import time

import numpy as np
import pytest

from ledgerloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_against_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice(["a", "@", ".", "1", "+", "2", " ", "-", "(", "9", ")", "%", "é", "4111 1111 1111 1111", "10.0.0.1"]) for _ in range(rng.randint(1, 25)))
        assert pii.base_spans(text) == brute(text)


def test_judge():
    own = pii.judge()
    told = pii.examples(1500, 99)
    p = own.probabilities([pii.features(t, k, a, b) for t, k, a, b, _ in told])
    taken = [p_ >= own.thresholds[k] for p_, (_, k, *_) in zip(p, told, strict=True)]
    good = sum(t and e[-1] for t, e in zip(taken, told, strict=True))
    assert good >= 0.95 * sum(taken) and good >= 0.9 * sum(e[-1] for e in told)


@pytest.mark.parametrize(
    ("text", "kinds"),
    [("call me: phone (212) 555-0142.", ["national"]), ("my ssn 123-45-6789 ok", ["ssn"]), ("iban DE89370400440532013000", ["iban"]), ("mail joe(at)site(dot)com", ["spelled"]), ("order 123456", []), ("version 10.2.3", []), ("", [])],
)
def test_added(text, kinds):
    proposed = pii.proposals(text)
    p = pii.judge().probabilities([pii.features(text, *x) for x in proposed]) if proposed else []
    assert [pii.KINDS[k] for k, _, _ in pii.select(pii.base_spans(text), proposed, p, pii.judge().thresholds)] == kinds


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a@b.c", "x"), (2, "1" * 200_000, "x"), (2, "é a@b.c +1 (437) 555-0689", "x")], "doc_id long, text string, spans string")
    got = {(r["id"], tuple((s["kind"], s["start"], s["end"]) for s in r["spans"])) for r in pii.find_personal_data(docs).collect()}
    assert got == {(1, ()), (None, (("email", 0, 5),)), (2, ()), (2, (("email", 2, 7), ("phone", 8, 25)))}
    assert pii.find_personal_data(docs.limit(0)).collect() == []
    assert pii.redact("é a@b.c +1 (437) 555-0689!", [("email", 2, 7), ("phone", 8, 25)]) == "é [email] [phone]!"


def test_selection_against_comparing_all():
    rng = random.Random(8)
    for _ in range(200):
        span = lambda: (lambda a: (a, a + rng.randint(1, 6)))(rng.randint(0, 40))
        base = [(rng.randint(0, 3), *span()) for _ in range(rng.randint(0, 5))]
        proposed = [(rng.randint(4, 7), *span()) for _ in range(rng.randint(0, 12))]
        p = np.array([rng.choice([0.2, 0.6, 0.7, 0.9]) for _ in proposed])
        taken, added = [(a, b) for _, a, b in base], []
        for i in sorted(range(len(proposed)), key=lambda i: (-p[i], proposed[i])):
            kind, a, b = proposed[i]
            if p[i] >= 0.5 and not any(a < d and c < b for c, d in taken):
                taken.append((a, b))
                added.append((kind, a, b))
        assert pii.select(base, proposed, p, dict.fromkeys(range(8), 0.5)) == base + sorted(added)


def test_a_hundred_thousand_proposals():
    proposed = [(5, 12 * i, 12 * i + 11) for i in range(100_000)]
    began = time.perf_counter()
    assert len(pii.select([], proposed, np.ones(100_000), {5: 0.5})) == 100_000
    assert time.perf_counter() - began < 5
