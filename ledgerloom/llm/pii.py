"""Personal data by candidate gradient boosting over a base of exact patterns.

Base spans are the leftmost, non-overlapping matches of four kinds that pass their checks; they
always stay. High-recall generators propose further spans, which may overlap each other and the base:
telephone numbers in national form, social security numbers, account numbers (IBAN) and addresses
spelled with "at" and "dot". Boosted trees judge a proposal by its format (digits, groups, separators,
checksums) and its context (words before it, characters around it); each generator has a threshold on
the calibrated probability at which its calibration examples reach a precision of 0.98. Of proposals
that overlap, the more probable is taken, and none that overlaps a base span.

The trees are trained here, on examples that a seeded generator writes: real and spurious values in
varied surroundings. The corpus is not looked at, so a span depends on its text alone.

Defined results: a null or empty text has no spans; repeated rows are answered each; an empty table
gives no rows; offsets are code points. Only the two named columns are read. Every pattern takes time
in proportion to the text, also in very long runs of digits.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import boosting

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("national", "ssn", "iban", "spelled")
KINDS = BASE_KINDS + ADDED_KINDS

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where a run of digits does: later starts in a run that fails would fail as well.
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

NATIONAL = re.compile(r"(?<![0-9+.\w])\(?[0-9]{2,5}\)?(?:[ .-]?\(?[0-9]{2,5}\)?){1,4}(?![0-9\w])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SPELLED = re.compile(r"(?<![\w.])[A-Za-z0-9._-]{2,40} ?(?:\(at\)|\[at\]|(?<= )at(?= )) ?[A-Za-z0-9-]{2,40}(?: ?(?:\(dot\)|\[dot\]|(?<= )dot(?= )|\.) ?[A-Za-z]{2,12}){1,3}(?![\w])", re.I)

#: Words before a value that speak for a kind.
CUES = {
    "national": ("phone", "tel", "call", "mobile", "fax", "cell", "contact", "text"),
    "ssn": ("ssn", "social", "security", "taxpayer", "tin"),
    "iban": ("iban", "account", "bank", "transfer", "pay"),
    "spelled": ("mail", "email", "contact", "write", "reach", "address"),
}
#: Words before a value that speak against any.
DOUBTS = ("order", "invoice", "version", "isbn", "page", "room", "total", "price", "item", "part", "serial", "model", "date", "year", "chapter", "id")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the run of local characters before it, as far as no earlier match holds them."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            free = m.end()
        elif at + 1 < len(text):
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    return out


def _part(digits: str) -> bool:
    return len(digits.lstrip("0")) <= 3 and int(digits.lstrip("0") or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end), by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in IP.finditer(text) if all(map(_part, m.groups()))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) of everything that may be one of the added kinds."""
    out = []
    if DIGIT.search(text):
        for kind, pattern in ((4, NATIONAL), (5, SSN), (6, IBAN)):
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    if "(at)" in (low := text.lower()) or "[at]" in low or " dot " in low:
        out += [(7, *m.span()) for m in SPELLED.finditer(text)]
    return out


def iban_valid(value: str) -> bool:
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a proposal."""
    value, name = text[start:end], KINDS[kind]
    digits = "".join(c for c in value if c.isdigit())
    groups = [len(g) for g in re.findall(r"[0-9]+", value)]
    seps = {c for c in value if not c.isalnum()}
    before = text[max(0, start - 32) : start].lower()
    words = re.findall(r"[a-z]+", before)
    after = text[end : end + 1]
    area = digits[:3]
    return [
        kind, len(value), len(digits), len(groups), groups[0] if groups else 0, groups[-1] if groups else 0, max(groups, default=0), len(seps),
        "-" in seps, "." in seps, " " in seps, "(" in seps, digits[:1] == "0", digits[:1] == "1", luhn(digits),
        name == "iban" and iban_valid(value), name == "ssn" and area not in ("000", "666") and area < "900" and digits[3:5] != "00" and digits[5:] != "0000",
        "(at)" in value.lower() or "[at]" in value.lower(), "(dot)" in value.lower() or "[dot]" in value.lower(), " dot " in value.lower(),
        any(c in w for w in words[-3:] for c in CUES[name]), any(w in DOUBTS for w in words[-3:]), before[-1:] in ("#", "$", "€", "/", "=", ""), before.rstrip()[-1:] == ":",
        after in ("%", "/", "=", "$", "€"), after in (".", ",", ")", " ", "\n", ""),
    ]


def _check_digits(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def examples(n: int, seed: int) -> list[tuple[str, int, int, int, int]]:
    """(text, kind, start, end, real): values of the four kinds, and look-alikes, in varied surroundings."""
    rng = random.Random(seed)
    some = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    out = []
    while len(out) < n:
        kind, real, cued, doubted = rng.randint(4, 7), rng.random() < 0.5, rng.random() < 0.7, rng.random() < 0.6
        name = KINDS[kind]
        if name == "national":
            if real:
                area, mid, last = rng.choice("23456789") + some(2), rng.choice("23456789") + some(2), some(4)
                value = rng.choice([f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"0{some(2)} {some(4)} {some(4)}", f"0{some(3)} {some(3)} {some(3)}"])
                cued = cued or "(" not in value
            else:
                value = rng.choice([f"{some(4)}-{some(2)}-{some(2)}", f"{some(2)}.{some(2)}.{some(4)}", some(rng.randint(4, 19)), f"{some(3)} {some(3)}", f"{some(2)} {some(2)} {some(2)}", f"{some(4)}-{some(4)}", f"{some(3)}-{some(5)}-{some(2)}", f"{some(3)}-{some(3)}-{some(4)}"])
                cued = False
        elif name == "ssn":
            area = f"{rng.randint(1, 665):03d}" if real else rng.choice(["000", "666", f"9{some(2)}", some(3)])
            value = f"{area}{(sep := rng.choice('-- '))}{rng.randint(1, 99):02d}{sep}{rng.randint(1, 9999):04d}"
            cued = real
        elif name == "iban":
            country, body = rng.choice(["DE", "FR", "ES", "GB", "NL", "IT"]), some(rng.choice([14, 18, 20, 23]))
            value = country + (_check_digits(country, body) if real else some(2)) + body
            if rng.random() < 0.4:
                value = " ".join(value[i : i + 4] for i in range(0, len(value), 4))
            if not real and iban_valid(value):
                continue
        else:
            at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "."), ("[at]", ".")]) if real else (" at ", rng.choice([" dot ", ". "]))
            value = f"{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de']) if real else word()}"
            if not real and dot == " dot ":
                value, cued = f"{word()} at {word()} dot {word()}s", False
        cue = rng.choice(CUES[name]) if real and cued else rng.choice(DOUBTS) if not real and doubted else word()
        head = f"{word()} {word()} {cue}{rng.choice([' ', ': ', ' is ', ' '])}"
        if not real and rng.random() < 0.2:
            head += rng.choice("#$/=")
        out.append((head + value + rng.choice([" ", ".", ",", "\n", "%" if not real else " "]) + word(), kind, len(head), len(head) + len(value), int(real)))
    return out


@dataclass
class Judge:
    forest: boosting.Forest
    slope: float
    shift: float
    thresholds: dict[int, float]

    def probabilities(self, rows: list[list[float]]) -> np.ndarray:
        return boosting.sigmoid(self.slope * self.forest.raw(np.array(rows, float)) + self.shift)


@lru_cache(1)
def judge(n: int = 3000, seed: int = 11, precision: float = 0.98) -> Judge:
    """Trees from two thirds of the examples; calibration and thresholds from the rest."""
    made = examples(n, seed)
    x = np.array([features(t, k, a, b) for t, k, a, b, _ in made], float)
    y = np.array([e[-1] for e in made], float)
    cut = 2 * n // 3
    forest = boosting.fit(x[:cut], y[:cut])
    z, kinds, told = forest.raw(x[cut:]), x[cut:, 0], y[cut:]
    slope, shift = boosting.calibrate(z, told)
    p = boosting.sigmoid(slope * z + shift)
    thresholds = {}
    for kind in range(len(BASE_KINDS), len(KINDS)):
        own, real = p[kinds == kind], told[kinds == kind]
        order = np.argsort(-own)
        good = np.cumsum(real[order]) / np.arange(1, len(order) + 1) >= precision
        thresholds[kind] = max(0.5, float(own[order][np.flatnonzero(good)[-1]])) if good.any() else 1.1
    return Judge(forest, slope, shift, thresholds)


def select(base: list[tuple[int, int, int]], proposed: list[tuple[int, int, int]], p: np.ndarray, thresholds: dict[int, float]) -> list[tuple[int, int, int]]:
    """The base and, from the most probable on, proposals over their thresholds that overlap nothing taken."""
    if not proposed:
        return base
    # Disjoint intervals by start: only the neighbours of a proposal can overlap it.
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if starts and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    added = []
    for i in sorted(range(len(proposed)), key=lambda i: (-p[i], proposed[i])):
        kind, a, b = proposed[i]
        if p[i] < thresholds[kind]:
            continue
        at = bisect_right(starts, a)
        if (at == 0 or ends[at - 1] <= a) and (at == len(starts) or starts[at] >= b):
            starts.insert(at, a)
            ends.insert(at, b)
            added.append((kind, a, b))
    return base + sorted(added)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = judge()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    for batch in batches:
        rows = []
        for value in batch.column("text"):
            text = value.as_py() or ""
            base, proposed = base_spans(text), proposals(text)
            p = own.probabilities([features(text, *x) for x in proposed]) if proposed else np.empty(0)
            rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": k < len(BASE_KINDS)} for k, a, b in select(base, proposed, p, own.thresholds)])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, span)], ["id", "spans"])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of each row; spans of (kind, start, end, base) by kind as listed in ``KINDS``, then start."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(_find, f"id {kind}, spans array<struct<kind: string, start: int, end: int, base: boolean>>")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; of spans that overlap, the union goes."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]
