import json
from collections import Counter, defaultdict
from hashlib import sha256
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import align, queries
from ledgerloom.llm.tokens import byte_letters

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(FILES[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
BYTE_OF = {letter: b for b, letter in byte_letters().items()}
TEXTS = [
    None, "", " ", "a", "it's  two   spaces ", "a<|endoftext|>b <s> </s> <unk> <0x41>", "a▁b", "naïve café, 北京 \U0001f600\U0001f600", "\x00\x01\r\n\t",
    "word " * 300, "xyzzy" * 500, "the same text", "the same text", "ﬁne é",
]


def side(ids, spell):
    parts = [spell(i) for i in ids]
    return ids, parts, np.cumsum([len(p) for p in parts]).tolist()


def brute(text):
    """Groups as lists of identifiers and links as pairs, by walking both sides' ends."""
    if not text:
        return [], []
    own = f" {text}"
    encoded = A.encode(own, add_special_tokens=False)
    a, a_parts, a_ends = side(encoded.ids, lambda i: bytes(BYTE_OF[c] for c in A.id_to_token(i)))
    b, b_parts, b_ends = side(B.encode(text), lambda i: bytes([int(B.id_to_piece(i)[3:-1], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode())
    if not b"".join(a_parts) == own.encode() == b"".join(b_parts):
        return [], []
    groups, lo, before = [], 0, 0
    for end in sorted(set(a_ends) & set(b_ends)):
        i, j = a_ends.index(end) + 1, b_ends.index(end) + 1
        groups.append((a[lo:i], b[before:j]))
        lo, before = i, j
    return groups, [(i, j) for i, x in zip(a, a_ends) for j, y in zip(b, b_ends) if x == y]


def expected(texts):
    found = [brute(t) for t in texts]
    counts = Counter(p for _, links in found for p in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for groups, links in found:
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sizes = [sum(len(g[k]) for g in groups) for k in (0, 1)]
        out.append((*sizes, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), sha256(said.encode()).hexdigest() if groups else ""))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [10, 1 << 20])
def test_texts(spark, monkeypatch, block):
    monkeypatch.setattr(align, "BLOCK", block)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, block string, pairs int").repartition(3)
    rows, pairs = align.align_tokenizers(docs, *FILES)
    assert rows_of(rows) == sorted(((i, *e) for i, e in enumerate(expected(TEXTS))), key=str)
    counts = Counter(p for t in TEXTS for p in brute(t)[1])
    assert {(r.a_id, r.b_id): r.n for r in pairs.collect()} == counts


def test_groups(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    said = {r.id: r.groups for r in align.token_groups(docs, *FILES).collect()}
    assert said == {i: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in brute(t)[0]) for i, t in enumerate(TEXTS)}


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = queries.op11_align(spark, "/root/testdata/sf0.001")
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert rows_of(got.select(*columns)) == sorted(((d.doc_id, *e) for d, e in zip(docs, expected([d.text for d in docs]))), key=str)


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (3, None)], "doc_id long, text string")
    rows, _ = align.align_tokenizers(docs, *FILES)
    assert [r.n_a for r in rows.orderBy("id").collect()] == [2, 2, 0]
    rows, pairs = align.align_tokenizers(docs.limit(0), *FILES)
    assert rows.collect() == [] and pairs.collect() == []


def test_pieces_of_long_texts(monkeypatch):
    """Texts cut into pieces have the tokens of the whole."""
    own = align.tokenizers(*FILES)
    assert own.cuts
    text = " ".join(["It's a trial,  of long—texts x1 y_2", "и слова", "end.\nNew line here"] * 40)
    whole = A.encode(f" {text}", add_special_tokens=False).ids, B.encode(text)
    for size in (1, 7, 50):
        monkeypatch.setattr(align, "PIECE", size)
        assert len(list(own.pieces(text))) > 20
        assert next(own.encode([text])) == whole


@given(st.text(st.sampled_from("ab .,'s\n\t\xa0▁é北1<>|") | st.characters(codec="utf-8"), max_size=80))
@settings(max_examples=300, deadline=None)
def test_faster_library(text):
    """Ranks give the tokens of A's own library."""
    assert align.tokenizers(*FILES, True).encode_a(text) == A.encode(text, add_special_tokens=False).ids


def test_ranked(tmp_path):
    """The file at hand is proved; one whose merges don't decide is not."""
    ranks = align.ranked(FILES[0])
    assert len(ranks) == 50256 and max(ranks.values()) == 50255
    for text in ("a" * 5000, " " * 5000, "<|endoftext|>", "ab" * 700):
        assert align.tokenizers(*FILES, True).encode_a(text) == A.encode(text, add_special_tokens=False).ids
    spec = json.loads(Path(FILES[0]).read_text())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "prefix.json").write_text(json.dumps(spec))
    assert align.ranked(str(tmp_path / "prefix.json")) is None
    letters = byte_letters()
    vocab = {letters[b]: b for b in range(256)} | {"ab": 256, "bc": 257, "abc": 258}
    odd = {"model": {"vocab": vocab, "merges": ["a b", "b c", "a bc"]}, "pre_tokenizer": {"type": "ByteLevel"}, "added_tokens": []}
    (tmp_path / "odd.json").write_text(json.dumps(odd))
    assert align.ranked(str(tmp_path / "odd.json")) is None
    odd["model"]["merges"][2] = "ab c"
    (tmp_path / "even.json").write_text(json.dumps(odd))
    assert align.ranked(str(tmp_path / "even.json")) is not None


@given(st.lists(st.integers(1, 9), min_size=1, max_size=40), st.lists(st.integers(1, 9), min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_components_are_least_groups(a, b):
    """Union-find over overlaps against cutting where both sides end."""
    a, b = [*a, max(0, sum(b) - sum(a))], [*b, max(0, sum(a) - sum(b))]
    ends_a, ends_b = (np.cumsum([x for x in side if x]) for side in (a, b))
    both = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    found = align.aligned(ends_a, ends_b)
    assert found.group_a.tolist() == np.searchsorted(both, ends_a, "left").tolist()
    assert found.group_b.tolist() == np.searchsorted(both, ends_b, "left").tolist()
    assert ends_a[found.last_a].tolist() == ends_b[found.last_b].tolist() == both


@given(st.integers(1, 30), st.lists(st.tuples(st.integers(0, 29), st.integers(0, 29)), max_size=40))
def test_united(n, edges):
    edges = [(u % n, v % n) for u, v in edges]
    label = list(range(n))
    for _ in range(n):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    u, v = np.array(edges, np.int64).reshape(-1, 2).T
    assert align.united(n, u, v).tolist() == label
