import duckdb
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm.tokens import Counter, count_tokens

FILE = public_tokenizers.path("byte_bpe_50k.json")
OWN = Counter(FILE)
LIBRARY = Tokenizer.from_file(FILE)


def expected(text: str) -> int:
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    assert OWN.count(text) == expected(text)


@pytest.mark.parametrize("text", ["", " ", "\n\n  \n", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "x <|endoftext|>  y", "it's we'LL", "ab" * 20000, "aaaa" * 5000, "é" * 999, "\x1c\x1d \x85  x​", "12 345,6 ½ Ⅷ"])
def test_texts(text):
    assert OWN.count(text) == expected(text)


def test_documents():
    rows = duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' limit 400").fetchall()
    assert [OWN.count(t) for (t,) in rows] == [expected(t) for (t,) in rows]


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "u"), (None, "hello world", "v"), (2, "", "w"), (2, "", "w")], "doc_id long, text string, id string")
    got = sorted(map(tuple, count_tokens(docs, FILE).collect()), key=str)
    assert got == sorted([(1, 0, 0), (None, 11, 2), (2, 0, 0), (2, 0, 0)], key=str)
    assert count_tokens(docs.limit(0), FILE).collect() == []
