import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm.tokens import token_counts, token_ids
from marketloom.llm.vocabulary import DEFAULT_FOLDER, Encoder, PerfectHash, merge_bytes, read_ranks

VOCABULARY = os.path.join(DEFAULT_FOLDER, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")


@pytest.fixture(scope="module")
def encoder():
    ranks = read_ranks(VOCABULARY)
    return Encoder(ranks, PerfectHash.build(list(ranks), list(ranks.values())), memo_size=50)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(DEFAULT_FOLDER, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_perfect_hash_is_minimal(encoder):
    keys = list(encoder.ranks)
    assert sorted(encoder.hashed.keys) == sorted(keys) and encoder.hashed.lookup(keys).tolist() == list(encoder.ranks.values())
    assert encoder.hashed.lookup([b"no such token at all", b""]).tolist() == [-1, -1]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_equals_the_library(encoder, reference, text):
    assert encoder.encode([text])[0] == reference(text)


def test_special_strings_scripts_and_long_texts(encoder, reference):
    texts = ["<|endoftext|> is text", "費用は24.56％増え、1,083", "सन् 1990 ई. में", "a" * 5000, " " * 3000 + "x\r\n\t ", "ไม่มีช่องว่าง" * 300, "😀👍🏽" * 50]
    assert encoder.encode(texts) == [reference(t) for t in texts]


def test_merge_order(encoder):
    for word in ("antidisestablishmentarianism", "zzzzzzzzz", "ÿþ"):
        ids = merge_bytes(word.encode(), encoder.ranks)
        inverse = {v: k for k, v in encoder.ranks.items()}
        assert b"".join(inverse[i] for i in ids) == word.encode()


def test_defined_results(spark, reference):
    rows = [(1, "Hello world", 0), (2, "", 0), (3, None, 0), (4, "   ", 0), (1, "Hello world", 0), (5, "x" * 200_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(map(tuple, token_ids(df).collect()), key=str)
    assert got == sorted([(i, reference(t or "")) for i, t, _ in rows], key=str)
    assert sorted(map(tuple, token_counts(df).collect())) == sorted((i, len(reference(t or ""))) for i, t, _ in rows)
    assert token_ids(df.limit(0)).collect() == []
