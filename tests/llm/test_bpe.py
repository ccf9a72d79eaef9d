"""Encoding against the tokenizer library, and exact round trips."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from viewmill.llm import bpe
from viewmill.session import table

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def encode():
    return bpe.Encoder(bpe.load())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(list(texts), add_special_tokens=False)]


def test_documents(spark, library):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode_texts(docs).collect()}
    assert ids == dict(zip(texts, library(texts.values()), strict=True))
    back = bpe.decode_ids(bpe.encode_texts(docs))
    assert {r.doc_id: r.text for r in back.collect()} == texts


def test_every_word_length(encode, library):
    texts = [c * n for c in ("a", " ", "ab", "=", "ha", "\n") for n in range(1, 150)]
    assert [encode(t) for t in texts] == library(texts)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_random_texts(encode, library, text):
    assert encode(text) == library([text])[0]
    assert encode.automaton.decode(encode(text)) == text


def test_rank_file_equals_merges(encode):
    by_rank = bpe.load(bpe.VOCABULARY.replace(".json", ".tiktoken"))
    assert by_rank.labels == encode.automaton.labels[: len(by_rank.labels)]
    assert bpe.Encoder(by_rank)("Merges in order, 1234 ways!") == encode("Merges in order, 1234 ways!")


def test_small_automaton_paths():
    """The paths of the automaton are the outputs of plain BPE, and no others."""
    a = bpe.MergeAutomaton(list(range(256)), 260)
    x, y, z = b"xyz"
    merges = [(x, x, 256), (x, y, 257), (256, y, 258), (257, z, 259)]
    for m in merges:
        a.add_merge(*m)

    def plain(word):
        ids = list(word)
        for u, v, w in merges:
            i = 0
            while i < len(ids) - 1:
                if (ids[i], ids[i + 1]) == (u, v):
                    ids[i : i + 2] = [w]
                i += 1
        return ids

    import itertools

    for n in range(1, 8):
        for word in itertools.product(b"xyz", repeat=n):
            assert a.encode_word(bytes(word)) == plain(word)


def test_null_empty_special_and_empty_table(spark, encode):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<|endoftext|>", "x"), (3, "a" * 100_000, "x")], "doc_id long, text string, ids string")
    rows = bpe.encode_texts(df).collect()
    assert [r.ids for r in rows if r.doc_id in (1, 2)] == [[], []]
    assert sum(r.doc_id == 3 for r in rows) == 2 and all(50256 not in r.ids for r in rows)
    assert bpe.encode_texts(df.limit(0)).count() == 0
