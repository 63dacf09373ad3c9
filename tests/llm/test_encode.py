import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.encode import VOCABULARIES, Encoder, PairTable, encode_corpus, pieces

PATH = os.path.join(VOCABULARIES, "byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")
ODD = ["", None, " ", "\n\n  a", "<|endoftext|>hi", "a" * 5000, "ab" * 3000, " " * 3000 + "x", "\x1c\x1d a\x85b", "\U0001f600" * 500, "I'm DON'T we'll's", "\r\n\t x", "é" * 99, "日本語" * 200]


@pytest.fixture(scope="module")
def known():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PairTable.load(PATH), cache=1000)


def test_odd_texts_equal_the_public_encoder(known, encoder):
    assert list(encoder.encode(ODD)) == known(ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80), max_size=5))
def test_any_text_equals_the_public_encoder(known, encoder, texts):
    assert list(encoder.encode(texts)) == known(texts)


def test_random_words_fill_and_clear_the_cache(known, encoder):
    rng = random.Random(8)
    for _ in range(5):
        texts = ["".join(rng.choices("abcdefghij  ", k=400)) for _ in range(40)]
        assert list(encoder.encode(texts)) == known(texts)


def test_corpus(spark, known):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(3, ODD[3], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode_corpus(df).collect())
    assert got == sorted((i, ids) for (i, _, _), ids in zip(rows, known([t for _, t, _ in rows])))
    sizes = {r.doc_id: r.n_tokens for r in encode_corpus(df, lengths_only=True).collect()}
    assert sizes == {i: len(ids) for i, ids in got}
    assert encode_corpus(df.limit(0)).collect() == []


def test_pieces_cover_a_batch_in_order():
    texts = ["a" * 5, None, "b" * 100, "", "c" * 3]
    assert [texts[p] for p in pieces(texts, 6)] == [["a" * 5, None], ["b" * 100], ["", "c" * 3]]
    assert list(pieces([])) == []


def test_a_megabyte_of_unbroken_letters(known):
    """Long words go through the heap, in bounded time; the public encoder agrees on a piece that it can do."""
    word = "".join(random.Random(3).choices("abcdefghijklmnop", k=1_000_000))
    encoder = Encoder(PairTable.load(PATH))
    assert list(encoder.encode([word[:60_000], "a" * 50_000]))  == known([word[:60_000], "a" * 50_000])
    assert len(next(iter(encoder.encode([word])))) > 300_000
    assert next(iter(Encoder(PairTable.load(PATH), lengths_only=True).encode([word[:60_000]]))) == len(known([word[:60_000]])[0])
