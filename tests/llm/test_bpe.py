import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from llm_fixtures import documents  # noqa: F401

from tidelog.llm import bpe
from tidelog.llm.common import table


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(bpe.vocabulary_file()))


def same(library, encoder, texts):
    found = encoder.encode(texts)
    for text, ids in zip(texts, found, strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == expected, text[:80]
        assert encoder.decode(ids.tolist()) == library.decode(expected, skip_special_tokens=False)


def test_every_character(library, encoder):
    signs = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x32000), *range(0x32000, 0x110000, 97)]]
    same(library, encoder, ["".join("a" + s + "1" + s + "! " + s for s in signs[i : i + 2000]) for i in range(0, len(signs), 2000)])


def test_shapes(library, encoder):
    rng = random.Random(1)
    texts = ["", " ", "\n\n x", "a" * 5000, "ab" * 3000, " \t\r\n  don't we'll I'M 'S", "<|endoftext|>", "a <|endoftext|><|endoftext|> b<|endoftext|"]
    texts += ["".join(rng.choice("ab 'st\n1é!日 ") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    texts.append("".join(rng.choice("abcdefgh") for _ in range(20_000)))
    same(library, encoder, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text(texts):
    vocabulary = test_any_text.__dict__.setdefault("v", bpe.Encoder(bpe.Vocabulary(bpe.vocabulary_file()), memory=20))
    library = test_any_text.__dict__.setdefault("l", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    same(library, vocabulary, texts)


def test_table(spark, library):
    documents = table(spark, "/root/testdata/sf0.001", "documents")
    rows = {row.doc_id: row for row in bpe.digests(documents).collect()}
    for key, text in documents.select("doc_id", "text").collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        row = rows.pop(key)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not rows


def test_odd_rows(documents, library):
    texts = [(1, None), (2, ""), (None, "x y"), (3, "word " * 60_000), (3, "x y"), (3, "x y")]
    frame = documents(texts).selectExpr("*", "1 as ids", "2 as n_tokens")
    rows = bpe.digests(frame).collect()
    expected = [len(library.encode(text or "", add_special_tokens=False).ids) for _, text in texts]
    assert sorted(row.n_tokens for row in rows) == sorted(expected)
    assert bpe.digests(documents([])).count() == 0
    assert {row.doc_id: row.text for row in bpe.encoded(frame).where("doc_id < 3").collect()} == {1: "", 2: ""}
