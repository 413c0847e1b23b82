import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import documents  # noqa: F401

from tidelog.llm import rankbpe
from tidelog.llm.common import table


def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
ENCODER = rankbpe.Encoder(rankbpe.ranks_file(), memory=50)


def same(text, library=LIBRARY, encoder=ENCODER):
    ids = encoder.encode(text)
    assert ids == library.encode_ordinary(text), text[:80]
    assert encoder.decode(ids) == text.encode()


def test_every_character():
    signs = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x32000), *range(0x32000, 0x110000, 97)]]
    for i in range(0, len(signs), 2000):
        same("".join("a" + s + "1" + s + "! " + s for s in signs[i : i + 2000]))


def test_shapes_and_very_long_words():
    rng = random.Random(1)
    for text in ["", " ", "\n\n x", " \t\r\n  don't we'll I'M 'S", "<|endoftext|> a", "a" * 100_000, "ab" * 50_000, "=" * 40_000 + " x"]:
        same(text)
    same("".join(rng.choice("abcdefgh") for _ in range(300_000)))
    for _ in range(500):
        same("".join(rng.choice("ab 'st\n1é!日 ") for _ in range(rng.randint(1, 60))))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=5), max_size=25, unique=True), st.text("abc ", max_size=40))
def test_any_ranks(tokens, text):
    """Vocabularies in which a joined pair can have a lower rank than the pair that it was joined from."""
    found = {bytes([byte]): rank for rank, byte in enumerate(range(256))}
    found |= {token.encode(): 256 + rank for rank, token in enumerate(tokens)}
    content = b"\n".join(base64.b64encode(token) + b" %d" % rank for token, rank in found.items())
    library = tiktoken.Encoding("any", pat_str=public_tokenizers.PATTERN, mergeable_ranks=found, special_tokens={})
    same(text, library, rankbpe.Encoder(content))


def test_queue_is_empty_between_words():
    same("abcabcabd" * 50 + " zzzzzqqqq")
    assert not any(ENCODER.ranks.groups)
    assert not any(ENCODER.ranks.buckets)


def test_table(spark):
    documents = table(spark, "/root/testdata/sf0.001", "documents")
    rows = {row.doc_id: row for row in rankbpe.digests(documents).collect()}
    for key, text in documents.select("doc_id", "text").collect():
        ids, row = LIBRARY.encode_ordinary(text or ""), rows.pop(key)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(LIBRARY.decode_bytes(ids)).hexdigest()
    assert not rows


def test_odd_rows(documents):
    texts = [(1, None), (2, ""), (None, "x y"), (3, "word " * 60_000), (3, "x y"), (3, "x y")]
    frame = documents(texts).selectExpr("*", "1 as ids", "2 as n_tokens", "3 as decoded")
    rows = rankbpe.digests(frame).collect()
    assert sorted(row.n_tokens for row in rows) == sorted(len(LIBRARY.encode_ordinary(text or "")) for _, text in texts)
    assert sum(row.doc_id is None for row in rows) == 1
    assert rankbpe.digests(documents([])).count() == 0
    found = {row.doc_id: bytes(row.decoded) for row in rankbpe.encoded(frame).where("doc_id < 3").collect()}
    assert found == {1: b"", 2: b""}


def test_words_in_use_are_kept(monkeypatch):
    encoder = rankbpe.Encoder(rankbpe.ranks_file(), memory=50)
    asked, encode = [], encoder.ranks.encode
    monkeypatch.setattr(encoder.ranks, "encode", lambda word: asked.append(word) or encode(word))
    text = " ".join(f"ofteninuse x{i}seldom" for i in range(500))
    assert encoder.decode(encoder.encode(text)) == text.encode()
    assert asked.count(b" ofteninuse") == 1
    assert len(encoder.words) + len(encoder.words.older) <= 50
    assert len(encoder.chunks) + len(encoder.chunks.older) <= 50
