import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import documents  # noqa: F401

from tidelog.llm import lm
from tidelog.llm.common import table


def tokens_of(text):
    return [*"".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split(), None]


def trained(key):
    return zlib.crc32(b"" if key is None else str(key).encode()) % 10 != 0


def plain_scores(rows, order, mu=lm.MU):
    counts = [Counter() for _ in range(order + 1)]
    contexts = [Counter() for _ in range(order + 1)]
    for key, text in rows:
        if trained(key):
            told = ["<s>", *tokens_of(text)]
            for t in range(1, len(told)):
                for k in range(1, order + 1):
                    if t - k + 1 >= 0:
                        counts[k][tuple(told[t - k + 1 : t + 1])] += 1
                        contexts[k][tuple(told[t - k + 1 : t])] += 1
    n, v = sum(counts[1].values()), len(counts[1])

    def probability(told, t, k):
        if k == 1:
            return (counts[1][(told[t],)] + 0.1) / (n + 0.1 * (v + 1))
        lower = probability(told, t, k - 1)
        if t - k + 1 < 0:
            return lower
        return (counts[k][tuple(told[t - k + 1 : t + 1])] + mu * lower) / (contexts[k][tuple(told[t - k + 1 : t])] + mu)

    out = []
    for key, text in rows:
        told = ["<s>", *tokens_of(text)]
        base = sum(math.log10(probability(told, t, 1)) for t in range(1, len(told)))
        score = sum(math.log10(probability(told, t, order)) for t in range(1, len(told)))
        known = sum(counts[1][(w,)] > 0 for w in told[1:])
        out.append((key, not trained(key), len(told) - 1, known, n, base, score))
    return out


def compare(found, expected):
    order = lambda row: (str(row[0]), *row[2:4], round(row[5], 6))
    found, expected = sorted(map(tuple, found), key=order), sorted(expected, key=order)
    assert [row[:5] for row in found] == [row[:5] for row in expected]
    for a, b in zip(found, expected, strict=True):
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
        assert a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("block_bytes", [2000, 1 << 20])
def test_against_plain_counts(documents, order, block_bytes):
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice("the a of Dog cat é x").strip() for _ in range(rng.randint(0, 30)))) for i in range(200)]
    rows += [(None, "the cat"), (3, "the cat"), (3, "the cat"), (500, None), (501, ""), (502, "new words\x0bonly\there")]
    found = lm.scored(documents(rows).selectExpr("*", "1 as block", "2 as score"), order, block_bytes).collect()
    compare(found, plain_scores(rows, order))


def test_table(spark):
    documents = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(row) for row in documents.select("doc_id", "text").collect()]
    compare(lm.scored(documents, block_bytes=100_000).collect(), plain_scores(rows, lm.ORDER))


def test_held_out_text_is_predicted_better(spark):
    documents = table(spark, "/root/testdata/sf0.1", "documents")
    rows = lm.scored(documents).where("held_out").select("score", "base_score").collect()
    assert sum(row.score for row in rows) > sum(row.base_score for row in rows)


def test_states_are_distributions():
    """The probabilities of all known words and of any unknown one add up to one in every state."""
    rows = [(1, "a b a c"), (2, "b a a"), (4, "c")]
    assert all(trained(key) for key, _ in rows)
    words = ["a", "b", "c", "zzz"]
    for start in ("", "a ", "b ", "a b "):
        total = 0.0
        for word in [*words, None]:
            probe = start.split() + ([word] if word else [])
            text = " ".join(probe)
            block = lm.Block([t for _, t in rows] + [text], lm.np.array([True, True, True, False]), 2)
            base, weight = lm.Automaton(block, block.count, 11, 4).read()
            at = block.first[3] + len(start.split())
            total += 10 ** weight[at]
        assert total == pytest.approx(1.0)


def test_empty(documents):
    assert lm.scored(documents([])).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_segments_do_not_change_scores(monkeypatch, order):
    rng = random.Random(order)
    texts = [" ".join(rng.choices("abcde", k=rng.randint(0, 60))) for _ in range(20)] + [None, ""]
    block = lm.Block(texts, np.array([i % 4 > 0 for i in range(len(texts))]), order)
    tokens, words = int(block.count[0].sum()), int((block.count[0] > 0).sum())
    whole = lm.Automaton(block, block.count, tokens, words).read()
    for segment in (1, 2, 7):
        monkeypatch.setattr(lm, "SEGMENT", segment)
        for found, expected in zip(lm.Automaton(block, block.count, tokens, words).read(), whole, strict=True):
            assert np.allclose(found, expected, rtol=0, atol=1e-12)


def test_the_order_of_rows_does_not_matter():
    """Blocks are built twice, from rows in any order: they list the same n-grams."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdef", k=rng.randint(0, 9))) for _ in range(60)]
    first, second = (lm.Block(own, np.ones(len(own), bool), 4) for own in (texts, texts[::-1]))
    for a, b in zip(first.unique, second.unique, strict=True):
        assert a.tolist() == b.tolist()
    for a, b in zip(first.count, second.count, strict=True):
        assert a.tolist() == b.tolist()


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for values in ([], [0, 0], [0, 255, 256], [2**64 - 1, 0], range(70_000), rng.integers(0, 2**63, 5000) >> rng.integers(0, 63, 5000)):
        values = np.array(values, np.uint64)
        assert lm.numbers(lm.planes(values)).tolist() == values.tolist()


def test_what_is_shuffled_is_small(spark):
    documents = table(spark, "/root/testdata/sf0.1", "documents").coalesce(1)
    size = documents.selectExpr("sum(octet_length(text))").first()[0]
    assert lm.blocks_of(documents, lm.BLOCK_BYTES).selectExpr("sum(octet_length(texts))").first()[0] < 0.45 * size
    # A hash of a block of 2 ** 20 tells little more than the 44 bits by which it is ahead of the one before.
    hashes = np.sort(np.random.default_rng(3).integers(0, 2**64, 1 << 20, np.uint64))[: 1 << 14]
    assert len(lm.planes(np.diff(hashes, prepend=hashes[0]))) < 5.9 * len(hashes)
