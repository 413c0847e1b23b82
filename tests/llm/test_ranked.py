import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import documents  # noqa: F401

from tidelog.llm import ranked
from tidelog.llm.common import table

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(documents, items, top=10):
    """(item_id, rank, doc_id, score) of (doc_id, text) and (item_id, text) rows, every score computed."""
    counted = [(key, Counter(terms(text))) for key, text in documents]
    counted = [(key, c) for key, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        asked, found = set(terms(text)), []
        for key, c in counted:
            m = 10 + 90 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked & c.keys())
            if score > 0:
                found.append((-score, key is not None, key or 0, key))
        out += [(item, rank, key, -score) for rank, (score, _, _, key) in enumerate(sorted(found, key=lambda f: f[:3])[:top], 1)]
    return sorted(out, key=str)


def rows(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture
def items(spark):
    return lambda pairs: spark.createDataFrame(pairs, "item_id long, text string")


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK", 3)


def words(rng, size, count):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % size}" for _ in range(count))


@pytest.mark.parametrize("cells, item_bytes", [(1 << 24, 1 << 20), (200, 60)])
def test_random_texts(documents, items, small, cells, item_bytes):
    rng = random.Random(3)
    texts = [(i, words(rng, 60, rng.randint(0, 25))) for i in range(300)]
    asked = [(i, words(rng, 60, rng.randint(1, 8))) for i in range(20)]
    found = ranked.search(documents(texts), items(asked), item_bytes=item_bytes, cells=cells)
    assert rows(found) == brute(texts, asked)
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_table(spark):
    texts = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    asked = table(spark, "/root/testdata/sf0.001", "benchmark").select("item_id", "text")
    assert rows(ranked.search(texts, asked)) == brute(list(map(tuple, texts.collect())), list(map(tuple, asked.collect())))


def test_ties_nulls_and_repeats(documents, items):
    texts = [(9, "Alpha beta"), (4, "alpha-BETA"), (4, "alpha beta"), (None, "alpha beta"), (5, None), (6, ""), (7, "..."), (8, "other words é日1"), (10, "x " * 50_000 + "alpha")]
    asked = [(1, "beta ALPHA beta"), (2, None), (3, ""), (4, "absent"), (None, "É日1 É日1"), (1, "words"), (1, "words")]
    found = ranked.search(documents(texts).selectExpr("*", "1 as score", "2 as terms", "3 as id"), items(asked).selectExpr("*", "4 as copies"), top=4)
    assert rows(found) == brute(texts, asked, 4)
    assert [r.doc_id for r in found.where("item_id = 1").orderBy("rank").collect()].count(8) == 2


def test_nothing(documents, items):
    assert ranked.search(documents([]), items([(1, "a")])).count() == 0
    assert ranked.search(documents([(1, "a")]), items([])).count() == 0
    assert ranked.search(documents([(1, "...")]), items([(1, "a")])).count() == 0


def test_blocks_are_skipped_and_no_document_is_missed(small):
    rng = random.Random(5)
    groups = [[f"g{g}t{t}" for t in range(12)] for g in range(8)]
    texts = [" ".join(rng.choices(groups[i % 8], k=10) + ["common"]) for i in range(400)]
    vocabulary = {t: i for i, t in enumerate(sorted({t for text in texts for t in text.split()}))}
    held = [np.unique([vocabulary[t] for t in text.split()], return_counts=True) for text in texts]
    df = np.bincount(np.concatenate([h for h, _ in held]))
    weights = np.array([ranked.weight(len(texts), d) for d in df.tolist()])
    asked = [[vocabulary[t] for t in [*rng.sample(g, 4), "common"]] for g in groups]
    questions = ranked.Questions(asked, weights)
    signs = np.random.default_rng(1).choice(np.array([-1, 1], np.float32), (len(weights), ranked.SKETCH))
    row = np.repeat(np.arange(len(texts)), [len(h) for h, _ in held])
    times = np.concatenate([c for _, c in held])
    impacts = 10**9 * times // (1000 * times + 800)
    shard = ranked.Shard(questions, signs, row, questions.place[np.concatenate([h for h, _ in held])], impacts, len(texts))
    for i, item in enumerate(questions.items):
        best = ranked.Best(10)
        best.shard_ids, best.shard_named = np.arange(len(texts)), np.ones(len(texts), bool)
        shard.search(i, best)
        scores = shard.impacts[:, item] @ questions.weights[item]
        assert best.ids.tolist() == np.lexsort((np.arange(len(texts)), -scores))[:10].tolist()
    assert shard.skipped > shard.seen / 4
    # Every summary is the exact maximum over its block.
    listed, starts, summary = shard.blocks(0)
    for b in range(len(summary)):
        assert (summary[b] == shard.impacts[listed[starts[b] : starts[b + 1]]][:, questions.coordinates[0]].max(axis=0)).all()
