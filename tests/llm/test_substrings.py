import hashlib
import random

import numpy as np
import pytest
from llm_fixtures import documents  # noqa: F401

from tidelog.llm import substrings
from tidelog.llm.common import table


def plain(rows):
    """(doc_id, bytes, removed, spans, digest) by a dictionary of all windows; rows are in document order."""
    seen, out = set(), []
    for key, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for at in range(len(data) - 99):
            window = data[at : at + 100]
            if window in seen:
                gone[at : at + 100] = True
            seen.add(window)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out.append((key, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(frame, rows):
    found = sorted((tuple(row) for row in substrings.op6(frame).collect()), key=str)
    assert found == sorted(plain(rows), key=str)
    return found


def test_table(spark):
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    rows = sorted(tuple(row) for row in documents.select("doc_id", "text").collect())
    found = check(documents.repartition(5), rows)
    assert sum(row[2] for row in found) > 50_000


def mixed(rng, count):
    """Texts that share passages of all lengths around the limit, at borders, inside themselves and with edits."""
    letters = "abcdefghijklmnopqrstuvwxyz é"
    passages = ["".join(rng.choice(letters) for _ in range(n)) for n in (60, 98, 99, 100, 101, 102, 130, 200, 350)]
    texts = []
    for _ in range(count):
        parts = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.5:
                parts.append(rng.choice(passages))
            elif kind < 0.7:
                edited = list(rng.choice(passages))
                edited[rng.randrange(len(edited))] = "#"
                parts.append("".join(edited))
            elif kind < 0.8:
                parts.append(rng.choice("ab") * rng.randint(50, 260))
            elif kind < 0.9:
                parts.append("xy" * rng.randint(20, 120))
            else:
                parts.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 150))))
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("group", [0, 3, 12, 1000])
def test_mixed_texts(documents, monkeypatch, group):
    rng = random.Random(7 + group)
    rows = list(enumerate(mixed(rng, 120)))
    monkeypatch.setattr(substrings, "GROUP", group)
    monkeypatch.setattr(substrings, "BATCH_BYTES", 3000)
    monkeypatch.setattr(substrings, "RANGE_BYTES", 9000)
    check(documents(rng.sample(rows, len(rows))).repartition(4), rows)


def test_long_text_in_pieces(documents, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(substrings, "PIECE", 500)
    rows = list(enumerate(["".join(mixed(rng, 12)) for _ in range(6)]))
    check(documents(rows), rows)


def test_odd_rows(documents):
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefgh ") for _ in range(150)) + "end of it"
    rows = [(None, line), (1, None), (2, ""), (3, "x" * 99), (4, line + "tail"), (2**62, "é" * 80)]
    frame = documents([*rows, (4, line + "tail")]).selectExpr("*", "1 as doc", "2 as tie", "3 as spans", "4 as start")
    found = sorted((tuple(row) for row in substrings.op6(frame).collect()), key=str)
    expected = plain(rows)
    assert found == sorted([*expected, expected[4]], key=str)
    assert substrings.op6(documents([])).count() == 0
    kept = {row.doc_id: row.text for row in substrings.deduplicated(frame).collect()}
    assert kept[None] == line and kept[4] == "tail"


def test_same_id_with_other_texts(documents):
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefgh ") for _ in range(140)) + "!"
    rows = substrings.op6(documents([(5, line + "a"), (5, line + "b")])).collect()
    assert sorted(row.n_removed for row in rows) == [0, 141]
