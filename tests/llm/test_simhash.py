import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from llm_fixtures import documents  # noqa: F401

from tidelog.llm import simhash
from tidelog.llm.common import connected_classes, table


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, radius):
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    distinct = sorted(set(prints))
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {p: root(p) for p in distinct}


def unsigned(value):
    return value & (1 << 64) - 1


def test_fingerprints_of_the_table(spark):
    documents = table(spark, "/root/testdata/sf0.001", "documents")
    texts = dict(documents.select("doc_id", "text").collect())
    found = {row.doc_id: row.fp for row in simhash.fingerprints(documents).collect()}
    assert {k: unsigned(v) for k, v in found.items()} == {k: plain_fingerprint(t) for k, t in texts.items()}


def test_components_of_the_table(spark):
    documents = table(spark, "/root/testdata/sf0.001", "documents")
    rows = simhash.op5(documents).collect()
    prints = {row.doc_id: int(row.fingerprint, 16) for row in rows}
    classes = plain_classes(prints.values(), 4)
    first = {}
    for key, value in sorted(prints.items()):
        first.setdefault(classes[value], key)
    assert {row.doc_id: row.component_id for row in rows} == {k: first[classes[v]] for k, v in prints.items()}
    assert len({row.component_id for row in rows}) < len(rows)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = np.repeat(base, 8)
    for _ in range(5):
        prints ^= np.where(rng.random(320) < 0.6, np.uint64(1) << rng.integers(0, 64, 320, dtype=np.uint64), np.uint64(0))
    groups = np.sort(rng.integers(0, 9, 320))
    a, b = simhash.linked_in_groups(groups, prints, radius)
    expected = {}
    for g in set(groups.tolist()):
        at = np.flatnonzero(groups == g)
        classes = plain_classes([int(p) for p in prints[at]], radius)
        expected |= {int(i): (g, classes[int(prints[i])]) for i in at}
    parent = list(range(320))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        parent[root(i)] = root(j)
    found = [root(i) for i in range(320)]
    for i in range(320):
        for j in range(i):
            assert (found[i] == found[j]) == (expected[i] == expected[j])


def test_crowded_bucket_in_tiles(spark):
    rng = random.Random(3)
    center = rng.getrandbits(64)
    prints = [center]
    for _ in range(150):
        value = rng.choice(prints)
        for _ in range(rng.randint(1, 5)):
            value ^= 1 << rng.randrange(64)
        prints.append(value)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    for tile in (7, 1024):
        roots = dict(connected_classes(simhash.links(frame, tile=tile), "t").collect())
        classes = plain_classes(prints, 4)
        pairs = {(classes[unsigned(p)], roots.get(p, p)) for p in signed}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_connected_classes(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150), (150, 300)]
    found = dict(connected_classes(spark.createDataFrame(links, "a long, b long"), "t").collect())
    expected = {i: 0 for i in range(41)} | {100: 100, 101: 100, 150: 150, 200: 150, 300: 150}
    assert found == expected
    assert connected_classes(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_odd_rows(documents):
    long = "word " * 30_000
    frame = documents([(1, None), (2, ""), (3, " \n\t"), (None, "a b c d e"), (4, long), (5, long), (5, long), (6, "x")])
    frame = frame.withColumn("fp", F.lit("clash")).withColumn("bucket", F.lit(1)).withColumn("component_id", F.lit("y"))
    found = [(row.doc_id, row.fingerprint, row.component_id) for row in simhash.op5(frame).collect()]
    assert len(found) == 8
    kept = {key: component for key, _, component in found if key}
    assert kept == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert [c for k, _, c in found if k is None] == [None]
    assert simhash.op5(documents([])).count() == 0


def test_representatives(documents):
    first, second = "alpha beta gamma delta one", "totally other words stand here now"
    rows = [(1, first), (1, second), (2, first), (2, None), (3, ""), (None, second), (None, "q"), (None, "q"), (9, "q r s"), (9, "q r s"), (4, "q r s")]
    frame = documents(rows).selectExpr("*", "1 as kept_id", "2 as key", "3 as row", "4 as fp", "5 as first")
    stay = simhash.keep_representatives(frame)
    assert stay.columns == frame.columns
    found = sorted((str(row.doc_id), row.text) for row in stay.collect())
    assert found == sorted([("1", first), ("1", second), ("2", None), ("None", "q"), ("4", "q r s")], key=lambda row: (row[0], str(row[1])))
    assert simhash.keep_representatives(documents([])).count() == 0
