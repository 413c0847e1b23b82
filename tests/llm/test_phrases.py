import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidelog.llm import phrases
from tidelog.llm.common import saved, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest, top, share=100):
    """The result for (text, lang) rows, all phrases counted in one place."""
    counts, total = {}, Counter()
    for text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang or "und"] += len(words)
            own.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in found.items():
            for part in {p[i : i + k] for k in range(2, len(p)) for i in range(len(p) - k + 1)}:
                around[part] = max(around[part], a)
        listed = []
        for p, a in found.items():
            if 100 * around[p] < share * a or not around[p]:
                score, _, l, r = min((1000 * a * total[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                listed.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(listed)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def make(spark, pairs):
    return spark.createDataFrame(pairs, "text string, lang string")


def random_texts(rng, count):
    vocabulary = ["the", "of", "Ñu", "ñu", "été", "a\x85b", "x", "new", "york", "city"]
    weights = [9, 7, 1, 1, 2, 1, 3, 4, 4, 3]
    return [("".join(rng.choices(vocabulary, weights)[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None])) for _ in range(count)]


@pytest.mark.parametrize("shard_bytes, range_grams", [(1 << 20, 1 << 20), (600, 40)])
def test_random_texts(spark, shard_bytes, range_grams):
    texts = random_texts(random.Random(4), 150)
    found = phrases.collocations(make(spark, texts).repartition(4), least=8, longest=4, top=40, shard_bytes=shard_bytes, range_grams=range_grams)
    expected = brute(texts, 8, 4, 40)
    assert len(expected) > 60
    assert rows(found) == expected


def test_share(spark):
    texts = random_texts(random.Random(6), 80)
    found = phrases.collocations(make(spark, texts), least=5, top=1000, share=60)
    assert rows(found) == brute(texts, 5, 5, 1000, 60)


def test_table(spark):
    documents = table(spark, "/root/testdata/sf0.001", "documents")
    texts = [(r.text, r.lang) for r in documents.select("text", "lang").collect()]
    assert rows(phrases.collocations(documents, least=20, range_grams=20_000)) == brute(texts, 20, 5, 2000)


def test_sql_on_a_table_with_candidates(spark):
    connection = duckdb.connect()
    connection.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    documents = table(spark, "/root/testdata/sf0.001", "documents")
    assert rows(phrases.collocations(documents)) == sorted(connection.execute(phrases.OP13_SQL).fetchall())


def test_nulls_repeats_and_hot_phrases(spark):
    texts = [(None, None), ("", "en"), ("...", "en"), ("One two", None)] + [("New York City New", "en")] * 300 + [("y " * 20_000 + "end", "de")]
    frame = make(spark, texts).selectExpr("*", "1 as words", "2 as n", "3 as shard", "4 as ids")
    found = phrases.collocations(frame, least=100, shard_bytes=3000, range_grams=50)
    assert rows(found) == brute(texts, 100, 5, 2000)
    assert "new york city new" in [r.phrase for r in found.collect()]


def test_nothing(spark):
    assert phrases.collocations(make(spark, [])).count() == 0
    assert phrases.collocations(make(spark, [("a b. c", "en"), (None, None)])).count() == 0


def test_exact_beyond_64_bits(spark):
    frame = spark.sql("select cast(9e12 as bigint) as a, cast(9e12 as bigint) as n, cast(9000000000007 as bigint) as l, cast(9000000000011 as bigint) as r")
    score = "(cast(1000 as decimal(4,0)) * (cast(a as decimal(18,0)) * cast(n as decimal(18,0)))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    row = frame.selectExpr("*", f"{score} as score").first()
    assert row.score == 1000 * row.a * row.n // (row.l * row.r)


def test_long_texts_are_cut_between_pieces():
    text = ". ".join(f"w{i} x y" for i in range(1000))
    parts = list(phrases.cut_texts(text, 500))
    assert len(parts) > 10
    assert phrases.END.join(parts) == text.encode().translate(phrases.BYTES)
    assert list(phrases.cut_texts("no sign " * 500, 100)) == [("no sign " * 500).encode()]
    assert list(phrases.cut_texts(None, 100)) == [b""]


def test_transducers():
    rng = np.random.default_rng(2)
    tokens = [rng.integers(0, 6, 400) for _ in range(3)]
    links = [np.append((t[:-1] > 0) & (t[1:] > 0) & (t[:-1] != t[1:]), False) for t in tokens]
    grams = [phrases.sorted_grams(t, own, 2, 4) for t, own in zip(tokens, links, strict=True)]
    parts = [phrases.Transducer.unpacked(phrases.Transducer.build(g, c).packed()) for g, c, _, _ in grams]
    whole, _ = phrases.Transducer.united(parts)
    expected = Counter()
    for t, own in zip(tokens, links, strict=True):
        for i in range(len(t)):
            for k in range(1, 5):
                if own[i] and own[i : i + k - 1].all():
                    expected[tuple(t[i : i + k].tolist())] += 1
    found = {tuple(p): c for layer, counts in enumerate(whole.counts()) for p, c in zip(whole.phrases(layer, np.arange(len(counts))).tolist(), counts.tolist(), strict=True)}
    assert found == dict(expected)
    for t, (g, _, start, which) in zip(tokens, grams, strict=True):
        for at, row in zip(start.tolist(), g[which].tolist(), strict=True):
            row = [x for x in row if x]
            assert row == t[at : at + len(row)].tolist()


def test_packed_numbers():
    for values in ([], [0], [255, 256, 0], [2**40 + 3, 7], list(range(70_000))):
        assert phrases.numbers(phrases.planes(np.array(values, np.int64))).tolist() == values


def test_no_range_holds_a_rare_language(spark):
    # 100 shards of few words and three, whose words sort behind, of nearly all pairs.
    rng = np.random.default_rng(5)
    ids = {f"often-{i}": rng.integers(1, 30, 200) for i in range(100)} | {f"seldom-{i}": rng.integers(1000, 9000, 20_000) for i in range(3)}
    coded = spark.createDataFrame([(shard, bytearray(phrases.planes(own))) for shard, own in ids.items()], "shard string, ids binary")
    pairs = phrases.frequent_pairs(coded, sum(map(len, ids.values())), 100, 4000).where("ids is null")
    assert pairs.groupBy("range").agg({"pairs": "sum"}).toDF("range", "n").selectExpr("max(n)").first()[0] < 8000


def test_what_grows_is_not_broadcast(spark, monkeypatch):
    # Tables this small are broadcast by every join that is left to Spark.
    plans = []

    def seen(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return frame

    monkeypatch.setattr(phrases, "saved", lambda frame, *rest: saved(seen(frame), *rest))
    texts = [("New York City New", "en")] * 30 + [("one two three one two", "fr")] * 30
    found = seen(phrases.collocations(make(spark, texts), least=20))
    joins = re.findall(r"(\w+Join) \[(\w+)#", "".join(plans))
    assert {key for kind, key in joins if kind != "SortMergeJoin"} <= {"lang"}
    assert sorted(key for kind, key in joins if kind == "SortMergeJoin" and key != "lang") == ["first_id", "head", "id", "ids", "ids", "shard", "shard", "tail"]
    assert rows(found) == brute(texts, 20, 5, 2000)
