import random
import re
from collections import Counter

import numpy as np
from llm_fixtures import documents  # noqa: F401

from tidelog.llm import quality
from tidelog.llm.common import table

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    counts = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
    return counts, counts[0] < 20 or 100 * counts[4] > 30 * counts[0]


def held(row):
    return tuple(row[c] for c in quality.COUNTS), row.base_failed


def test_counts_on_random_texts(documents):
    rng = random.Random(2)
    texts = [None, "", " \n ", "\n\n\n", "x"]
    texts += ["".join(rng.choice("ab#é|\n   \t\x0b\x1c\xa0") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    texts += [" ".join(rng.choice("pqr") for _ in range(rng.randint(7, 90))) for _ in range(200)]
    texts += ["same line here\n" * 40, "w " * 30_000]
    rows = quality.with_features(documents(list(enumerate(texts)))).collect()
    assert {row.doc_id: held(row) for row in rows} == {i: plain_counts(t) for i, t in enumerate(texts)}


def test_table(spark):
    documents, labels = (table(spark, "/root/testdata/sf0.01", name) for name in ("documents", "labels"))
    texts = dict(documents.select("doc_id", "text").collect())
    rows = {row.doc_id: row for row in quality.op2(documents, labels).collect()}
    assert {key: held(row) for key, row in rows.items()} == {key: plain_counts(t) for key, t in texts.items()}
    marks = [(row.quality, rows[row.doc_id]) for row in labels.collect() if row.doc_id in rows]
    good = [row.kept for mark, row in marks if mark == 1 and not row.base_failed]
    poor = [row.kept for mark, row in marks if mark == 0]
    assert np.mean(good) > 0.97
    assert np.mean(poor) < 0.35
    assert all(row.kept == (not row.base_failed and row.rule is None) for row in rows.values())


def test_held_out_accuracy(spark):
    """Rules learned from three quarters of the labels judge the rest."""
    documents, labels = (table(spark, "/root/testdata/sf0.1", name) for name in ("documents", "labels"))
    found = quality.labelled(documents, labels).collect()
    names = list(quality.ratios())
    values = {n: np.array([row[n] for row in found]) for n in names}
    low = np.array([row.low for row in found])
    draw = np.array([row.draw for row in found])
    seen = draw % 4 != 0
    rules = quality.learn({n: v[seen] for n, v in values.items()}, low[seen], draw[seen] % 3 != 0)
    assert 1 <= len(rules) <= quality.MAX_RULES
    rejected = np.any([np.all([c.holds(values) for c in rule], axis=0) for rule in rules], axis=0)[~seen]
    truth = low[~seen]
    assert (rejected & ~truth).sum() <= 0.02 * (~truth).sum()
    assert (rejected & truth).sum() >= 0.6 * truth.sum()


def test_learning_is_exact_on_a_plain_case():
    rng = np.random.default_rng(1)
    a, b = rng.random(900), rng.random(900)
    low = (a > 0.7) & (b <= 0.5)
    rules = quality.learn({"words": a, "mean_word": b}, low, np.arange(900) % 3 != 0)
    met = np.any([np.all([c.holds({"words": a, "mean_word": b}) for c in rule], axis=0) for rule in rules], axis=0)
    assert (met == low).mean() > 0.97
    assert quality.learn({"words": a}, np.zeros(900, bool), np.arange(900) % 3 != 0) == []
    assert quality.learn({"words": a[:0]}, low[:0], low[:0]) == []


def test_odd_tables(spark, documents):
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (None, 0, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    text = " ".join(f"word{i}" for i in range(25))
    frame = documents([(1, text), (1, text), (None, text), (2, None), (3, "short")]).selectExpr("*", "7 as n_words", "8 as features", "9 as kept", "'c' as rule", "1 as whole")
    rows = quality.op2(frame, labels).collect()
    assert sorted((str(r.doc_id), r.n_words, r.kept) for r in rows) == [("1", 25, True), ("1", 25, True), ("2", 0, False), ("3", 1, False), ("None", 25, True)]
    stay = quality.kept_documents(frame, labels)
    assert stay.columns == frame.columns
    assert sorted(str(r.doc_id) for r in stay.collect()) == ["1", "1", "None"]
    assert quality.op2(documents([]), labels.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    documents, labels = (table(spark, "/root/testdata/sf0.001", name) for name in ("documents", "labels"))
    plan = quality.op2(documents, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
