"""The pipeline against its stages' definitions, one after the other."""

import duckdb
import public_tokenizers
import pytest
from test_decontam import plain_leaks
from test_simhash import plain_classes, plain_fingerprint
from tokenizers import Tokenizer
from llm_fixtures import documents  # noqa: F401

import __spark_entry__ as contract
import corpus_pipeline
from tidelog.llm import pii, quality
from tidelog.llm.common import saved, table

DIRECTORY = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage: (name, columns, {doc_id: row})."""
    docs = table(spark, DIRECTORY, "documents")
    out = [("documents", docs.columns, {row.doc_id: row for row in docs.collect()})]
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, DIRECTORY), name)
        rows = docs.collect()
        out.append((name, docs.columns, {row.doc_id: row for row in rows}))
        assert len(out[-1][2]) == len(rows)
    return out


def test_stages_keep_the_columns_of_documents(stages):
    first = stages[0][1]
    assert [name for name, _, _ in stages[1:]] == ["quality_rules", "simhash_near_dedup", "decontamination", "personal_data", "token_ids"]
    assert all(columns == first for _, columns, _ in stages[:-1])
    assert stages[-1][1] == ["doc_id", "n_tokens", "ids"]


def test_quality_rules(spark, stages):
    docs, labels = table(spark, DIRECTORY, "documents"), table(spark, DIRECTORY, "labels")
    kept = {row.doc_id for row in quality.op2(docs, labels).where("kept").collect()}
    assert set(stages[1][2]) == kept
    good = {row.doc_id for row in labels.where("quality = 1").collect()} & set(stages[0][2])
    assert len(good & kept) > 0.9 * len(good)


def test_near_dedup_leaves_one_of_each_class(stages):
    before, after = stages[1][2], stages[2][2]
    prints = {key: plain_fingerprint(row.text) for key, row in before.items()}
    classes = plain_classes(prints.values(), 4)
    first = {}
    for key in sorted(prints):
        first.setdefault(classes[prints[key]], key)
    assert set(after) == set(first.values())
    assert len(after) < len(before)


def test_decontamination(stages):
    items = duckdb.connect().execute(f"select item_id, text from '{DIRECTORY}/benchmark.parquet'").fetchall()
    before, after = stages[2][2], stages[3][2]
    leaked = {key for key, _ in plain_leaks([(key, row.text) for key, row in before.items()], items)}
    assert leaked and set(after) == set(before) - leaked


def test_personal_data_and_token_ids(stages):
    before, after, ids = stages[3][2], stages[4][2], stages[5][2]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(before) == set(after) == set(ids)
    changed = 0
    for key, row in after.items():
        assert row.text == pii.redacted(before[key].text) and row.n_chars == len(row.text)
        assert not any(pii.spans_of(row.text)[0].values())
        assert (row.lang, row.source) == (before[key].lang, before[key].source)
        changed += row.text != before[key].text
        assert ids[key].ids == library.encode(row.text, add_special_tokens=False).ids
        assert ids[key].n_tokens == len(ids[key].ids)
    assert changed


def test_run_is_registered(spark, stages):
    rows = contract.queries()["pipeline"](spark, DIRECTORY).collect()
    assert {row.doc_id: row.ids for row in rows} == {key: row.ids for key, row in stages[-1][2].items()}
    names = contract.queries()
    assert {name.split("_")[0] for name in names if name.startswith("op")} >= {f"op{n}" for n in range(1, 11)}


def test_empty_tables(spark, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIRECTORY)
        assert docs.count() == 0
