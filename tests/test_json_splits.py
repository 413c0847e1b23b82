"""JSON arrays read in splits and chunks against strict parsing of whole files."""

import json
import os
import random

import pytest
from conftest import write_files
from pyspark.sql import functions as F

from tidelog.operators import chunking as C
from tidelog.sources import files as S
from tidelog.sources import json_splits as J

SIGNS = ['"', "\\", "[", "]", "{", "}", ",", ":", " ", "\n", "é", "a", "\\\\", '\\"', "],[", " "]


def value(rng, depth=0):
    kind = rng.randint(0, 6 if depth < 3 else 3)
    if kind <= 1:
        return "".join(rng.choices(SIGNS, k=rng.randint(0, 8)))
    if kind == 2:
        return rng.choice([0, -1, 2.5, True, False, None, 10**15])
    if kind == 3:
        return {}
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {"".join(rng.choices(SIGNS, k=3)): value(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def strict(text):
    def refuse(_):
        raise ValueError

    try:
        data = json.loads(text, parse_constant=refuse)
    except ValueError:
        return None
    return data if isinstance(data, list) else [data]


def read(frame):
    """file -> list of elements, or None for a rejected file."""
    found = {}
    for file, pos, doc, problem in frame.select("file", "pos", F.to_json("doc"), "problem").collect():
        name = os.path.basename(file)
        if problem:
            assert name not in found and pos is None and problem == "Invalid JSON file"
            found[name] = None
        else:
            found.setdefault(name, {})[pos] = json.loads(doc)
    for name, items in found.items():
        if items is not None:
            assert sorted(items) == list(range(len(items))), name
            found[name] = [items[i] for i in range(len(items))]
    return found


EDGES = {
    "empty.json": "[]",
    "blank_array.json": " [ \n ] ",
    "blank.json": " \n ",
    "one.json": "[1]",
    "scalar.json": ' "a,b" ',
    "object.json": '{"a": [1, 2], "b": {"c": ","}}',
    "nested.json": "[[1, 2], [], [[3, 4], 5]]",
    "open.json": '[{"a":1},',
    "comma_behind.json": "[1, 2],",
    "comma_before.json": ",[1, 2]",
    "hole.json": "[1,, 2]",
    "last_hole.json": "[1, 2,]",
    "lone_comma.json": "[,]",
    "two.json": "[1] [2]",
    "two_joined.json": "[1],[2]",
    "crossed.json": "[{1, 2]}",
    "wrong_end.json": "[1, 2}",
    "wrong_start.json": "{1, 2]",
    "early_end.json": "[1], 2]",
    "depth.json": "[1}, {2]",
    "open_text.json": '["a, b]',
    "slashes.json": r'["\\", "\\\"," , "a\\\\", "\","]',
    "slash_comma.json": r'["a\, b"]',
    "behind.json": "[1, 2] x",
    "text_array.json": '"[1, 2]"',
    "deep.json": "[" * 50 + "1, 2" + "]" * 50,
    "wide.json": "[" + "x" * 10 + ", 1]",
}


@pytest.mark.parametrize("chunk_bytes", [1, 4 << 20])
def test_edges(spark, tmp_path, chunk_bytes):
    folder = write_files(tmp_path, EDGES)
    found = read(J.scan_json_splits(spark, folder, chunk_bytes=chunk_bytes))
    expected = {name: strict(text) for name, text in EDGES.items()}
    assert {n: found.get(n, []) for n in expected} == expected


@pytest.mark.parametrize("split, chunk_bytes", [("400", 30), ("134217728", 9)])
def test_random_files_in_many_splits(spark, tmp_path, split, chunk_bytes):
    rng = random.Random(chunk_bytes)
    files = {}
    for n in range(24):
        text = json.dumps([value(rng) for _ in range(rng.randint(0, 12))], ensure_ascii=n % 2 == 0, indent=rng.choice([None, None, 1]))
        if n % 3 == 0 and text:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", rng.choice(SIGNS)]) + text[at + 1 :]
        files[f"{n}.json"] = text
    folder = write_files(tmp_path, files)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = read(J.scan_json_splits(spark, folder, chunk_bytes=chunk_bytes))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    expected = {name: strict(text) for name, text in files.items()}
    assert sum(e is None for e in expected.values()) > 2
    assert {n: found.get(n, []) for n in expected} == expected


def test_same_rows_as_whole_files(spark, tmp_path):
    rng = random.Random(8)
    files = {f"{n}.json": json.dumps([value(rng) for _ in range(9)]) for n in range(10)} | {"bad.json": "[1,", "none.json": "[]", "nan.json": "[NaN, 1]"}
    folder = write_files(tmp_path, files)
    columns = ["file", "pos", "raw", "problem", "dumped", "n_items", "total_bytes"]
    whole = S.scan_json_files(spark, folder, dumped=True)
    parts = J.scan_json_splits(spark, folder, dumped=True, chunk_bytes=40)
    assert sorted(map(str, whole.select(columns).collect())) == sorted(map(str, parts.select(columns).collect()))
    chunks = [sorted(map(str, C.json_chunk_metadata(C.chunk_json_items(frame.where("problem is null"), 60)).collect())) for frame in (whole, parts)]
    assert chunks[0] == chunks[1]


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    items = [{"id": n, "text": "a, b [" * (n % 40)} for n in range(10_000)]
    folder = write_files(tmp_path, {"large.json": json.dumps(items)})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        chunks = J.json_chunks(spark, folder, "*.json", 32 << 10)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert chunks.select("block").distinct().count() > 8
    assert chunks.agg(F.max(F.octet_length("content"))).first()[0] < 48 << 10
    elements, bad = J.json_elements(chunks)
    assert bad.count() == 0
    rows = elements.orderBy("pos").collect()
    assert [json.loads(row.text) for row in rows] == items


def test_byte_order_mark_and_empty_file(spark, tmp_path):
    folder = write_files(tmp_path, {"mark.json": b"\xef\xbb\xbf[1, 2]", "mark_comma.json": b"\xef\xbb\xbf[1, 2],", "zero.json": b""})
    assert read(J.scan_json_splits(spark, folder)) == {"mark.json": [1, 2], "mark_comma.json": None}


@pytest.mark.parametrize("chunk_bytes", [1, 30, 4 << 20])
def test_parts_of_a_folder_are_one_text(spark, tmp_path, chunk_bytes):
    """Texts cut between characters, also behind commas and inside strings, but not inside escapes, equal the whole ones."""
    rng = random.Random(chunk_bytes)
    expected = {}
    for n in range(16):
        text = json.dumps([value(rng) for _ in range(rng.randint(0, 12))], ensure_ascii=n % 2 == 0)
        text = text[:-1] if n % 5 == 4 else text + "," if n % 5 == 3 else text
        cuts = sorted({0, len(text), *(rng.randrange(len(text)) for _ in range(4)), *([text.index(",") + 1] if "," in text else [])})
        cuts = [cut for cut in cuts if text[cut - 1 : cut] != "\\"]
        (tmp_path / str(n)).mkdir()
        write_files(tmp_path / str(n), {f"part-{i:05}.json": text[a:b] for i, (a, b) in enumerate(zip(cuts, cuts[1:]))})
        expected[str(n)] = strict(text)
    found = read(J.scan_json_splits(spark, str(tmp_path), chunk_bytes=chunk_bytes, folders=True))
    assert sum(e is None for e in expected.values()) > 2
    assert {n: found.get(n, []) for n in expected} == expected


def test_large_arrays_are_written_by_several_tasks(spark, tmp_path):
    from tidelog.plans.files_queries import write_json_arrays

    documents = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a,b "), F.lit(100)).alias("text"))
    write_json_arrays(documents, f"{tmp_path}/arrays", 2, part_bytes=2000)
    for bucket in ("0", "1"):
        assert len(list((tmp_path / "arrays" / f"bucket={bucket}").glob("*.txt"))) > 3
    found = read(J.scan_json_splits(spark, f"{tmp_path}/arrays", "*.txt", chunk_bytes=100, folders=True))
    assert [item["doc_id"] for item in found["bucket=0"]] == list(range(0, 40, 2))
    assert found["bucket=1"] is None
