"""Readers, manifest and detection on generated edge-case files."""

import datetime
import json
import os

import pytest
from conftest import write_files
from pyspark.sql import functions as F

from tidelog.operators import chunking as C
from tidelog.sources import files as S


def names(rows, *fields):
    return sorted((os.path.basename(row[0]), *row[1:]) for row in rows.select(*fields).collect())


LINES = {
    "crlf.log": b"one\r\ntwo\rthree\n\nfive",
    "closed.log": b"x\ny\n",
    "blank.log": b"\n\n\r\n",
    "cr_end.log": b"q\r",
    "cr_cr.log": b"a\r\r\nb",
    "empty.log": b"",
    "long.log": "\n".join(f"line {n} é漢" for n in range(400)).encode(),
}


@pytest.mark.parametrize("split", ["300", "134217728"])
def test_lines_match_universal_newlines(spark, tmp_path, split):
    folder = write_files(tmp_path, LINES)
    expected = []
    for name in LINES:
        with open(tmp_path / name, encoding="utf-8") as handle:
            expected += [(name, n, line.rstrip("\n"), len(line.encode())) for n, line in enumerate(handle, 1)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        lines = S.scan_lines(spark, folder)
        assert names(lines, "file", "line_no", "line", "n_bytes") == sorted(expected)
        spans = C.chunk_spans(lines, 100)
        assert spans.agg(F.sum("line_count")).first()[0] == len(expected)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")


FORMATS = {
    "a.JSONL": "x",
    "b.json": "x",
    "c.log": "[1]",
    "bracket.txt": "[2024-01-01 00:00:00] ERROR x\n",
    "array.txt": '\n [{"a": 1}]',
    "lines.txt": '{"a":1}\n\n{"b":2}\nnot json\n',
    "one.txt": '{"a":1}\n',
    "numbers.txt": "1\n2\n3\n",
    "longline.txt": "\n".join(json.dumps({"a": "y" * 890}) for _ in range(2)),
    "bad.txt": b'{"a":1}\n{"b":2}\n\xff\xfe\n',
}


@pytest.mark.parametrize(
    "compat, expected",
    [
        (True, {"bracket.txt": "json", "array.txt": "json", "numbers.txt": "jsonl", "longline.txt": "plain_text"}),
        (False, {"bracket.txt": "plain_text", "array.txt": "json", "numbers.txt": "plain_text", "longline.txt": "jsonl"}),
    ],
)
def test_detection(spark, tmp_path, compat, expected):
    folder = write_files(tmp_path, FORMATS)
    found = dict(names(S.detect_formats(spark, folder, compat), "path", "file_type"))
    common = {
        "a.JSONL": "jsonl", "b.json": "json", "c.log": "plain_text", "lines.txt": "jsonl", "one.txt": "plain_text",
        "bad.txt": "plain_text",
    }
    assert found == {**common, **expected}


def test_files_that_are_left_out_have_a_reason(spark, tmp_path):
    write_files(tmp_path, {"a.log": "x\n", "b.LOG": "x\n", "app.out": "x\n", "c.json": "{}" * 50})
    rows = {row.original_name: row.reject_reason for row in S.refused_files(spark, str(tmp_path), 50).collect()}
    assert rows == {"app.out": "extension not accepted", "c.json": "file too large"}


def test_invalid_utf8_is_quarantined(spark, tmp_path):
    folder = write_files(tmp_path, {"bad.log": b"fine\n\xff\xfe\n"})
    good, bad = S.valid_text(S.scan_lines(spark, folder))
    assert [row.line for row in good.collect()] == ["fine"]
    assert bad.select("line_no", "reject_reason").first() == (2, "invalid UTF-8")


def test_json_files(spark, tmp_path):
    files = {
        "one.json": '{"a":1}',
        "mixed.json": '[{"a":1.0,"a":2},"s",7,null,[1]]',
        "bad.json": '[{"a":1},',
        "tail.json": '{"a":1} {"b":2}',
        "empty.json": "[]",
    }
    rows = S.scan_json_files(spark, write_files(tmp_path, files), dumped=True)
    found = names(rows, "file", "pos", "dumped", "problem")
    assert found == [
        ("bad.json", None, None, "Invalid JSON file"),
        ("mixed.json", 0, '{"a": 2}', None),
        ("mixed.json", 1, '"s"', None),
        ("mixed.json", 2, "7", None),
        ("mixed.json", 3, "null", None),
        ("mixed.json", 4, "[1]", None),
        ("one.json", 0, '{"a": 1}', None),
        ("tail.json", None, None, "Invalid JSON file"),
    ]


def test_json_chunks_follow_the_dumped_size(spark, tmp_path):
    data = [{"n": n, "text": "é" * (n % 7)} for n in range(50)]
    folder = write_files(tmp_path, {"data.json": json.dumps(data)})
    for limit in (60, 300, 10_000):
        per_chunk = max(1, len(data) * limit // len(json.dumps(data).encode()))
        slices = [data[n : n + per_chunk] for n in range(0, len(data), per_chunk)]
        chunks = C.json_chunk_metadata(C.chunk_json_items(S.scan_json_files(spark, folder, dumped=True), limit))
        found = [(r.chunk_id, r.size_bytes, r.line_count) for r in chunks.orderBy("chunk_id").collect()]
        assert found == [(n, len(json.dumps(part).encode()), len(part)) for n, part in enumerate(slices)]


def test_manifest_and_admission(spark, tmp_path):
    folder = write_files(tmp_path, {"a.log": "12345", "b.txt": "1", "c.csv": "no"})
    files = S.list_directory(spark, folder)
    rows = {row.original_name: row for row in S.manifest(files).collect()}
    assert set(rows) == {"a.log", "b.txt"}
    assert rows["a.log"].size_bytes == 5 and rows["a.log"].status == "uploaded"
    assert {r.original_name for r in S.quarantined(files, max_bytes=4).collect()} == {"a.log"}
    assert S.admitted(files, max_bytes=5).count() == 2
    table = S.manifest(files)
    assert S.file_info(table, rows["b.txt"].file_id)["original_name"] == "b.txt"
    with pytest.raises(KeyError):
        S.file_info(table, "nothing")


def test_empty_files_have_no_chunks(spark, tmp_path):
    folder = write_files(tmp_path, {"full.log": "a\n", "empty.log": ""})
    files = S.list_directory(spark, folder, include_empty=True)
    assert names(files, "path", "size_bytes") == [("empty.log", 0), ("full.log", 2)]
    assert S.list_directory(spark, folder).count() == 1
    spans = C.chunk_spans(S.scan_lines(spark, folder), 100)
    by_name = files.select(F.col("original_name").alias("file"))
    spans = spans.withColumn("file", F.element_at(F.split("file", "/"), -1))
    assert [r.file for r in C.without_chunks(by_name, spans).collect()] == ["empty.log"]


def test_repeated_upload_keeps_the_last(spark):
    when = datetime.datetime(2024, 1, 1, 10, 0, 0)
    rows = [("p1", "a.log", 1, when), ("p2", "a.log", 2, when + datetime.timedelta(milliseconds=5)), ("p3", "b.log", 3, when)]
    files = spark.createDataFrame(rows, "path string, original_name string, size_bytes long, upload_time timestamp")
    plain = S.manifest(files, unique_ids=False)
    assert {(r.path, r.file_id) for r in S.last_upload_wins(plain).collect()} == {
        ("p2", "20240101_100000_a.log"), ("p3", "20240101_100000_b.log"),
    }
    assert S.last_upload_wins(S.manifest(files)).count() == 3
    assert S.latest_file(plain).first().path == "p2"


def test_large_json_array_keeps_every_element(spark, tmp_path):
    count = 60_000
    with open(tmp_path / "big.json", "w") as handle:
        handle.write("[" + ",".join('{"n":%d,"pad":"%s"}' % (n, "x" * 500) for n in range(count)) + "]")
    assert S.scan_json_files(spark, str(tmp_path)).filter("doc is not null").count() == count
