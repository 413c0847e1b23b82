"""Column rules against plain Python."""

import hashlib
import json
import sys

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import fields as R
from tidelog.functions import json_values as J
from tidelog.functions import text as X
from tidelog.functions.hashing import log_hash
from tidelog.operators import parse as P
from tidelog.schema import HASH_FIELDS


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n long, v {kind}")
    return [r.x for r in rows.select("n", expression(F.col("v")).alias("x")).orderBy("n").collect()]


def test_strip_removes_every_whitespace_character(spark):
    blanks = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    values = [f"{b}a{b} é{b}{b}" for b in blanks] + ["", " ", "​x", "plain"]
    assert column(spark, values, X.strip) == [v.strip() for v in values]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(*[st.one_of(st.none(), st.text(max_size=8))] * 4), min_size=1, max_size=20))
def test_log_hash_equals_hashlib(spark, rows):
    rows = [tuple(None if v is None else v.encode("utf-8", "ignore").decode() for v in row) for row in rows]
    frame = spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], "n long, " + ", ".join(f"{f} string" for f in HASH_FIELDS))
    found = [r.h for r in frame.select("n", log_hash().alias("h")).orderBy("n").collect()]
    assert found == [hashlib.md5("|".join(str(v) for v in row).encode()).hexdigest() for row in rows]


def test_json_hash_tells_missing_from_null(spark):
    records = [
        {"timestamp": "t", "level": "INFO", "message": "m"},
        {"timestamp": "t", "level": "INFO", "message": "m", "service": None},
        {"timestamp": "t", "level": "INFO", "message": "m", "service": "None"},
        {"timestamp": "t", "level": "INFO", "message": "m", "service": ""},
        {"timestamp": 17, "level": True, "message": 1.5, "service": "a|b"},
        {"timestamp": 1.0, "level": False, "message": "é😀", "service": "s", "user_id": 4},
    ]
    expected = [
        hashlib.md5("|".join(str(r.get(f, "")) for f in HASH_FIELDS).encode()).hexdigest() for r in records
    ]
    texts = [json.dumps(r) for r in records]
    assert column(spark, texts, lambda v: J.json_hash(v, J.parse_json(v))) == expected
    assert len(set(expected)) == 4


VALUES = ["null", '""', "0", "0.0", "-0", "false", "[]", "{}", '"x"', '" "', '"0"', '"[]"', '"{}"', "1e-9", "true", "[0]", '{"a":0}']


def test_truthiness(spark):
    texts = [f'{{"m":{v}}}' for v in VALUES] + ["{}", "7", "[1]"]
    expected = [bool(json.loads(v)) for v in VALUES] + [False, False, False]
    assert column(spark, texts, lambda v: J.truthy(J.field(J.parse_json(v), "m"))) == expected


@pytest.mark.parametrize(
    "text, fine",
    [
        ('{"a":1}', True), (' {"a":1} ', True), ('{"a":1} x', False), ('{"a":1} {}', False), ("{'a':1}", False),
        ('{"a":1}] junk', False), ("1] x", False), ("1],[2", False), ('1}, "b":{"c":1}', False), ('["]"]', True), ('{"a":"]"}', True), ('{"a":[1]} ', True),
        ('{"a":1,}', False), ("[1,2]", True), ("", False), ("1,2", False), ("01", False), ('{"a":1,"a":2}', True),
    ],
)
def test_json_is_strict(spark, text, fine):
    assert column(spark, [text], lambda v: J.parse_json(v).isNotNull())[0] is fine


def entry(**fields):
    return {"timestamp": "t", "level": "INFO", "message": "m", **fields}


def test_answers_become_entries(spark):
    answers = [
        ("```json\n" + json.dumps([entry(), entry(level="warn"), entry(level="WARNING"), "x", 3]) + "\n```", 2),
        (json.dumps(entry(service=None)), 1),
        ("  " + json.dumps([entry(level=40), entry(level=" INFO "), entry(message=[]), entry(level="trace")]), 1),
        ("```\n[]\n```", 0),
        ("no json", 0),
        ('[{"timestamp":"t","level":"INFO","message":"cut', 0),
    ]
    frame = spark.createDataFrame([(n, text) for n, (text, _) in enumerate(answers)], "n long, response string")
    from tidelog.operators.validate import valid_entries

    counts = {r.n: r["count"] for r in valid_entries(P.model_entries(frame)).groupBy("n").count().collect()}
    assert [counts.get(n, 0) for n in range(len(answers))] == [count for _, count in answers]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-03-01T10:00:00Z", "2024-03-01T10:00:00.000000Z"),
        ("2024-03-01T10:00:00.25+02:00", "2024-03-01T08:00:00.250000Z"),
        ("2024-03-01 10:00:00,123", "2024-03-01T10:00:00.123000Z"),
        ("2024-03-01 10:00:00 -0530", "2024-03-01T15:30:00.000000Z"),
        ("2024-03-01 10:00", "2024-03-01T10:00:00.000000Z"),
        ("01/Mar/2024:10:00:00 +0100", "2024-03-01T09:00:00.000000Z"),
        ("1709287200", "2024-03-01T10:00:00.000000Z"),
        ("1709287200123", "2024-03-01T10:00:00.123000Z"),
        ("1709287200.5", "2024-03-01T10:00:00.500000Z"),
        ("2024-03-01", "2024-03-01T00:00:00.000000Z"),
        ("Mar  1 10:00:00", "2024-03-01T10:00:00.000000Z"),
        ("2024-01-01T00:00:00.123456Z", "2024-01-01T00:00:00.123456Z"),
        ("2024-01-01 00:00:00,1234567+01:00", "2023-12-31T23:00:00.123456700Z"),
        ("2024-01-01T00:00:00.123456789 Z", "2024-01-01T00:00:00.123456789Z"),
        ("2024-01-01T00:00:00.123456000Z", "2024-01-01T00:00:00.123456Z"),
        ("1709287200.000001", "2024-03-01T10:00:00.000001Z"),
        ("2024-13-01", None), ("yesterday", None), ("", None), ("12:30", None), ("2024", None),
    ],
)
def test_timestamps(spark, text, expected):
    assert column(spark, [text], lambda v: R.normalize_timestamp(v, default_year=2024)) == [expected]


def test_levels_and_sizes(spark):
    assert column(spark, ["warning", " Err ", "NOTICE", "crit", "info", "odd", "", None], R.normalize_level) == [
        "WARN", "ERROR", "INFO", "FATAL", "INFO", "ODD", None, None,
    ]
    sizes = [0, 1, 500, 1023, 1024, 1536, 100 * 1024**2, 1024**3, 1024**4, 5 * 1024**4]
    assert column(spark, sizes, X.format_bytes, "long") == [
        "0 Bytes", "1 Bytes", "500 Bytes", "1023 Bytes", "1 KB", "1.5 KB", "100 MB", "1 GB", "1 TB", "5 TB",
    ]


def test_addresses(spark):
    values = ["from 10.0.0.1.", "1.2.3.4.5", "999.1.1.1", "x10.0.0.7:80", "v1.2.3", "10.0.0.256 192.168.1.1"]
    assert column(spark, values, R.source_ip) == ["10.0.0.1", None, None, "10.0.0.7", None, "192.168.1.1"]
