import base64
import hashlib
import random

import duckdb

from tidelog.llm import warc
from tidelog.llm.common import table

PAGES = "page_id long, url string, html string"


def plain_records(data):
    """Records of one archive, read one after the other."""
    at, found = 0, []
    while at < len(data):
        assert data.startswith(b"WARC/1.1\r\n", at)
        end = data.index(b"\r\n\r\n", at) + 4
        fields = dict(line.split(b": ", 1) for line in data[at:end].split(b"\r\n")[1:] if line)
        stop = end + int(fields[b"Content-Length"])
        found.append((at, fields, data[end:stop]))
        assert data[stop : stop + 4] == b"\r\n\r\n"
        at = stop + 4
    return found


def by_sql(rows):
    connection = duckdb.connect()
    connection.execute("create table pages (page_id bigint, url varchar, html varchar)")
    if rows:
        connection.executemany("insert into pages values (?, ?, ?)", rows)
    return sorted(connection.execute(warc.OP4_SQL).fetchall(), key=str)


def by_spark(frame):
    return sorted((tuple(row) for row in warc.op4(frame).collect()), key=str)


def test_table(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    rows = [tuple(row) for row in pages.select("page_id", "url", "html").collect()]
    assert by_spark(pages) == by_sql(rows)


def fake(rng, depth=0):
    """A payload with version lines and whole records in it."""
    inner = "".join(rng.choice("ab é\r\n") for _ in range(rng.randint(0, 40)))
    if depth < 3 and rng.random() < 0.7:
        body = fake(rng, depth + 1)
        inner += f"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: {len(body.encode()) + rng.choice((0, 0, 3))}\r\n\r\n{body}\r\n\r\n"
    return inner + rng.choice(("", "WARC/1.1\r\n", "WARC/1.1\r\n\r\n", "\r\n\r\n"))


def test_version_lines_inside_payloads(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"http://x/{i}", fake(rng)) for i in range(60)]
    frame = spark.createDataFrame(rows, PAGES).repartition(2)
    # Parts of a few hundred bytes: records, heads and version lines are cut anywhere.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert by_spark(frame) == by_sql(rows)
        warc.write(frame, str(tmp_path / "a"))
        real = {}
        for file in (tmp_path / "a").glob("part-*"):
            for at, _, block in plain_records(file.read_bytes()):
                payload = block.split(b"\r\n\r\n", 1)[1]
                real[file.name, at] = (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        found = {(row.file.rsplit("/", 1)[1], row.start): (row.payload_bytes, row.digest) for row in warc.records(spark, str(tmp_path / "a")).collect()}
        assert found == real
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "http://a\r\nX: y", ""), (None, "u", "same"), (5, "é", "same"), (7, "u", "same"), (7, "u", "same"), (None, "u", "alone"), (9, "u", "x" * 300_000), (9, "u", "y\x00")]
    frame = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as digest", "2 as bytes", "3 as refers_to", "4 as first")
    assert by_spark(frame) == by_sql(rows)
    assert by_spark(spark.createDataFrame([], PAGES)) == []


def test_smallest_shared_payload(spark):
    frame = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], PAGES)
    assert {row.page_id: row.refers_to for row in warc.deduplicated(frame, 3).collect()} == {1: None, 2: None, 3: None, 4: 3}
