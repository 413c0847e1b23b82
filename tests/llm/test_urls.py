import duckdb
import pytest

from tidelog.llm import urls
from tidelog.llm.common import table

PAGES = "page_id long, url string, html string"


def by_sql(rows):
    connection = duckdb.connect()
    connection.execute("create table pages (page_id bigint, url varchar, html varchar)")
    if rows:
        connection.executemany("insert into pages values (?, ?, ?)", rows)
    result = connection.execute(urls.OP7_SQL)
    names = [d[0] for d in result.description]
    return sorted((tuple(dict(zip(names, row, strict=True))[c] for c in ("page_id", "host", "path", "rule", "verdict", "matched")) for row in result.fetchall()), key=str)


def by_spark(frame):
    return sorted((tuple(row) for row in urls.op7(frame).collect()), key=str)


def test_table(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    rows = [tuple(row) for row in pages.select("page_id", "url", "html").collect()]
    found = by_spark(pages)
    assert found == by_sql(rows)
    assert {row[3] for row in found} == {None, "org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/"}
    assert len({row[4] for row in found if row[3] is None}) == 2


def test_odd_urls(spark):
    given = [None, "", "example.org/es/", "://", "http://", "http://EXAMPLE.ORG/es/", "http://a.example.org", "http://a.example.org/", "http://xexample.org/es/1"]
    given += ["http://example.org/en/1", "http://example.org/en/12?x#y", "http://example.org/EN/1", "http://b.com/fr/", "http://b.com?/fr/", "http://b.com#/de/", "http://com/de/"]
    given += ["http://x://casino.net/", "http://casino-win.example.net/x", "http://casinos.net/", "http://a.net/casino", "http://é.casino.net/\nx", "http://big.com/de/" + "a" * 50_000]
    given += ["http://spam.casino.net/", "http://spam.casino.net/", "HTTP://www.Spam.example.org/es/é"]
    rows = [(i if i % 7 else None, url, None) for i, url in enumerate(given)]
    frame = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as host", "2 as token", "3 as name")
    assert by_spark(frame) == by_sql(rows)
    assert by_spark(spark.createDataFrame([], PAGES)) == []


@pytest.mark.parametrize(
    ("pattern", "tokens"),
    [
        (r"^(?:[^/]*\.)?example\.org/en/1", ["en", "example", "org"]),
        (r"^[^/]*\bcasino\b", ["casino"]),
        (r"abc", []),
        (r"/abc/", ["abc"]),
        (r"/abc[0-9]", []),
        (r"/(?:a|b)/Page$", ["page"]),
        (r"[0-9]x/", []),
        (r"^www\.", ["www"]),
    ],
)
def test_literal_tokens(pattern, tokens):
    assert urls.literal_tokens(pattern) == tokens


def test_rules_sit_under_their_rarest_token(spark):
    pages = spark.createDataFrame([("http://a.com/x/rare",)] + [(f"http://b.com/x/{i}",) for i in range(9)], "url string")
    host, path = urls.host_and_path(pages["url"])
    places = pages.select("url", urls.F.concat(host, path).alias("target"))
    rules = (urls.Rule("r", "block", r"\bcom/x/rare\b", 1), urls.Rule("any", "allow", r"[0-9]", 0))
    assert {row.name: row.token for row in urls.index_of(rules, places).collect()} == {"r": "rare", "any": ""}
    found = {row.url: row.name for row in urls.judged(pages, rules).collect()}
    assert found["http://a.com/x/rare"] == "r"
    assert found["http://b.com/x/3"] == "any"


def test_names_that_clash(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "h", "j"), (2, None, "h", "j")], "page_id long, url string, host string, judged_url string")
    found = urls.filtered(pages)
    assert found.columns == ["page_id", "url", "judged_url", "host", "path", "name", "action"]
    assert sorted((r.page_id, r.judged_url, r.host, r.action) for r in found.collect()) == [(1, "j", "a.org", "allow"), (2, "j", "", "allow")]
