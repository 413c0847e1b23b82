"""URL filters: pattern rules found through their rarest literal token.

A rule is a regular expression over host and path. Words that any matching URL must contain as whole tokens are read off
the expression; how often each occurs is counted over the URLs that are judged, and the rule is indexed by the rarest.
The tokens of a URL fetch its candidate rules by a join, and only those expressions run on it. Rules without a literal
token are candidates of every URL. Distinct URLs are judged once; a hot URL or a token that a third of the URLs share is
an ordinary (skewed) join key, and the index has one row per rule.

Nulls: a null URL, or one without `://`, has empty host and path, so no rule fits and it is allowed. Repeated rows stay.
Extra columns are ignored. Long URLs are judged whole. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op  # the parsed form of expressions
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@dataclass(frozen=True)
class Rule:
    """`pattern` is searched in host + path. Of the rules that match, the highest `rank` wins, then the first name."""

    name: str
    action: str
    pattern: str
    rank: int


def quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


def prefix_rule(action: str, place: str) -> Rule:
    """A host with all subdomains and the beginning of a path, as in `example.org/en/`. The longest place wins."""
    host, slash, path = place.partition("/")
    return Rule(place, action, f"^(?:[^/]*\\.)?{quoted(host)}{quoted(slash + path)}", len(place))


def host_word_rule(action: str, word: str) -> Rule:
    """A whole word of the host name; weaker than any place rule."""
    return Rule(word, action, f"^[^/]*\\b{quoted(word)}\\b", 0)


# The place rules of the contract.
PLACES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
# Words of host names that no training page is taken from.
HOST_WORDS = ("adult", "bets", "casino", "gambling", "malware", "phishing", "porn", "spam", "xxx")
PLACE_RULES = tuple(prefix_rule(action, place) for action, place in PLACES)
WORD_RULES = tuple(host_word_rule("block", word) for word in HOST_WORDS)


def literal_tokens(pattern: str) -> list[str]:
    """Words that every match of `pattern` contains as whole tokens (a-z and 0-9, case ignored)."""
    found: list[str] = []
    run, whole, edge = "", False, False  # the literal being read; whether a token surely begins there, or would here

    def close(ends: bool) -> None:
        nonlocal run
        if run and whole and ends:
            found.append(run)
        run = ""

    for kind, value in _parser.parse(pattern):
        if kind is op.LITERAL:
            letter = chr(value).lower()
            if letter in WORD:
                if not run:
                    whole = edge
                run += letter
            else:
                close(True)
            edge = letter not in WORD
        elif kind is op.AT and value in (op.AT_BOUNDARY, op.AT_END):
            close(True)
            edge = True
        elif kind is op.AT:
            edge = True
        elif _ends_apart(kind, value):
            close(False)  # whether the group is there or not, a border before it is one after it
        else:
            close(False)
            edge = False
    close(False)
    return sorted(set(found))


def _ends_apart(kind, value) -> bool:
    """An optional group that ends in a separator, as `(?:[^/]*\\.)?` does."""
    if kind is not op.MAX_REPEAT or value[1] != 1:
        return False
    items = value[2]
    if len(items) == 1 and items[0][0] is op.SUBPATTERN:
        items = items[0][1][3]
    return len(items) > 0 and items[-1][0] is op.LITERAL and chr(items[-1][1]).lower() not in WORD


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from there up to `?`, `#` or the end."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 2)


def tokens_of(text: Column) -> Column:
    """The distinct a-z and 0-9 words of a text, case ignored; also the empty word, under which rules without a token are kept."""
    words = F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+")
    return F.array_distinct(F.concat(words, F.array(F.lit(""))))


def index_of(rules: tuple[Rule, ...], places: DataFrame) -> DataFrame:
    """(token, name, action, pattern, rank): each rule under the rarest of its tokens among the URLs of `places`."""
    spark = places.sparkSession
    rows = [{"token": token, **vars(rule)} for rule in rules for token in literal_tokens(rule.pattern) or [""]]
    listed = spark.createDataFrame(pa.Table.from_pylist(rows))
    words = places.select(F.explode(tokens_of(F.col("target"))).alias("token"))
    counts = words.join(listed.select("token").distinct(), "token").groupBy("token").count()
    ranked = listed.join(counts, "token", "left").groupBy("name", "action", "pattern", "rank")
    return ranked.agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))


def judged(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(url, host, path, name, action) per distinct URL; name and action are null where no rule matches."""
    places = urls.select("url").distinct()
    host, path = host_and_path(F.col("url"))
    places = places.select("url", host.alias("host"), path.alias("path")).withColumn("target", F.concat("host", "path"))
    index = index_of(rules, places)
    words = places.where("host <> ''").select("url", "target", F.explode(tokens_of(F.col("target"))).alias("token"))
    fitting = words.join(index, "token").where(F.regexp_like("target", F.col("pattern")))
    best = fitting.groupBy("url").agg(F.min_by(F.struct("name", "action"), F.struct(-F.col("rank"), "name")).alias("best"))
    found = places.join(best.withColumnRenamed("url", "best_url"), F.col("url") == F.col("best_url"), "left")
    return found.select("url", "host", "path", "best.name", "best.action")


def filtered(pages: DataFrame, rules: tuple[Rule, ...] = PLACE_RULES + WORD_RULES) -> DataFrame:
    """The pages with host, path, the winning rule's name and action; action is `allow` where no rule matches."""
    found = judged(pages, rules).withColumnRenamed("url", "judged_url")
    # The rows are carried as one column, so that no name of theirs can clash; the columns added replace any of the same name.
    joined = pages.select(F.struct("*").alias("row")).join(found, F.col("row.url").eqNullSafe(F.col("judged_url")), "left")
    added = {"host": F.col("host"), "path": F.col("path"), "name": F.col("name"), "action": F.coalesce("action", F.lit("allow"))}
    return joined.select(*[F.col(f"row.`{name}`") for name in pages.columns if name not in added], *[value.alias(name) for name, value in added.items()])


def op7(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule (a place rule or null), verdict, and matched (the winning rule of either sort)."""
    found = filtered(pages.select("page_id", "url"))
    place = F.when(F.col("name").isin([rule.name for rule in PLACE_RULES]), F.col("name"))
    return found.select("page_id", "host", "path", place.alias("rule"), F.col("action").alias("verdict"), F.col("name").alias("matched"))


def _sql() -> str:
    places = ", ".join(f"('{action}', '{place}')" for action, place in PLACES)
    words = "|".join(HOST_WORDS)
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parted AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM cut
), rules AS (
  SELECT action, rule, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path
  FROM (VALUES {places}) AS t(action, rule)
), judged AS (
  SELECT *, (SELECT max_by(rule, length(rule)) FROM rules
             WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule,
         CASE WHEN regexp_matches(host, '\\b({words})\\b') THEN (SELECT min(w) FROM unnest(string_split('{words}', '|')) AS u(w) WHERE regexp_matches(host, '\\b' || w || '\\b')) END AS word
  FROM parted
)
SELECT page_id, host, path, rule,
       coalesce((SELECT action FROM rules WHERE rules.rule = judged.rule), CASE WHEN word IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       coalesce(rule, word) AS matched
FROM judged"""


OP7_SQL = _sql()
