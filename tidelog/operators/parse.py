"""Turn JSON and text lines into raw standard fields, and a scorer's answers into entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions import fields as R
from tidelog.functions.json_values import as_list, closes_nothing, parse_json
from tidelog.functions.text import strip
from tidelog.schema import VALID_LEVELS

# Between the layout name and its captures. No capture but the last may hold it, and the last one keeps it.
_SEP = "\x01"

_TIME = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?: ?(?:Z|[+-]\d{2}:?\d{2}))?"
_LEVEL = "(?i:" + "|".join(sorted({*VALID_LEVELS, *R.LEVEL_SYNONYMS}, key=lambda name: (-len(name), name))) + ")"
_STAMP = r"[A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2}"

# Line layouts: a pattern for the whole line, and the fields its captures hold, in order.
LAYOUTS = {
    "iso": (
        rf"^({_TIME})\s+(?:\[?({_LEVEL})\]?:?\s+)?(?:\[([^\]\x01]+)\]:?\s+)?(.+)\z",
        ("timestamp", "level", "service", "message"),
    ),
    "java": (
        rf"^({_TIME})\s+\[[^\]]+\]\s+({_LEVEL})\s+([^\s\x01]+)\s+[-:]\s+(.+)\z",
        ("timestamp", "level", "service", "message"),
    ),
    "python": (rf"^({_TIME}) - ([^\s\x01]+) - ({_LEVEL}) - (.+)\z", ("timestamp", "service", "level", "message")),
    "bracket": (
        rf"^\[({_TIME})\]\s+(?:\[?({_LEVEL})\]?:?\s+)?(?:([A-Za-z0-9_./-]+):\s+)?(.+)\z",
        ("timestamp", "level", "service", "message"),
    ),
    "syslog": (
        rf"^<(\d{{1,3}})>({_STAMP}) \S+ ([A-Za-z0-9_./-]+)(?:\[\d+\])?: (.+)\z",
        ("priority", "timestamp", "service", "message"),
    ),
    "syslog_file": (rf"^({_STAMP}) \S+ ([A-Za-z0-9_./-]+)(?:\[\d+\])?: (.+)\z", ("timestamp", "service", "message")),
    "syslog5424": (
        r"^<(\d{1,3})>1 ([^\s\x01]+) \S+ ([^\s\x01]+) \S+ \S+ (?:-|\[[^\]]*\]) ?(.+)\z",
        ("priority", "timestamp", "service", "message"),
    ),
    "access": (
        r'^([^\s\x01]+) \S+ ([^\s\x01]+) \[([^\]\x01]+)\] "([^"\x01]*)" (\d{3}) \S+.*\z',
        ("client", "user", "timestamp", "request", "status"),
    ),
}

_KEY_VALUE = {
    "timestamp": ("ts", "time", "timestamp"),
    "level": ("level", "lvl", "severity"),
    "message": ("msg", "message", "event"),
    "service": ("service", "app", "logger", "component"),
}

_JSON_SHAPE = T.ArrayType(
    T.StructType([T.StructField(name, T.StringType()) for names in R.ALIASES.values() for name in names])
)


def _tag(line: Column, layout: str) -> Column:
    """The line rewritten as separator, layout, captures if the layout fits, else as it was."""
    pattern, names = LAYOUTS[layout]
    captures = "".join(f"{_SEP}${n}" for n in range(1, len(names) + 1))
    return F.regexp_replace(line, f"(?s){pattern}", f"{_SEP}{layout}{captures}")


def _tag_by_start(line: Column) -> Column:
    """Tries the one layout that the beginning of the line allows."""
    newer_syslog = F.contains(F.left(line, F.lit(7)), F.lit(">1 "))
    return (
        F.when(line.startswith("["), _tag(line, "bracket"))
        .when(line.startswith("<"), F.when(newer_syslog, _tag(line, "syslog5424")).otherwise(_tag(line, "syslog")))
        .when(F.ascii(line).between(ord("0"), ord("9")), _tag_dated(line))
        .when(F.ascii(line).between(ord("A"), ord("Z")), _tag(line, "syslog_file"))
        .otherwise(line)
    )


def _tag_dated(line: Column) -> Column:
    """Lines that begin with a time: two layouts of frameworks, told apart by what follows it, and the general one."""
    return (
        F.when(line.rlike(rf"^{_TIME} - [^\s\x01]+ - {_LEVEL} - ."), _tag(line, "python"))
        .when(line.rlike(rf"^{_TIME}\s+\[[^\]]+\]\s+{_LEVEL}\s+[^\s\x01]+\s+[-:]\s+."), _tag(line, "java"))
        .otherwise(_tag(line, "iso"))
    )


def _captures(layout: Column) -> Column:
    """'', the layout, its captures; split into as many parts as the layout has, so that the last capture stays whole."""
    parts = F.when(F.lit(False), F.array(F.lit("")))
    for count in sorted({len(names) for _, names in LAYOUTS.values()}):
        same = [name for name, (_, names) in LAYOUTS.items() if len(names) == count]
        parts = parts.when(layout.isin(same), F.split("_tagged", _SEP, count + 2))
    return parts


def _tag_access(line: Column) -> Column:
    """Access-log lines begin with any host; the quoted request tells them apart cheaply."""
    return F.when(F.contains(line, F.lit('] "')), _tag(line, "access")).otherwise(line)


def _capture(name: str) -> Column:
    """The capture that holds a field, whatever the layout."""
    value = F.when(F.lit(False), F.lit(""))
    for layout, (_, names) in LAYOUTS.items():
        if name in names:
            value = value.when(F.col("layout") == layout, F.nullif(F.get("_parts", names.index(name) + 2), F.lit("")))
    return value


def _key_value(name: str) -> Column:
    keys = "|".join(_KEY_VALUE[name])
    line = F.col("_line")
    found = F.coalesce(
        R.first_match(line, rf'(?:^|\s)(?:{keys})="([^"]*)"'), R.first_match(line, rf"(?:^|\s)(?:{keys})=([^\s\"]+)")
    )
    return F.when(F.col("layout") == "key_value", found)


def _json_value(name: str) -> Column:
    return F.coalesce(*[F.nullif(F.col("_json").getField(alias), F.lit("")) for alias in R.ALIASES[name]])


def _severity(priority: Column) -> Column:
    code = F.pmod(priority.try_cast("int"), F.lit(8))
    return (
        F.when(code <= 2, F.lit("FATAL"))
        .when(code == 3, F.lit("ERROR"))
        .when(code == 4, F.lit("WARN"))
        .when(code <= 6, F.lit("INFO"))
        .when(code == 7, F.lit("DEBUG"))
    )


def _status_level(status: Column) -> Column:
    code = status.try_cast("int")
    return F.when(code >= 500, F.lit("ERROR")).when(code >= 400, F.lit("WARN")).when(code.isNotNull(), F.lit("INFO"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds the raw standard fields to lines with a `type` column (json, jsonl or text).

    A line that fits nothing has a NULL `layout`; all lineage columns are kept and the line becomes
    `raw`. Works in steps, so that each pattern and each JSON parse runs once per line.
    """
    keep = [c for c in lines.columns if c != "line"]
    is_json = F.col("type").isin("json", "jsonl")
    wrapped = F.from_json(F.concat(F.lit("["), "_line", F.lit("]")), _JSON_SHAPE, {"allowSingleQuotes": "false"})

    split = (
        lines.select(*keep, F.col("line").alias("raw"), strip(F.col("line")).alias("_line"))
        .withColumn("_tagged", F.when(~is_json, _tag_by_start(F.col("_line"))))
        .select(
            *keep,
            "raw",
            "_line",
            F.when(is_json & closes_nothing(F.col("_line")), wrapped).alias("_wrapped"),
            F.when(F.col("_tagged") != F.col("_line"), F.col("_tagged")).otherwise(_tag_access(F.col("_line"))).alias("_tagged"),
            is_json.alias("_is_json"),
        )
        .withColumn("_tagged", F.when(~F.col("_is_json") & (F.col("_tagged") != F.col("_line")), F.col("_tagged")))
        .withColumn("_parts", _captures(F.get(F.split("_tagged", _SEP, 3), 1)))
    )
    labelled = split.select(
        *keep,
        "raw",
        "_line",
        "_parts",
        F.when(F.size("_wrapped") == 1, F.get("_wrapped", 0)).alias("_json"),
        F.when((F.size("_wrapped") == 1) & F.col("_line").startswith("{"), F.lit("json"))
        .when(F.size("_parts") > 2, F.get("_parts", 1))
        .when(~is_json & F.col("_line").rlike(r"(?:^|\s)(?:level|lvl|severity)=\S"), F.lit("key_value"))
        .alias("layout"),
    )
    request_line = F.concat_ws(" ", _capture("request"), _capture("status"))
    raw_fields = labelled.select(
        *keep,
        "raw",
        "_line",
        "layout",
        F.coalesce(_json_value("timestamp"), _capture("timestamp"), _key_value("timestamp")).alias("timestamp"),
        F.coalesce(
            _json_value("level"), _capture("level"), _severity(_capture("priority")), _status_level(_capture("status")), _key_value("level")
        ).alias("level"),
        F.coalesce(_json_value("message"), _capture("message"), F.nullif(request_line, F.lit("")), _key_value("message")).alias("message"),
        F.coalesce(_json_value("service"), _capture("service"), _key_value("service")).alias("_service"),
        F.coalesce(_json_value("user_id"), F.nullif(_capture("user"), F.lit("-"))).alias("_user"),
        _json_value("request_id").alias("_request"),
        F.coalesce(_json_value("source_ip"), R.source_ip(_capture("client"))).alias("_ip"),
    )
    known = F.col("layout").isNotNull()
    context = F.when(F.col("layout").isin("json", "bracket", "access"), F.col("message")).otherwise(F.col("_line"))
    mentioned = F.when(F.col("layout") == "json", F.col("message")).otherwise(F.col("_line"))
    return raw_fields.select(
        *keep,
        "raw",
        "layout",
        "timestamp",
        "level",
        "message",
        F.when(known, R.infer_service([F.col("_service")], context)).alias("service"),
        F.when(known, F.coalesce("_user", R.user_id(mentioned))).alias("user_id"),
        F.when(known, F.coalesce("_request", R.request_id(mentioned))).alias("request_id"),
        F.when(known, F.coalesce("_ip", R.source_ip(mentioned))).alias("source_ip"),
    )


def listed_entries(text: Column) -> Column:
    """Entries of a scorer's JSON answer as an array; NULL when the answer is not JSON.

    A leading ```json fence and a trailing ``` are dropped; a single value counts as a list of one.
    """
    body = strip(text)
    body = F.regexp_replace(body, r"^```json|```\z", "")
    return as_list(parse_json(strip(body)))


def model_entries(responses: DataFrame, text: str = "response") -> DataFrame:
    """One row per entry of a scorer's answer, with `entry` (VARIANT), `entry_pos` and `raw`.

    An answer that is not JSON gives no entry, so its chunk is a success with zero records.
    """
    keep = [c for c in responses.columns if c != text]
    return (
        responses.select(*keep, F.posexplode(listed_entries(F.col(text))).alias("_at", "entry"))
        .select(*keep, F.col("_at").cast("long").alias("entry_pos"), "entry", F.to_json("entry").alias("raw"))
    )
