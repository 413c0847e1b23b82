"""JSON values as VARIANT columns with the truth and text rules of a dynamic language."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.schema import HASH_FIELDS, LOG_FIELDS, REQUIRED_FIELDS, VALID_LEVELS
from tidelog.functions.text import strip

_STRICT = {"allowSingleQuotes": "false"}


def parse_json(text: Column) -> Column:
    """One JSON value per text, NULL when the text is anything else.

    The text is wrapped in an array before parsing, so trailing characters or a second value
    make the parse fail instead of being ignored.
    """
    wrapped = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<variant>", _STRICT)
    return F.when((F.size(wrapped) == 1) & closes_nothing(text), F.get(wrapped, 0))


def closes_nothing(text: Column) -> Column:
    """Whether a text that parses inside `[` and `]` is one value by itself, and not `1] x`, which closes the array.

    No text but a value parses inside an array and as an object's member as well; only texts with a `]` are tried.
    """
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return ~F.contains(text, F.lit("]")) | member.isNotNull()


def parse_json_array(text: Column) -> Column:
    """Elements of a JSON array text; each element is its own VARIANT, so the whole may be large."""
    body = strip(text)
    return F.when(
        body.startswith("[") & body.endswith("]"), F.from_json(body, "array<variant>", _STRICT)
    )


def kind(value: Column) -> Column:
    """Type name of a VARIANT: OBJECT.., ARRAY.., STRING, BOOLEAN, BIGINT, DECIMAL.., VOID; NULL if absent."""
    return F.schema_of_variant(value)


def field(value: Column, name: str) -> Column:
    """A top-level member as VARIANT; NULL when the value has no such key, VOID when it is JSON null."""
    return F.variant_get(value, f"$['{name}']", "variant")


def field_text(value: Column, name: str) -> Column:
    return F.variant_get(value, f"$['{name}']", "string")


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("OBJECT"), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("ARRAY"), F.lit(False))


def as_list(value: Column) -> Column:
    """Array elements, or a one-element list holding any other value."""
    return F.when(is_array(value), F.variant_get(value, "$", "array<variant>")).when(
        value.isNotNull(), F.array(value)
    )


def truthy(value: Column) -> Column:
    """False for missing, null, '', 0, false, [] and {}."""
    name = kind(value)
    text = F.variant_get(value, "$", "string")
    return F.coalesce(
        F.when(name == "VOID", F.lit(False))
        .when(name == "STRING", text != "")
        .when(name == "BOOLEAN", text == "true")
        .when(name.startswith("ARRAY"), text != "[]")
        .when(name.startswith("OBJECT"), text != "{}")
        .otherwise(F.try_variant_get(value, "$", "double") != 0.0),
        F.lit(False),
    )


def entry_problem(value: Column) -> Column:
    """NULL for an acceptable log record, otherwise the reason it is rejected."""
    level = field(value, "level")
    problem = F.when(~is_object(value), F.lit("not an object"))
    for name in REQUIRED_FIELDS:
        problem = problem.when(~truthy(field(value, name)), F.lit(f"missing {name}"))
    return problem.when(kind(level) != "STRING", F.lit("level is not text")).when(
        ~F.upper(F.variant_get(level, "$", "string")).isin(*VALID_LEVELS), F.lit("unknown level")
    )


def storage_problem(value: Column) -> Column:
    """Reason a TEXT table refuses a record: an array or object in one of the standard fields."""
    problem = F.when(F.lit(False), F.lit(""))
    for name in LOG_FIELDS:
        member = kind(field(value, name))
        problem = problem.when(member.startswith("ARRAY") | member.startswith("OBJECT"), F.lit(f"{name} is not a scalar"))
    return problem


def scalar_text(raw: Column, value: Column, name: str) -> Column:
    """Text of a member as a dynamic language prints it: missing '', null 'None', true 'True'.

    Numbers are taken from the source text, which keeps 1.0 apart from 1.
    """
    member = field(value, name)
    member_kind = kind(member)
    text = F.variant_get(member, "$", "string")
    return (
        F.when(member.isNull(), F.lit(""))
        .when(member_kind == "VOID", F.lit("None"))
        .when(member_kind == "BOOLEAN", F.initcap(text))
        .when(member_kind == "STRING", text)
        .otherwise(F.coalesce(F.get_json_object(raw, f"$.{name}"), text))
    )


def json_hash(raw: Column, value: Column) -> Column:
    """Content hash of an unnormalized JSON record, telling missing members from null ones."""
    return F.md5(F.concat_ws("|", *[scalar_text(raw, value, name) for name in HASH_FIELDS]))


def sqlite_text(value: Column, name: str) -> Column:
    """Text a TEXT column stores for a scalar member (true becomes '1'); NULL for null and nested ones."""
    member = field(value, name)
    text = F.variant_get(member, "$", "string")
    member_kind = kind(member)
    return (
        F.when(member.isNull() | (member_kind == "VOID"), F.lit(None).cast("string"))
        .when(member_kind.startswith("ARRAY") | member_kind.startswith("OBJECT"), F.lit(None).cast("string"))
        .when(member_kind == "BOOLEAN", F.when(text == "true", F.lit("1")).otherwise(F.lit("0")))
        .otherwise(text)
    )


@F.pandas_udf(T.BooleanType())
def loads_ok(texts: pd.Series) -> pd.Series:
    """Whether each (short) text is one strict JSON value; used on the few head lines of a file."""

    def accepts(text: str | None) -> bool:
        try:
            json.loads(text)
        except (TypeError, ValueError):
            return False
        return True

    return texts.map(accepts).astype(bool)


@F.pandas_udf(T.ArrayType(T.StringType()))
def dumps(texts: pd.Series) -> pd.Series:
    """Re-serialize an array of JSON texts with ', ' and ': ' separators and ASCII escapes."""
    return texts.map(lambda items: None if items is None else [json.dumps(json.loads(item)) for item in items])
