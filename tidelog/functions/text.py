"""Text, size and number formatting columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Binary size units in ascending order.
SIZE_UNITS = ("Bytes", "KB", "MB", "GB", "TB")


def strip(text: Column) -> Column:
    """Remove outer Unicode whitespace (linear time, no regular expression)."""
    return F.trim(text, F.lit(WHITESPACE))


def unix_newlines(text: Column) -> Column:
    """Translate CRLF and bare CR to LF; texts without CR are passed through."""
    return F.when(
        F.contains(text, F.lit("\r")),
        F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")),
    ).otherwise(text)


def or_unknown(value: Column) -> Column:
    """NULL and '' become 'unknown'."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown"))


def one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", value.cast("double"))


def format_bytes(size: Column) -> Column:
    """Human-readable size: at most two decimals, trailing zeros dropped, unit by powers of 1024."""
    size = size.cast("long")
    text = F.when(size == 0, F.lit("0 Bytes"))
    for power, unit in enumerate(SIZE_UNITS):
        scaled = (size.cast("double") / F.lit(float(1024**power))).cast("decimal(22,2)").cast("string")
        label = F.concat(F.regexp_replace(scaled, r"\.?0+$", ""), F.lit(f" {unit}"))
        text = text.when(size < 1024 ** (power + 1), label) if power < len(SIZE_UNITS) - 1 else text.otherwise(label)
    return text


def first_underscore_to_space(text: Column) -> Column:
    at = F.locate("_", text)
    return F.when(at > 0, F.overlay(text, F.lit(" "), at, F.lit(1))).otherwise(text)


def display_time(timestamp: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """ISO text to a fixed display pattern; text that is not a time becomes NULL."""
    return F.date_format(timestamp.try_cast("timestamp"), pattern)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields 0.0 for a zero or missing denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def per_call(total: Column, calls: Column) -> Column:
    """Average with the denominator floored at one."""
    return total.cast("double") / F.greatest(F.lit(1), calls).cast("double")


def elapsed_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def iso_now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
