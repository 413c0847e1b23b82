"""Deterministic normalization rules for single log fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.json_values import field_text
from tidelog.functions.text import strip

# Spellings of a level that map to an accepted one.
LEVEL_SYNONYMS = {
    "WARNING": "WARN",
    "ERR": "ERROR",
    "CRITICAL": "FATAL",
    "CRIT": "FATAL",
    "EMERG": "FATAL",
    "ALERT": "FATAL",
    "PANIC": "FATAL",
    "NOTICE": "INFO",
    "INFORMATION": "INFO",
}

# Member names under which applications log each standard field.
ALIASES = {
    "timestamp": ("timestamp", "@timestamp", "time", "ts", "datetime", "date"),
    "level": ("level", "severity", "lvl", "log_level"),
    "message": ("message", "msg", "event", "log", "text"),
    "service": ("service", "app", "logger", "component"),
    "user_id": ("user_id", "userId", "uid"),
    "request_id": ("request_id", "requestId", "req_id", "trace_id"),
    "source_ip": ("source_ip", "ip", "client_ip", "remote_addr"),
}

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
# Digits of an ISO fraction that a microsecond timestamp cannot hold.
_SUB_MICRO = r"[.,]\d{6}(\d{1,3})(?: ?(?:Z|[+-]\d{2}:?\d{2}))?$"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?:^|[^0-9.])((?:{_OCTET}\.){{3}}{_OCTET})(?:[^0-9.]|\.[^0-9]|\.$|$)"
_ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?( ?(Z|[+-]\d{2}:?\d{2}))?)?$"
URL_HOST = r"https?://([A-Za-z0-9.-]+)"


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """Capture group of the first match; NULL instead of '' when nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def normalize_level(level: Column) -> Column:
    """Upper case, outer whitespace removed, known synonyms mapped; other text is kept for validation."""
    name = F.nullif(F.upper(strip(level)), F.lit(""))
    synonyms = F.create_map(*[F.lit(text) for pair in LEVEL_SYNONYMS.items() for text in pair])
    return F.coalesce(F.try_element_at(synonyms, name), name)


def parse_time(text: Column, default_year: int | Column | None = None) -> Column:
    """TIMESTAMP from ISO (blank or T, comma or dot fraction, any offset), epoch seconds or
    milliseconds, access-log and date-only text; syslog times only when a year is given (a number or a column).

    Times without an offset are taken as UTC; text that fits no form becomes NULL.
    """
    body = strip(text)
    # With the shape known, fixed positions and plain replacements give text that casts directly.
    clock = F.translate(F.substring(body, F.lit(12), F.length(body)), ", ", ".")
    zone = F.when(clock.endswith("Z") | F.contains(clock, F.lit("+")) | F.contains(clock, F.lit("-")), "").otherwise("Z")
    seconds = F.when(F.substring(clock, 6, 1) == ":", "").otherwise(":00")
    filled = F.when(clock == "", "00:00:00").otherwise(F.concat(F.left(clock, F.lit(5)), seconds, F.substring(clock, 6, 40)))
    iso = F.concat(F.left(body, F.lit(10)), F.lit("T"), filled, zone)
    parsed = (
        F.when(body.rlike(_ISO_SHAPE), iso.try_cast("timestamp"))
        .when(body.rlike(r"^\d{13}$"), F.timestamp_millis(body.try_cast("long")))
        .when(
            body.rlike(r"^\d{9,10}(\.\d{1,6})?$"),
            F.timestamp_micros((body.try_cast("decimal(20,6)") * 1000000).cast("long")),
        )
        .when(
            body.rlike(r"^\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}$"),
            F.try_to_timestamp(body, F.lit("dd/MMM/yyyy:HH:mm:ss Z")),
        )
    )
    if default_year is not None:
        year = default_year if isinstance(default_year, Column) else F.lit(default_year)
        squeezed = F.regexp_replace(body, " +", " ")
        parsed = parsed.when(
            body.rlike(r"^[A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2}$"),
            F.try_to_timestamp(F.concat(year.cast("string"), F.lit(" "), squeezed, F.lit(" +0000")), F.lit("yyyy MMM d HH:mm:ss Z")),
        )
    return parsed


def iso_utc(time: Column) -> Column:
    """UTC text with microseconds; its width is fixed, so that text order is the time order."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), ISO_FORMAT)


def normalize_timestamp(text: Column, default_year: int | Column | None = None) -> Column:
    """`iso_utc` of any known form. Nanoseconds that are given and not zero stay as three further digits, so no two
    different times become one; only inside a microsecond does text order then differ from time order.
    """
    time = iso_utc(parse_time(text, default_year))
    body = strip(text)
    finer = F.rpad(F.regexp_extract(body, _SUB_MICRO, 1), 3, "0")
    fine = (F.length(body) > 26) & body.rlike(_SUB_MICRO) & (finer != "000")
    return F.when(fine, F.concat(F.left(time, F.lit(26)), finer, F.lit("Z"))).otherwise(time)


def clean_message(text: Column) -> Column:
    """Runs of whitespace collapse to one blank, outer whitespace goes, '' becomes NULL."""
    uneven = F.lit(False)
    for run in ("  ", "\t", "\r", "\n", "\x0b", "\x0c"):
        uneven = uneven | F.contains(text, F.lit(run))
    return blank_to_null(F.when(uneven, F.regexp_replace(text, r"[ \t\r\n\x0b\x0c]+", " ")).otherwise(text))


def source_ip(text: Column) -> Column:
    """First IPv4 address that is not part of a longer dotted number."""
    three_dots = F.substring_index(text, ".", 3) != text
    return F.when(three_dots, first_match(text, IPV4))


def url_host(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("://")), F.lower(first_match(text, URL_HOST)))


def bracketed_service(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("[")), first_match(text, r"\[([A-Za-z][A-Za-z0-9_.-]*)\]"))


def infer_service(candidates: Sequence[Column], context: Column) -> Column:
    """First given candidate, else a bracketed name, else the host of a URL, else 'unknown'."""
    return F.coalesce(
        *[blank_to_null(c) for c in candidates], bracketed_service(context), url_host(context), F.lit("unknown")
    )


def user_id(text: Column) -> Column:
    pattern = r"(?:^|[^A-Za-z0-9_])(?:user_id|userid|uid|user)[=:] ?\"?([A-Za-z0-9_.@-]+)"
    return F.when(F.contains(text, F.lit("user")) | F.contains(text, F.lit("uid")), first_match(text, pattern))


def request_id(text: Column) -> Column:
    pattern = r"(?:^|[^A-Za-z0-9_])(?:request_id|requestid|req_id|trace_id)[=:] ?\"?([A-Za-z0-9_.-]+)"
    return F.when(F.contains(text, F.lit("id")), first_match(text, pattern))


def json_field(value: Column, name: str) -> Column:
    """First non-blank member among the aliases of a standard field."""
    return F.coalesce(*[blank_to_null(field_text(value, alias)) for alias in ALIASES[name]])
