"""Content hash that identifies a log record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.schema import HASH_FIELDS


def log_hash(fields: Sequence[str] = HASH_FIELDS) -> Column:
    """md5 over the key fields joined by '|'; NULL contributes the text 'None'.

    The separator is not escaped, because stored hashes have to stay comparable.
    """
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(name).cast("string"), F.lit("None")) for name in fields]))
