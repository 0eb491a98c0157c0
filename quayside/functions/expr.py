"""Scalar column helpers (all native Spark expressions, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_even(c: str | Column, digits: int) -> Column:
    """numpy-style rounding of a double: rint(x * 10^d) / 10^d (ties to even)."""
    scale = float(10 ** digits)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale)


def weekday_mon0(c: str | Column) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6 (pandas ``dayofweek``)."""
    return F.weekday(col(c))


def not_blank(c: str | Column) -> Column:
    """True when a string is present and has a character above U+0020."""
    return col(c).isNotNull() & col(c).rlike("[^\\x00-\\x20]")


def error_list(*rules: tuple[Column, str]) -> Column:
    """``field: message, field: message`` of the failing rules, '' when none fail.

    Each rule is ``(fails, text)``; nulls drop out of ``concat_ws``.
    """
    parts = [F.when(fails, F.lit(text)) for fails, text in rules]
    return F.concat_ws(", ", *parts)


def stable_id(*parts: str | Column) -> Column:
    """Deterministic row id: sha-256 of the ':'-joined parts (replays dedupe). A
    null part is written as ``\\N`` so that it keeps its place."""
    return F.sha2(joined_key(*parts), 256)


def joined_key(*parts: str | Column) -> Column:
    """The parts as one ':'-joined text, null parts as ``\\N``."""
    return F.concat_ws(":", *[F.coalesce(col(p).cast("string"), F.lit("\\N")) for p in parts])


def sku_of(key: str | Column) -> Column:
    """``SKU-`` plus the key zero-padded to at least six digits."""
    return F.format_string("SKU-%06d", col(key).cast("bigint"))


def iso_instant(c: str | Column) -> Column:
    """Timestamp as an ISO-8601 instant text with microseconds and 'Z'."""
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def instant_text(c: str | Column) -> Column:
    """An instant as text with a fraction of 0, 3 or 6 digits, as many as it needs."""
    us = F.unix_micros(col(c).cast("timestamp")) % 1000000
    fraction = (F.when(us == 0, F.lit("")).when(us % 1000 == 0, F.format_string(".%03d", (us / 1000).cast("int")))
                .otherwise(F.format_string(".%06d", us.cast("int"))))
    return F.concat(F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def half_up_int(c: str | Column) -> Column:
    """``%.0f`` of a decimal: round half away from zero, as a whole number."""
    return F.round(col(c), 0).cast("bigint")
