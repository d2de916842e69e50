"""Date helpers.

Dates are typed inside every job and rendered as ``yyyyMMdd`` / ``yyyy-MM``
text only for output, as the reference's tables store them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz(day: str) -> Column:
    """A TIMESTAMP_NTZ literal at midnight; comparable to the raw parquet column
    so the comparison reaches the scan as a pushed filter."""
    return F.expr(f"TIMESTAMP_NTZ '{day} 00:00:00'")


def day_range(col: str, start: str, end_exclusive: str) -> Column:
    """Half-open day range on a raw timestamp column (F4 ``BETWEEN`` of days)."""
    c = F.col(col)
    return (c >= ntz(start)) & (c < ntz(end_exclusive))


def ymd_text(c: Column) -> Column:
    """Date → ``yyyyMMdd`` text (C4 ``strftime('%Y%m%d', ...)``)."""
    return F.date_format(c, "yyyyMMdd")


def month_text(c: Column) -> Column:
    """Date → ``yyyy-MM`` text (C3 ``strftime('%Y-%m', ...)``)."""
    return F.date_format(c, "yyyy-MM")


def month_by_substr(s: Column) -> Column:
    """C1 + C2: ``substr(s,1,4) || '-' || substr(s,5,2)`` on ``yyyyMMdd`` text."""
    return F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 2))


def parse_ymd(s: Column) -> Column:
    """``yyyyMMdd`` text → date, NULL when invalid (never raises under ANSI)."""
    return F.try_to_date(s, "yyyyMMdd")


def month_start(c: Column) -> Column:
    """First day of the month."""
    return F.trunc(c, "MM")


def month_end(c: Column) -> Column:
    """Last day of the month."""
    return F.last_day(c)
