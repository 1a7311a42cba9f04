"""Date derivations of the usage grain (FN-1..4, FN-5/6).

All anchors are typed date literals, so Catalyst folds them into constants.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def usage_day(ts: str | Column) -> Column:
    """FN-1: calendar day of a usage timestamp."""
    return F.to_date(_c(ts))


def month_start(day: str | Column) -> Column:
    """FN-2: first day of the month."""
    return F.trunc(_c(day), "month")


def months_before(anchor_month: dt.date, month: str | Column) -> Column:
    """FN-3: whole months between a month start and the anchor month (double).

    Both arguments are month starts, so ``months_between`` is integral.
    """
    return F.months_between(F.lit(anchor_month), _c(month))


def days_before(anchor_day: dt.date, day: str | Column) -> Column:
    """FN-4: days from ``day`` to the anchor day (int)."""
    return F.datediff(F.lit(anchor_day), _c(day))


def month_token(path: str | Column) -> Column:
    """FN-5/6: ``yyyyMM`` month token taken from a file path.

    The reference picks the 11th ``/``-separated part, which depends on the
    bucket depth; a six-digit path segment (``/202101/`` or a Hive-style
    ``/month=202101/``) works for any depth.
    """
    return F.regexp_extract(_c(path), r"/(?:[^/=]+=)?(\d{6})(/|$)", 1)
