"""Scalar helpers: channel predicates, ANSI-safe casts and ratios, banding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def channel_allowed(channel: str | Column, excluded: Sequence[str]) -> Column:
    """FLT-3/FLT-4: ``NOT LIKE`` without wildcards = case-sensitive inequality.

    As in SQL, a null channel is not allowed (the predicate is null).
    """
    c = _c(channel)
    if not excluded:
        return c.isNotNull()
    return c.isNotNull() & ~c.isin(list(excluded))


def try_double(col: str | Column) -> Column:
    """ANSI-safe cast: unparsable text becomes null instead of failing the job."""
    return _c(col).try_cast("double")


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """FN-14: ratio that is null (not an error) for a zero or null divisor."""
    return F.try_divide(_c(num), _c(den))


def band_of(value: str | Column, bands: Sequence[tuple[float, str]]) -> Column:
    """FN-15: map a class number to a label; unmapped values give null."""
    v = _c(value)
    expr = None
    for code, label in bands:
        expr = (F.when(v == F.lit(code), F.lit(label)) if expr is None
                else expr.when(v == F.lit(code), F.lit(label)))
    return expr


def converted_price(price: str | Column, fx_rate: float) -> Column:
    """FN-8: device price in the target currency."""
    return try_double(price) * F.lit(float(fx_rate))
