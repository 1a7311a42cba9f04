"""Column expressions (JVM-side, codegen-friendly; no Python UDFs)."""

from rfmlens.functions.dates import usage_day, month_start, months_before, days_before, month_token
from rfmlens.functions.scalar import (
    channel_allowed,
    try_double,
    safe_ratio,
    band_of,
    converted_price,
)

__all__ = [
    "usage_day",
    "month_start",
    "months_before",
    "days_before",
    "month_token",
    "channel_allowed",
    "try_double",
    "safe_ratio",
    "band_of",
    "converted_price",
]
