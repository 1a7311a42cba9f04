"""Structured Streaming entry points.

The reference is batch only; its per-month loop (read one month, write that
month's spend) maps onto a file stream that refreshes the touched months.
"""

from rfmlens.streaming.monthly import monthly_spend_stream, refresh_keys

__all__ = ["monthly_spend_stream", "refresh_keys"]
