"""Run parameters. The reference hard-wires these in its scripts; here they are
arguments with the reference's values as defaults."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


# Fixed values that must equal the reference's for the same results.
REFERENCE_ANCHOR_DAY = dt.date(2021, 4, 30)          # days-since anchor
REFERENCE_FX_RATE = 4.13                             # device price currency factor
REFERENCE_SCALE = 5.0                                # percentile -> 0..5 score
REFERENCE_CATEGORY = "Video Streaming"               # app_l1_name used for spend
REFERENCE_DAILY_EXCLUDED = ("WIFI",)                 # daily-use channel filter
REFERENCE_SPEND_EXCLUDED = ("WIFI", "Unknown")       # streaming-spend channel filter
REFERENCE_FEATURES = (
    "avg_spend", "prediction", "last_seen", "device_price", "usage_frequency", "overall_brq",
)
REFERENCE_AGE_BANDS = ((0.0, "18-24"), (1.0, "25-34"), (2.0, "35-49"), (3.0, "50+"))
REFERENCE_SWEEP_KS = tuple(range(2, 10))
REFERENCE_K = 6
REFERENCE_MEDIAN_ACCURACY = 1000000
REFERENCE_AUDIENCE_LABEL = "Mobile Device ID"

# Our own default (the reference relies on k-means' class-fixed seed).
DEFAULT_SEED = 20210501


@dataclass(frozen=True)
class ScoringConfig:
    """Parameters of the recency/frequency/monetary scoring job.

    ``anchor_day`` is the day recency is measured from; the month anchor used
    for ``period_months`` is its first day (the reference uses 2021-04-30 and
    2021-04-01).
    """

    anchor_day: dt.date = REFERENCE_ANCHOR_DAY
    daily_excluded: tuple[str, ...] = REFERENCE_DAILY_EXCLUDED
    spend_excluded: tuple[str, ...] = REFERENCE_SPEND_EXCLUDED
    category_col: str = "app_l1_name"
    category: str = REFERENCE_CATEGORY
    fx_rate: float = REFERENCE_FX_RATE
    scale: float = REFERENCE_SCALE
    key: str = "ifa"

    @property
    def anchor_month(self) -> dt.date:
        return self.anchor_day.replace(day=1)


@dataclass(frozen=True)
class ClusteringConfig:
    features: tuple[str, ...] = REFERENCE_FEATURES
    ks: tuple[int, ...] = REFERENCE_SWEEP_KS
    k: int = REFERENCE_K
    seed: int = DEFAULT_SEED
    n_init: int = 1
    max_iter: int = 20
    key: str = "ifa"
