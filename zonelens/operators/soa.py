"""SOA timer report (B23, D8, J8): one scan, conditional counts per timer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Recommended SOA timer ranges (exclusive bounds), seconds.
SOA_RANGES = {
    "refresh": (72000, 100800),
    "retry": (3600, 10800),
    "expire": (2700000, 3600000),
    "minimum": (129600, 216000),
}

# K2: the reference tests each timer against another timer's bounds.
COMPAT_PAIRING = {"refresh": "expire", "retry": "minimum", "expire": "retry", "minimum": "refresh"}


def in_open_range(c, lo, hi):
    """Not null and lo < c < hi."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (c > lo) & (c < hi)


def soa_ranges(obs: DataFrame, by=("day",), compat: bool = False) -> DataFrame:
    """Per day, SOA timers inside / below / above the recommended range.

    ``compat`` reproduces the reference's pairing (K2) for the in-range
    counts: bounds of timer t are applied to the column COMPAT_PAIRING[t].
    """
    aggs = []
    for timer, (lo, hi) in SOA_RANGES.items():
        col = F.col("soa_" + (COMPAT_PAIRING[timer] if compat else timer))
        aggs.append(F.count_if(in_open_range(col, lo, hi)).alias(f"in_range_{timer}"))
        if not compat:
            aggs.append(F.count_if(col <= lo).alias(f"below_{timer}"))
            aggs.append(F.count_if(col >= hi).alias(f"above_{timer}"))
    return obs.groupBy(*by).agg(*aggs)
