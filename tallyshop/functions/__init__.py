from tallyshop.functions.columns import (
    count_if,
    label,
    mean,
    net_revenue,
    period,
    rate_pct,
    ratio,
    rounded,
    share_pct,
    tier_le,
    tier_lt,
)

__all__ = [
    "count_if",
    "label",
    "mean",
    "net_revenue",
    "period",
    "rate_pct",
    "ratio",
    "rounded",
    "share_pct",
    "tier_le",
    "tier_lt",
]
