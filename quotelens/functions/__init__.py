"""Column expressions shared by the plans; every one is a built-in Spark expression."""

from quotelens.functions.exprs import (
    decode,
    exposure,
    guarded_ratio,
    matured_flag,
    plan_blend,
    presence_flag,
    rank_from_list,
    rate_change,
    sentinel_status,
    sentinel_value,
)

__all__ = [
    "decode",
    "exposure",
    "guarded_ratio",
    "matured_flag",
    "plan_blend",
    "presence_flag",
    "rank_from_list",
    "rate_change",
    "sentinel_status",
    "sentinel_value",
]
