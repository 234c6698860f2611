"""Every literal of the mart, as parameters."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# Business codes, words and dates that decide the result.
NEW_BUSINESS_REASONS = ("new-business", "rerate", "override")
TIER_ORDER = ("recommended", "low", "high", "custom")
FICO_MARKERS = ("no_score", "thin_file", "0")
MONTHS_MARKERS = ("no_use",)
DRIVING_SCORE_MARKERS = ("no_use", "test_drive")
PRIOR_INSURANCE_CLASSES = {
    "A": "0 days without",
    "B": "1-31 days without",
    "C": ">31 days without or no prior",
    "N": "unknown",
}
RERATE_REASON = "non_ubi_premium_analysis"
RERATE_ANALYSIS_VERSION = 1
AS_OF = dt.date(2018, 12, 31)
STUDY_START = dt.date(2018, 8, 28)
STUDY_END = dt.date(2018, 12, 31)


@dataclass(frozen=True)
class MartParams:
    as_of: dt.date = AS_OF
    study_start: dt.date = STUDY_START
    study_end: dt.date = STUDY_END
    maturity_days: tuple[int, ...] = (35, 70)
    new_business_reasons: tuple[str, ...] = NEW_BUSINESS_REASONS
    tier_order: tuple[str, ...] = TIER_ORDER
    monthly_plan: str = "monthly"
    full_plan: str = "full_term"
    unknown_plan: str = "unknown"
    full_payment_weight: float = 0.3
    term_years: float = 0.5
    hypothetical_rank: int = 2
    rerate_reason: str = RERATE_REASON
    rerate_analysis_version: int = RERATE_ANALYSIS_VERSION
    fico_markers: tuple[str, ...] = FICO_MARKERS
    months_markers: tuple[str, ...] = MONTHS_MARKERS
    driving_score_markers: tuple[str, ...] = DRIVING_SCORE_MARKERS
    prior_insurance_classes: dict[str, str] = field(
        default_factory=lambda: dict(PRIOR_INSURANCE_CLASSES)
    )
    #: Middle part of the names of the price ratio columns.
    ratio_label: str = "own_to_competitor"
    #: False turns bad numbers in text columns into nulls instead of failing.
    strict_casts: bool = True
