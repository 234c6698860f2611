"""Scalar expressions: code ranks, maturity labels, sentinel casts, blends, ratios."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode(c: ColumnLike, mapping: Mapping, default=None) -> Column:
    """Replace known codes; anything else, null included, becomes ``default``."""
    c = col(c)
    pairs = list(mapping.items())
    if not pairs:
        return F.lit(default)
    code, value = pairs[0]
    chain = F.when(c == F.lit(code), F.lit(value))
    for code, value in pairs[1:]:
        chain = chain.when(c == F.lit(code), F.lit(value))
    return chain.otherwise(F.lit(default))


def rank_from_list(c: ColumnLike, values: Sequence[str]) -> Column:
    """1-based position in ``values``; null for a value that is not listed."""
    return decode(c, {v: i for i, v in enumerate(values, 1)}).cast("int")


def matured_flag(date_col: ColumnLike, as_of: dt.date, days: int, flag: bool) -> Column:
    """``flag`` once ``days`` days have passed at ``as_of``, null before.

    A null date compares as unknown, so it gets ``flag`` too.
    """
    age = F.datediff(F.lit(as_of), col(date_col))
    return F.when(age < days, F.lit(None).cast("boolean")).otherwise(F.lit(flag))


def sentinel_status(c: ColumnLike, markers: Sequence[str]) -> Column:
    """The marker word itself, or ``'populated'`` for anything else, null included."""
    c = col(c)
    return F.when(c.isin(*markers), c).otherwise(F.lit("populated"))


def sentinel_value(c: ColumnLike, markers: Sequence[str], strict: bool = True) -> Column:
    """Number held by a text column in which some words stand for "no value".

    Under ANSI mode an unlisted word raises; ``strict=False`` makes it null.
    """
    c = col(c)
    number = c.cast("double") if strict else c.try_cast("double")
    return F.when(~c.isin(*markers), number)


def plan_blend(
    plan: ColumnLike,
    monthly: ColumnLike,
    full: ColumnLike,
    w_full: float = 0.3,
    monthly_code: str = "monthly",
    full_code: str = "full_term",
) -> Column:
    """Amount under the payment plan; a weighted mix where the plan is not known."""
    plan, monthly, full = col(plan), col(monthly), col(full)
    mix = F.lit(w_full) * full + F.lit(1 - w_full) * monthly
    return F.when(plan == monthly_code, monthly).when(plan == full_code, full).otherwise(mix)


def guarded_ratio(n: ColumnLike, d: ColumnLike) -> Column:
    """``n / d``, null where ``d`` is zero or null."""
    n, d = col(n), col(d)
    return F.when(d != 0, n / d)


def rate_change(
    n: ColumnLike,
    d: ColumnLike,
    n_units: ColumnLike | None = None,
    d_units: ColumnLike | None = None,
) -> Column:
    """Relative change from ``d`` to ``n``, each per unit if units are given.

    Only ``d`` is guarded: zero units under a non-null amount is an error.
    """
    n, d = col(n), col(d)
    new = n if n_units is None else n / col(n_units)
    old = d if d_units is None else d / col(d_units)
    return F.when(d != 0, new / old - 1)


def exposure(units: ColumnLike, *premiums: ColumnLike, years: float = 0.5) -> Column:
    """Unit-years; zero where every given premium is exactly zero."""
    earned = F.lit(years) * col(units)
    if not premiums:
        return earned
    declined = reduce(lambda a, b: a & b, [col(p) == 0 for p in premiums])
    return F.when(declined, F.lit(0.0)).otherwise(earned)


def presence_flag(amount: ColumnLike) -> Column:
    """1 for a positive amount, 0 for zero, null for negative or null."""
    amount = col(amount)
    return F.when(amount > 0, 1).when(amount == 0, 0)
