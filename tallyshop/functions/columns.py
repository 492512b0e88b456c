"""Column expressions shared by the reports. All of them stay inside codegen.

Numeric rule: sums of money are exact decimals; a ratio is one division of two
doubles; a rounded measure is rounded half-up on its decimal value and returned
as a double.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

Bound = int | Decimal


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def net_revenue(qty: Column | str, price: Column | str, disc: Column | str) -> Column:
    """Price paid for a line: quantity times unit price less its discount."""
    return _col(qty) * _col(price) * (F.lit(1) - _col(disc))


def rounded(x: Column | str, scale: int = 2) -> Column:
    """Round half-up on the decimal value; a plain double round would depend on
    the binary form of the number."""
    return F.round(_col(x).cast("decimal(38,10)"), scale).cast("double")


def _double_ratio(num: Column, den: Column) -> Column:
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def ratio(num: Column | str, den: Column | str, scale: int = 2) -> Column:
    """``num / den`` rounded; null when ``den`` is zero or null."""
    return rounded(_double_ratio(_col(num), _col(den)), scale)


def mean(x: Column | str) -> Column:
    """Average as one division of an exact sum by the non-null count."""
    return _double_ratio(F.sum(_col(x)), F.count(_col(x)))


def count_if(pred: Column) -> Column:
    """Rows where ``pred`` is true; 0 rather than null where none is."""
    return F.coalesce(F.sum(F.when(pred, 1).otherwise(0)), F.lit(0))


def share_pct(part: Column | str, whole: Column | str, scale: int = 2) -> Column:
    """``part`` as a percentage of ``whole``."""
    return rounded(_double_ratio(_col(part).cast("double") * 100.0, _col(whole)), scale)


def rate_pct(pred: Column, scale: int = 2) -> Column:
    """Percentage of the rows of a group for which ``pred`` is true."""
    return share_pct(F.sum(F.when(pred, 1).otherwise(0)), F.count("*"), scale)


def tier_lt(x: Column | str, bounds: Sequence[Bound], labels: Sequence[str]) -> Column:
    """Label of the first bound above ``x``. The last label takes everything
    else, null included."""
    if len(labels) != len(bounds) + 1:
        raise ValueError("need one label more than bounds")
    x = _col(x)
    tiers = F
    for bound, name in zip(bounds, labels):
        tiers = tiers.when(x < F.lit(bound), name)
    return tiers.otherwise(labels[-1])


def tier_le(x: Column | str, bounds: Sequence[Bound], labels: Sequence[str]) -> Column:
    """Exact zero, then half-open tiers ``(lower, upper]`` starting at zero. The
    last label takes everything else: above the top bound, negative, or null."""
    if len(labels) != len(bounds) + 2:
        raise ValueError("need two labels more than bounds")
    x = _col(x)
    tiers = F.when(x == 0, labels[0])
    lower: Bound = 0
    for upper, name in zip(bounds, labels[1:]):
        tiers = tiers.when((x > F.lit(lower)) & (x <= F.lit(upper)), name)
        lower = upper
    return tiers.otherwise(labels[-1])


def label(x: Column | str, mapping: Mapping[int, str], default: str) -> Column:
    """Text for a code; ``default`` for an unknown or null code."""
    x = _col(x)
    out = F
    for code, text in mapping.items():
        out = out.when(x == code, text)
    return out.otherwise(default)


def period(x: Column | str, kind: str) -> Column:
    """Calendar key of a date: ``month`` (``2017-03``), ``year``, ``quarter``
    (1-4), ``month_of_year`` (1-12) or ``month_name`` (full English name)."""
    x = _col(x)
    match kind:
        case "month":
            return F.date_format(x, "yyyy-MM")
        case "year":
            return F.year(x).cast("bigint")
        case "quarter":
            return F.quarter(x).cast("bigint")
        case "month_of_year":
            return F.month(x).cast("bigint")
        case "month_name":
            return F.date_format(x, "MMMM")
    raise ValueError(f"unknown period {kind!r}")
