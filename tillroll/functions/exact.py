"""Exact arithmetic helpers (JVM-side Column expressions, no UDFs).

Money stays ``decimal`` from the raw price to the final rounding.  Ratios and
averages are rounded *exactly*: numerator and denominator are integers (counts,
pence, tenths of a day), the quotient is rounded half away from zero with
integer arithmetic, and only the rounded result becomes a double.  Rounding a
double (``round(1.005, 2)``) differs between engines at ties; this does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "decimal(38,0)"


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def as_units(value, scale: int) -> Column:
    """Exact decimal -> integer count of 10**-scale units (e.g. pence)."""
    return (_c(value) * F.lit(10**scale)).cast(_WIDE)


def round_div(num, den, digits: int) -> Column:
    """round(num / den, digits), half away from zero, as a double.

    ``num`` and ``den`` must be whole numbers (any integral or scale-0 decimal
    expression).  NULL when ``den`` is 0 or NULL, like ``x / NULLIF(den, 0)``.
    """
    n = _c(num).cast(_WIDE)
    d = _c(den).cast(_WIDE)
    units = floor_div(F.abs(n) * F.lit(2 * 10**digits) + F.abs(d), F.abs(d) * F.lit(2))
    signed = units * F.signum(n).cast("int") * F.signum(d).cast("int")
    return F.when(d == 0, F.lit(None).cast("double")).otherwise(
        signed.cast("double") / F.lit(float(10**digits))
    )


def floor_div(a, b) -> Column:
    """Exact floor(a / b) for non-negative whole decimals (no 64-bit limit).

    ``a - a % b`` is an exact multiple of ``b``, so the decimal quotient has
    no rounding; it is cast back to a whole ``decimal(38,0)``.
    """
    a, b = _c(a).cast(_WIDE), _c(b).cast(_WIDE)
    return ((a - a % b) / b).cast(_WIDE)


def pct(num, den, digits: int) -> Column:
    """round(100 * num / den, digits) on whole numbers."""
    return round_div(_c(num).cast(_WIDE) * F.lit(100), den, digits)


def money(value) -> Column:
    """An exact decimal amount (already at 2 places) as the output double."""
    return F.round(_c(value), 2).cast("double")


def avg_money(total, count) -> Column:
    """round(total / count, 2) for a decimal money total and a row count."""
    return round_div(as_units(total, 2), _c(count).cast(_WIDE) * F.lit(100), 2)


def avg_round(total, count, digits: int, scale: int = 0) -> Column:
    """round(total / count, digits) where total is exact at ``scale`` decimals."""
    return round_div(as_units(total, scale), _c(count).cast(_WIDE) * F.lit(10**scale), digits)


def round_exact(value, digits: int) -> Column:
    """Round an exact decimal half away from zero and return a double."""
    return F.round(_c(value).cast("decimal(38,6)"), digits).cast("double")


def day_diff(end, start) -> Column:
    """Whole days from ``start`` to ``end`` (dates), as bigint."""
    return F.datediff(_c(end), _c(start)).cast("bigint")
