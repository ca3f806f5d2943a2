"""Exact decimal ratios rounded half away from zero.

``CAST(a * 100.0 / b AS DECIMAL(5,2))`` is computed as integer hundredths:

    h = sign(a*b) * floor((2*|a|*K + |b|) / (2*|b|)),   K = multiplier * 10**scale

without any intermediate rounding (Spark's own decimal division keeps only six
fractional digits before the final cast, which can round twice). Numbers whose
hundredths and products fit a BIGINT, that is ``|a|, |b| < 10**12`` and
``K <= 10**4``, take an all-BIGINT path inside generated code; wider ones take
DECIMAL(38) arithmetic, where the floor of a non-negative exact quotient is
``(x - pmod(x, y)) / y``, whose division is exact. Both give the same value.

A mean of per-row ratios is accumulated in fixed point (``percent_digits``):
each ratio is cut to ten digits after the point by two BIGINT divisions, and
integers add up to the same total in every order.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORK = "decimal(38,2)"
# Bound of the BIGINT path, and the type whose hundredths are a cheap BIGINT cast.
NARROW = 10 ** 12
_NARROW_TYPE = "decimal(14,2)"
# Ten digits of a percentage: four with the whole part, six more.
HEAD, TAIL = 10 ** 6, 10 ** 6


def _floor_div(x: Column, y: Column) -> Column:
    """Exact floor of x / y for DECIMAL(38) operands, x >= 0."""
    return ((x - F.pmod(x, y)) / y).cast("decimal(38,0)")


def int_div(x: Column, y: Column) -> Column:
    """BIGINT division that drops the remainder (NULL for a NULL operand)."""
    return F.call_function("div", x, y)


def cents(c: Column) -> Column:
    """Hundredths of a DECIMAL(p <= 14, 2) as BIGINT."""
    return (c * F.lit(Decimal(100))).cast("bigint")


def half_up_ratio(num: Column, den: Column, multiplier: int = 1, scale: int = 2,
                  precision: int = 38) -> Column:
    """round_half_up(num * multiplier / den, scale) as DECIMAL(precision, scale).

    NULL when ``den`` is NULL or zero (the reference's ``NULLIF(den, 0)``);
    callers keep the reference's own guards (``CASE WHEN den > 0 ...``).
    """
    k = multiplier * 10 ** scale
    out = f"decimal({precision},{scale})"
    unit = F.lit(Decimal(1).scaleb(-scale))

    n, d = num.cast(_WORK), den.cast(_WORK)
    divisor = F.when(d != 0, F.abs(d) * F.lit(2))  # NULL, never a division by zero
    h = _floor_div(F.abs(n) * F.lit(2 * k) + F.abs(d), divisor)
    wide = F.when(d != 0, (F.when((n < 0) != (d < 0), -h).otherwise(h) * unit).cast(out))
    if k > 10 ** 4:
        return wide

    a, b = cents(num.cast(_NARROW_TYPE)), cents(den.cast(_NARROW_TYPE))
    q = int_div(F.abs(a) * F.lit(2 * k) + F.abs(b), F.abs(b) * F.lit(2))
    signed = F.when((a < 0) != (b < 0), -q).otherwise(q)
    in_range = (num > -NARROW) & (num < NARROW) & (den > -NARROW) & (den < NARROW)
    narrow = (signed.cast("decimal(20,0)") * unit).cast(out)
    return F.when(in_range & (den != 0), narrow).otherwise(wide)


def percent_digits(num: Column, den: Column) -> tuple[Column, Column]:
    """``num * 100 / den`` cut to ten digits after the point, as two BIGINTs:
    (digits up to the fourth after the point, the six that follow); NULL for a
    NULL or zero ``den``. For DECIMAL(p <= 14, 2) of magnitude under 4 * 10**10."""
    d = F.when(den != 0, cents(den))
    n = cents(num) * F.lit(HEAD)
    return int_div(n, d), int_div((n % d) * F.lit(TAIL), d)


def mean_percent(head: Column, tail: Column, count: Column, precision: int = 10) -> Column:
    """The mean, half up to cents, of ``count`` ratios whose digits sum up to ``head`` and ``tail``."""
    total = head.cast("decimal(38,0)") * F.lit(Decimal(TAIL)) + tail.cast("decimal(38,0)")
    mean = half_up_ratio(total.cast("decimal(36,0)"), (count.cast("decimal(20,0)") * F.lit(Decimal(HEAD // 100 * TAIL))).cast("decimal(32,0)"))
    return mean.cast(f"decimal({precision},2)")
