"""Exact rounding and guarded arithmetic as Spark column expressions.

Rates and means over integer counts are rounded with integer arithmetic
(half away from zero, like SQL ``ROUND`` on exact values), so a result never
depends on binary floating point or on the order rows were summed in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def int_div(a, b) -> Column:
    """SQL ``a div b`` (integral division, truncating toward zero)."""
    return F.call_function("div", _c(a), _c(b))


def half_up_ratio(num, den, scale: int, mult: int = 1) -> Column:
    """``round(num * mult / den, scale)`` for integer ``num``/``den`` as DOUBLE.

    Half away from zero, exact in integer arithmetic; NULL when ``den`` is 0
    or NULL (SQL ``NULLIF`` semantics instead of an ANSI division error).
    """
    p = 10 ** scale
    n = _c(num).cast("long") * F.lit(mult * p)
    d = _c(den).cast("long")
    q = int_div(F.abs(n) * 2 + d, d * 2)
    signed = F.when(n < 0, -q).otherwise(q)
    return F.when(d == 0, F.lit(None).cast("double")).otherwise(signed.cast("double") / F.lit(float(p)))


def pct(num, den, scale: int = 2) -> Column:
    """Share of ``den`` that ``num`` is, in percent, rounded half up."""
    return half_up_ratio(num, den, scale, mult=100)


def exact_mean(total, n) -> Column:
    """Unrounded mean of integers as DOUBLE (one correctly rounded division)."""
    return F.when(_c(n) == 0, F.lit(None).cast("double")).otherwise(
        _c(total).cast("double") / _c(n).cast("double"))


def exact_stddev_pop(n, s, ss) -> Column:
    """Population standard deviation of integers from count, sum and sum of squares.

    ``sqrt((n*ss - s*s) / n^2)`` with the numerator in exact integer
    arithmetic of 38 digits (1e12 rows need 26), so the value is independent
    of summation order and does not overflow.
    """
    n_, s_, ss_ = (_c(c).cast("decimal(38,0)") for c in (n, s, ss))
    num = (n_ * ss_ - s_ * s_).cast("double")
    return F.when(n_ == 0, F.lit(None).cast("double")).otherwise(
        F.sqrt(num / (n_ * n_).cast("double")))


def sql_half_up_ratio(num: str, den: str, scale: int, mult: int = 1) -> str:
    """The same rule as :func:`half_up_ratio`, as ANSI SQL text (oracle side)."""
    p = 10 ** scale
    n = f"(CAST({num} AS BIGINT) * {mult * p})"
    d = f"CAST({den} AS BIGINT)"
    q = f"((2 * abs({n}) + {d}) // (2 * {d}))"
    return (f"(CASE WHEN {d} = 0 THEN NULL ELSE CAST(CASE WHEN {n} < 0 THEN -{q} ELSE {q} END AS DOUBLE)"
            f" / CAST({p} AS DOUBLE) END)")


def sql_pct(num: str, den: str, scale: int = 2) -> str:
    return sql_half_up_ratio(num, den, scale, mult=100)


def sql_exact_mean(total: str, n: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN NULL ELSE CAST({total} AS DOUBLE) / CAST({n} AS DOUBLE) END)"


def sql_exact_stddev_pop(n: str, s: str, ss: str) -> str:
    return (f"(CASE WHEN {n} = 0 THEN NULL ELSE sqrt(CAST(CAST({n} AS HUGEINT) * CAST({ss} AS HUGEINT)"
            f" - CAST({s} AS HUGEINT) * CAST({s} AS HUGEINT) AS DOUBLE) / CAST(CAST({n} AS HUGEINT) * CAST({n} AS HUGEINT) AS DOUBLE)) END)")
