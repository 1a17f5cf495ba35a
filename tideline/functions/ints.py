"""Exact integer arithmetic on columns.

Money and ratios are bigints (ticks, parts per million). Products are formed in
decimal(38,0); results come back as bigint. A null operand gives null; so does
a zero divisor. Four roundings are kept apart by name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

PPM = 1_000_000
WIDE = "decimal(38,0)"
ROOT_LIMIT = (2**62) ** 2  # the Newton step adds two numbers of the root's size
LIMB = 10**11  # squares are summed by parts of this size


def _c(x: Column | str | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def wide(x: Column | str | int) -> Column:
    return _c(x).cast(WIDE)


def big(x: int) -> Column:
    """A literal of up to 38 digits."""
    return F.lit(str(x)).cast(WIDE)


def _div(n: Column, d: Column) -> Column:
    """Truncating division of wide integers, null for a zero divisor."""
    safe = F.when(d != 0, d)
    return F.call_function("div", n, safe)


def trunc_div(n: Column | str | int, d: Column | str | int) -> Column:
    """Quotient toward zero."""
    return _div(wide(n), wide(d))


def wide_div(n: Column | str | int, d: Column | str | int) -> Column:
    """Quotient toward zero as a wide integer of up to 32 digits; ``div`` itself ends at 64 bits."""
    a, b = wide(n), wide(d)
    safe = F.when(b != 0, b)
    return ((a - a % safe) / safe).cast(WIDE)


def floor_div(n: Column | str | int, d: Column | str | int) -> Column:
    """Quotient toward minus infinity."""
    a, b = wide(n), wide(d)
    q = _div(a, b)
    return q - F.when((a % F.when(b != 0, b) != 0) & ((a < 0) != (b < 0)), 1).otherwise(0)


def half_away_div(n: Column | str | int, d: Column | str | int) -> Column:
    """Nearest quotient, halves away from zero; the divisor is taken by its sign too."""
    a, b = wide(n), wide(d)
    q = _div(F.abs(a) * 2 + F.abs(b), F.abs(b) * 2)
    return F.when((a < 0) != (b < 0), -q).otherwise(q)


def wide_half_away_div(n: Column | str | int, d: Column | str | int) -> Column:
    """``half_away_div`` as a wide integer of up to 32 digits."""
    a, b = wide(n), wide(d)
    q = wide_div(F.abs(a) * 2 + F.abs(b), F.abs(b) * 2)
    return F.when((a < 0) != (b < 0), -q).otherwise(q)


def half_even_div(n: Column | str | int, d: Column | str | int) -> Column:
    """Nearest quotient, halves to the even one."""
    a, b = wide(n), wide(d)

    def settle(q: Column) -> Column:
        twice = (a - q * b) * 2
        up = (F.abs(twice) > F.abs(b)) | ((F.abs(twice) == F.abs(b)) & (q % 2 != 0))
        return (q + F.when(up, 1).otherwise(0)).cast("long")

    return let(floor_div(a, b), settle)


def exact_div(n: Column | str | int, d: Column | str | int) -> Column:
    """Quotient where the division leaves no remainder, else null."""
    a, b = wide(n), wide(d)
    return F.when(a % F.when(b != 0, b) == 0, _div(a, b))


def mul_div(v: Column | str | int, m: Column | str | int, d: Column | str | int) -> Column:
    """v * m / d toward zero, the product held wide."""
    return _div(wide(v) * wide(m), wide(d))


def return_ppm(current: Column | str, prior: Column | str) -> Column:
    """(current - prior) / prior in ppm, halves away from zero."""
    c, p = wide(current), wide(prior)
    return half_away_div((c - p) * PPM, p)


def wide_return_ppm(current: Column | str, prior: Column | str) -> Column:
    """``return_ppm`` as a wide integer: that of two bigints may be beyond 64 bits."""
    c, p = wide(current), wide(prior)
    return wide_half_away_div((c - p) * PPM, p)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; an expression used n times would otherwise be copied n times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def isqrt(x: Column | str) -> Column:
    """Floor of the square root of a wide non-negative integer, exact: a double guess, one Newton step, a step either way. Negative values and roots beyond 64 bits give null."""

    def settle(v: Column, g: Column) -> Column:
        down = F.when(g * g > v, g - 1).otherwise(g)
        return F.when((g + 1) * (g + 1) <= v, g + 1).otherwise(down).cast("long")

    def newton(v: Column) -> Column:
        guess = F.floor(F.sqrt(v.cast("double"))).cast(WIDE)
        return let(guess, lambda g: let(F.when(g > 0, _div(g + _div(v, g), F.lit(2).cast(WIDE))).otherwise(g.cast("long")).cast("decimal(19,0)"), lambda h: settle(v, h)))

    return let(wide(x), lambda v: F.when((v >= 0) & (v <= big(ROOT_LIMIT)), newton(v)))


def square_sums(x: Column | str) -> list[Column]:
    """Aggregates of integers of up to 22 digits, of which ``squares_total`` makes the sum of squares; that itself outgrows decimal(38,0)."""
    hi, lo = wide(trunc_div(x, LIMB)), wide(x) % big(LIMB)
    return [F.sum(hi * hi).alias("hi_hi"), F.sum(hi * lo).alias("hi_lo"), F.sum(lo * lo).alias("lo_lo")]


def squares_total(hi_hi: Decimal | None, hi_lo: Decimal | None, lo_lo: Decimal | None) -> int:
    """The sum of squares as a Python integer, 0 for no rows."""
    return int(hi_hi or 0) * LIMB**2 + int(hi_lo or 0) * 2 * LIMB + int(lo_lo or 0)


def fits_long(x: int) -> bool:
    return -(2**63) <= x < 2**63


def zscore_ppm(x: Column | str, n: int, total: int, squares: int, bounds: tuple[int, int]) -> Column:
    """(x*n - sum) in ppm of isqrt(n * sum of squares - sum^2), halves away; zero spread gives 0, no rows null.

    The statistics are Python integers, as their products outgrow 128 bits. ``bounds``
    are the least and largest x: the score is a bigint if theirs fit one, else decimal(38,0).
    """
    spread = math.isqrt(n * squares - total * total)
    if n == 0 or spread == 0:
        return F.when(_c(x).isNotNull() & F.lit(n > 0), F.lit(0).cast("long"))
    top = (wide(x) * big(n) - big(total)) * PPM
    narrow = all(fits_long((abs(b * n - total) * PPM * 2 + spread) // (spread * 2)) for b in bounds)
    return (half_away_div if narrow else wide_half_away_div)(top, big(spread))


def clamp(x: Column | str, lo: int, hi: int) -> Column:
    return F.greatest(F.lit(lo).cast("long"), F.least(F.lit(hi).cast("long"), _c(x)))


@F.pandas_udf(LongType())
def gcd(a: pd.Series, b: pd.Series) -> pd.Series:
    """Greatest common divisor of two bigints; null for a null. There is no built-in, and a fold of Euclid's steps per row is slower than an Arrow batch."""
    known = a.notna() & b.notna()
    out = pd.Series(np.gcd(a.where(known, 0).astype("int64"), b.where(known, 0).astype("int64")), dtype="Int64")
    return out.where(known.to_numpy())


@F.pandas_udf(StructType([StructField("num", LongType()), StructField("den", LongType())]))
def ratio_times(num_a: pd.Series, den_a: pd.Series, num_b: pd.Series, den_b: pd.Series) -> pd.DataFrame:
    """Product of two fractions of bigints in lowest terms, with a denominator above zero.

    Each fraction is reduced, then they are cancelled crosswise, so that the parts stay
    as small as the result. Null for a null, a zero denominator, or a part beyond 64 bits.
    """
    known = (num_a.notna() & den_a.notna() & num_b.notna() & den_b.notna()).to_numpy()
    a, b, c, d = (x.where(known, 1).astype("int64").to_numpy() for x in (num_a, den_a, num_b, den_b))
    known &= (b != 0) & (d != 0)
    b, d = np.where(b == 0, 1, b), np.where(d == 0, 1, d)
    for _ in range(2):  # each on its own, then crosswise
        g, h = np.gcd(a, b), np.gcd(c, d)
        a, b, c, d = a // g, b // g, c // h, d // h
        b, d = d, b
    known &= (np.abs(a.astype(float) * c) < 2.0**62) & (np.abs(b.astype(float) * d) < 2.0**62)
    with np.errstate(over="ignore"):
        num, den = a * c, b * d
    num, den = np.where(den < 0, -num, num), np.abs(den)
    return pd.DataFrame({"num": pd.Series(num, dtype="Int64").where(known), "den": pd.Series(den, dtype="Int64").where(known)})


#: exp-like table of the fixed-point logistic: its value in ppm at -8 .. 8 in steps of one.
SIGMOID_PPM = [round(1_000_000 / (1 + Decimal(-x).exp())) for x in range(-8, 9)]


def sigmoid_ppm(score_ppm: Column | str) -> Column:
    """Logistic of a score in ppm, linear between whole scores, floored; clamped at +-8."""
    s = clamp(score_ppm, -8 * PPM, 8 * PPM) + 8 * PPM
    i = F.least(F.lit(15), F.call_function("div", s, F.lit(PPM).cast("long")).cast("int"))
    table = F.array(*(F.lit(x).cast("long") for x in SIGMOID_PPM))
    lo, hi = F.element_at(table, i + 1), F.element_at(table, i + 2)
    return lo + floor_div((hi - lo) * (s - i.cast("long") * PPM), PPM)


def step_lookup(x: Column | str, thresholds: list[int], values: list[int]) -> Column:
    """The value of the first threshold that is at least x; the last value beyond all."""
    out = F.lit(values[-1]).cast("long")
    for t, v in reversed(list(zip(thresholds, values))):
        out = F.when(_c(x) <= t, F.lit(v).cast("long")).otherwise(out)
    return out


def micro_units(text: Column | str) -> Column:
    """Decimal text to millionths, halves away; a lone point means missing and unreadable text is null."""
    v = F.trim(_c(text))
    return F.when(v != ".", F.round(v.try_cast("decimal(32,12)") * PPM, 0).cast("long"))
