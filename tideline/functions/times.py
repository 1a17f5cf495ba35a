"""Date and time columns; instants are bigint nanoseconds since 1970 UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1_000_000_000, 60_000_000_000, 3_600_000_000_000, 86_400_000_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rfc3339_ns(value: Column | str) -> Column:
    """RFC 3339 text to nanoseconds, up to nine fractional digits and any offset; null where it can't be read."""
    v = F.upper(F.trim(_col(value)))
    whole = F.try_to_timestamp(F.regexp_replace(v, r"\.[0-9]+", ""))
    fraction = F.rpad(F.regexp_extract(v, r"\.([0-9]{1,9})", 1), 9, "0")
    return F.unix_seconds(whole) * F.lit(SECOND) + fraction.cast("long")


def instant_ns(value: Column | str) -> Column:
    """An instant given in s, ms, us or ns, told apart by magnitude, in ns.

    Between the years 1973 and 2262 the four units don't overlap: below 1e11
    seconds, below 1e14 milliseconds, below 1e17 microseconds. Null stays null;
    negative values are read by their absolute size.
    """
    v = _col(value).cast("long")
    a = F.abs(v)
    return F.when(a < 10**11, v * SECOND).when(a < 10**14, v * 1_000_000).when(a < 10**17, v * 1_000).otherwise(v)


def floor_to(value: Column | str, step: int) -> Column:
    """The start of the step that holds the instant, also before 1970."""
    v = _col(value)
    return v - F.pmod(v, F.lit(step))
