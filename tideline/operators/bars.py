"""Raw bars to canonical minutes, and minutes to features.

All groups are bounded by a session (a day's minutes of one symbol on one market);
rankings and frames never cross one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.hashing import hash_bucket
from tideline.functions.ints import half_away_div, isqrt, return_ppm, wide
from tideline.functions.times import MINUTE, rfc3339_ns
from tideline.session import durable

SERIES = ["symbol", "market_id", "session_id"]
BUCKETS = 8


def ticks(price: Column | str, per_unit: int = 100) -> Column:
    """A price in whole ticks; null where it lies between two.

    Exact: a double is a whole number of ticks if it is the double nearest to that
    number over ``per_unit``, which is what the division gives. Null, NaN, and prices of
    1e15 ticks or more give null.
    """
    p = F.col(price) if isinstance(price, str) else price
    whole = F.rint(p * per_unit)
    return F.when((F.abs(whole) < 1e15) & (whole / per_unit == p), whole.cast("long"))


def canonicalise(raw: DataFrame) -> DataFrame:
    """Each raw bar with its minute in ns, prices in ticks, a state and its reasons.

    Reasons, in order: TIME (unreadable or off the minute), NULL_VALUE,
    INEXACT_PRICE, BAD_PRICE (not above zero), BAD_RANGE (high or low inconsistent),
    BAD_VOLUME. A bar with reasons is REJECTED, none is dropped.
    """
    t = rfc3339_ns("t")
    b = raw.select("bar_id", *SERIES, t.alias("t"), *(ticks(x).alias(f"{x}_ticks") for x in "ohlc"), F.col("v").cast("long").alias("volume"), *"ohlc", "source_object_id", "local_receipt_time_ns")
    o, h, l, c = (F.col(f"{x}_ticks") for x in "ohlc")  # noqa: E741
    bad = [
        (F.col("t").isNull() | (F.col("t") % MINUTE != 0), "TIME"),
        (F.col("o").isNull() | F.col("h").isNull() | F.col("l").isNull() | F.col("c").isNull() | F.col("volume").isNull(), "NULL_VALUE"),
        ((F.col("o").isNotNull() & o.isNull()) | (F.col("h").isNotNull() & h.isNull()) | (F.col("l").isNotNull() & l.isNull()) | (F.col("c").isNotNull() & c.isNull()), "INEXACT_PRICE"),
        ((o <= 0) | (h <= 0) | (l <= 0) | (c <= 0), "BAD_PRICE"),
        ((h < o) | (h < c) | (h < l) | (l > o) | (l > c), "BAD_RANGE"),
        (F.col("volume") < 0, "BAD_VOLUME"),
    ]
    return b.withColumn("reasons", F.concat_ws(",", *(F.when(cond, name) for cond, name in bad))).select(
        "bar_id",
        *SERIES,
        F.col("t").alias("minute_ns"),
        "o_ticks",
        "h_ticks",
        "l_ticks",
        "c_ticks",
        "volume",
        "source_object_id",
        "local_receipt_time_ns",
        F.when(F.col("reasons") != "", "REJECTED").otherwise("VALID").alias("state"),
        "reasons",
        hash_bucket(F.concat_ws("|", "symbol", "market_id"), BUCKETS).alias("bucket"),
    )


def canonical_minutes(raw: DataFrame) -> DataFrame:
    """One valid row per series and minute: copies fall together, the smallest bar_id stands for them."""
    needed = raw.select("bar_id", *SERIES, "t", *"ohlc", "v", "source_object_id", "local_receipt_time_ns")
    #: One shuffle by series serves the choice among copies and all later frames of a series.
    bars = canonicalise(needed.repartition(*SERIES))
    #: Valid copies rank first, so the filter can stay above the window: pushed below, it would work out all reasons twice.
    w = Window.partitionBy(*SERIES, "minute_ns").orderBy(F.col("reasons") != "", "bar_id")
    kept = bars.withColumn("rn", F.row_number().over(w)).where("rn = 1 and reasons = ''")
    return kept.select(*SERIES, "minute_ns", "bar_id", "o_ticks", "h_ticks", "l_ticks", "c_ticks", "volume", "local_receipt_time_ns", "bucket", F.expr(f"minute_ns div {MINUTE}").alias("m"))


def by_minute() -> Window:
    return Window.partitionBy(*SERIES).orderBy("m")


def offset_close(k: int) -> Column:
    """Close of the minute exactly k before, null if that minute is missing."""
    return F.max("c_ticks").over(by_minute().rangeBetween(-k, -k))


def offset_return(k: int) -> Column:
    """Return in ppm against the minute exactly k before, null if that minute is missing."""
    return return_ppm("c_ticks", offset_close(k))


def with_islands(minutes: DataFrame) -> DataFrame:
    """``island``: number of the unbroken run of minutes in its series."""
    w = by_minute()
    new = F.when(F.col("m") - F.lag("m").over(w) == 1, 0).otherwise(1)
    return minutes.withColumn("__new", new).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def relative_volume(minutes: DataFrame, rows: int = 20) -> DataFrame:
    """Volume in ppm of the mean over up to ``rows`` minutes before, which end at the first missing one."""
    w = Window.partitionBy(*SERIES, "island").orderBy("m").rowsBetween(-rows, -1)
    d = with_islands(minutes).withColumn("n", F.count("volume").over(w)).withColumn("mean", half_away_div(F.sum("volume").over(w), F.col("n")))
    return d.withColumn("relative_volume_ppm", F.when(F.col("mean") > 0, half_away_div(wide("volume") * 1_000_000, "mean")))


def realised_volatility(minutes: DataFrame, rows: int = 30) -> DataFrame:
    """isqrt of the rounded mean square of one-minute returns over up to ``rows`` unbroken minutes."""
    island = Window.partitionBy(*SERIES, "island").orderBy("m")
    d = with_islands(minutes).withColumn("r", return_ppm("c_ticks", F.lag("c_ticks").over(island)))
    w = island.rowsBetween(-(rows - 1), 0)
    n, squares = F.count("r").over(w), F.sum(wide("r") * wide("r")).over(w)
    return d.withColumn("n", n).withColumn("volatility_ppm", F.when(F.col("n") > 0, isqrt(half_away_div(squares, F.col("n")))))


def session_bars(minutes: DataFrame) -> DataFrame:
    """Session open, high, low, close, volume and minute count of each series."""
    return minutes.groupBy(*SERIES).agg(
        F.min_by("o_ticks", "m").alias("open_ticks"),
        F.max("h_ticks").alias("high_ticks"),
        F.min("l_ticks").alias("low_ticks"),
        F.max_by("c_ticks", "m").alias("close_ticks"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("minutes"),
        F.min("minute_ns").alias("first_ns"),
        F.max("minute_ns").alias("last_ns"),
    )


def previous_sessions_mean(sessions: DataFrame, n: int = 5) -> DataFrame:
    """Mean open-to-close return of the ``n`` observed sessions before, null until there are n."""
    w = Window.partitionBy("symbol", "market_id").orderBy("first_ns")
    d = sessions.withColumn("r", return_ppm("close_ticks", "open_ticks"))
    back = w.rowsBetween(-n, -1)
    return d.withColumn("mean_ppm", F.when(F.count("r").over(back) == n, half_away_div(F.sum("r").over(back), F.lit(n))))


def market_relative(minutes: DataFrame, group: list[str]) -> DataFrame:
    """One-minute return against the equal-weight mean of its minute (and ``group``).

    The mean is used only where all its contributors had arrived by the row's own
    receipt, else the result is null with state LATE_CONTRIBUTOR. The aggregate is
    one row per minute and group, joined back; no group is collected.
    """
    d = durable(minutes.withColumn("r", offset_return(1)).where("r is not null").select("bar_id", "m", *group, "r", "local_receipt_time_ns"), "returns")
    agg = d.groupBy("m", *group).agg(F.sum("r").alias("s"), F.count("r").alias("n"), F.max("local_receipt_time_ns").alias("latest"))
    j = d.join(agg, ["m", *group])
    ready = F.col("latest") <= F.col("local_receipt_time_ns")
    return j.select("bar_id", "m", *group, "r", "n", F.when(ready, F.col("r") - half_away_div("s", "n")).alias("relative_ppm"), F.when(ready, "VALID").otherwise("LATE_CONTRIBUTOR").alias("state"))


def split_plan(sessions: DataFrame, order: str, train: int = 70, validation: int = 15, purge: int = 2) -> DataFrame:
    """Sessions in order, cut into TRAIN, VALIDATION and TEST with ``purge`` sessions dropped at each border.

    Shares are per cent of the sessions left after both purges. The list of
    sessions is small (one row per trading day).
    """
    n = F.count(F.lit(1)).over(Window.partitionBy())
    i = F.row_number().over(Window.orderBy(order))
    d = sessions.withColumn("i", i).withColumn("usable", n - 2 * purge)
    d = d.withColumn("a", F.expr(f"usable * {train} div 100")).withColumn("b", F.expr(f"usable * {validation} div 100"))
    x = F.col("i")
    split = (
        F.when(x <= F.col("a"), "TRAIN")
        .when(x <= F.col("a") + purge, "PURGE")
        .when(x <= F.col("a") + purge + F.col("b"), "VALIDATION")
        .when(x <= F.col("a") + 2 * purge + F.col("b"), "PURGE")
        .otherwise("TEST")
    )
    return d.withColumn("split", split).drop("i", "usable", "a", "b")


def horizon_labels(minutes: DataFrame, horizons: list[int], keep: Sequence[str] = ()) -> DataFrame:
    """Label of each bar and horizon (minutes ahead): VALID, MISSING (no bar there) or INVALID (another session), with return and direction.

    One range frame per horizon instead of a self-join: no shuffle beyond the
    series' own. The bar beyond the session's last minute is INVALID, a hole inside MISSING.
    """
    w = by_minute()
    last = F.max("m").over(Window.partitionBy(*SERIES))
    d = minutes.withColumn("last_m", last)
    for h in horizons:
        d = d.withColumn(f"p{h}", F.max("c_ticks").over(w.rangeBetween(h, h)))
    label = F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"p{h}").alias("future_ticks")) for h in horizons))
    e = d.select("bar_id", *keep, "m", "last_m", "c_ticks", F.inline(label))
    validity = F.when(F.col("m") + F.col("horizon") > F.col("last_m"), "INVALID").when(F.col("future_ticks").isNull(), "MISSING").otherwise("VALID")
    e = e.withColumn("validity", validity).withColumn("return_ppm", F.when(F.col("validity") == "VALID", return_ppm("future_ticks", "c_ticks")))
    return e.select("bar_id", *keep, "horizon", "validity", "future_ticks", "return_ppm", F.when(F.col("return_ppm") > 0, 1).when(F.col("return_ppm") < 0, -1).when(F.col("return_ppm") == 0, 0).alias("direction"))
