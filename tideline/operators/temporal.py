"""Bitemporal lookups, interval joins and gap helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.ranking import BUCKET_ROWS, bucket_bounds, max_before, next_in_order


def valid_at(start: Column | str, end: Column | str, t: Column | str | int) -> Column:
    """start <= t < end, with a null end open."""
    c = lambda x: F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)
    return (c(start) <= c(t)) & (c(end).isNull() | (c(t) < c(end)))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The row of each key that is greatest in ``order``: an aggregate with map-side combine, not a window."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("x")).select(*keys, "x.*")


def as_known_at(df: DataFrame, t: int, keys: Sequence[str], keep: Sequence[str], available: str, version: str, strict: bool = False, by_availability: bool = False) -> DataFrame:
    """Latest revision per key among those available at ``t`` (before ``t`` if strict).

    Latest means the highest version; with ``by_availability`` the last to become
    available, then the highest version. The two differ where a later version
    was available earlier.
    """
    seen = df.where(F.col(available) < t if strict else F.col(available) <= t)
    order = [F.col(available), F.col(version)] if by_availability else [F.col(version)]
    return latest(seen, keys, order, keep)


def known_latest_then_effective(df: DataFrame, t: int, known: int, keys: Sequence[str], keep: Sequence[str], start: str, end: str, available: str, version: str) -> DataFrame:
    """First the latest known revision, then whether it is in force: a newer one not in force hides an older one that is."""
    return as_known_at(df, known, keys, list(dict.fromkeys([*keep, start, end])), available, version).where(valid_at(start, end, t))


def effective_then_latest(df: DataFrame, t: int, known: int, keys: Sequence[str], keep: Sequence[str], start: str, end: str, available: str, version: str) -> DataFrame:
    """Among revisions known and in force the latest."""
    return as_known_at(df.where(valid_at(start, end, t)), known, keys, keep, available, version)


def lineage_violations(df: DataFrame, keys: Sequence[str], version: str, time: str) -> DataFrame:
    """Revisions that break their key's lineage: version not the next one, or time not later than the one before."""
    w = Window.partitionBy(*keys).orderBy(version, time)
    d = df.withColumn("__n", F.row_number().over(w)).withColumn("__prev", F.lag(time).over(w))
    code = F.when(F.col(version) != F.col("__n"), "VERSION_GAP").when(F.col("__prev").isNotNull() & (F.col(time) <= F.col("__prev")), "TIME_NOT_LATER")
    return d.withColumn("violation", code).where("violation is not null").drop("__n", "__prev")


def interval_stab(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, start: str, end: str, width: int) -> DataFrame:
    """All (point, interval) pairs of a key with start <= point < end.

    A range join as an equi-join: an interval is copied to every bucket of
    ``width`` it touches, a point lies in one. Choose the width near the intervals'
    typical length; longer intervals make more copies, none is lost. Null bounds
    match nothing.
    """
    b = F.expr(f"explode(sequence(floor(`{start}` / {width}), floor((`{end}` - 1) / {width})))")
    i = intervals.where(F.col(end) > F.col(start)).withColumn("__b", b)
    p = points.withColumn("__b", F.expr(f"floor(`{point}` / {width})"))
    return p.join(i, [*keys, "__b"]).where((F.col(start) <= F.col(point)) & (F.col(point) < F.col(end))).drop("__b")


def interval_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], a: tuple[str, str], b: tuple[str, str], width: int) -> DataFrame:
    """Pairs of a key's intervals that share an instant; each pair once, in the bucket where the later of the two starts lies."""
    def spread(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.where(F.col(e) > F.col(s)).withColumn("__b", F.expr(f"explode(sequence(floor(`{s}` / {width}), floor((`{e}` - 1) / {width})))"))

    j = spread(left, *a).join(spread(right, *b), [*keys, "__b"])
    home = F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / width)
    return j.where((F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])) & (F.col("__b") == home)).drop("__b")


def tristate(covered: Column, active: Column) -> Column:
    """Null where no source looks, 0 where one looks and nothing is on, 1 where something is."""
    return F.when(covered, F.when(active, 1).otherwise(0))


def forward_asof(df: DataFrame, keys: Sequence[str], order: str, value: str, ahead: int, out: str) -> DataFrame:
    """The first non-null value at or after ``order + ahead`` of the same key.

    Rows and the instants that they ask about are sorted together, latest first, and
    the next value is carried along, so a row costs the same however long its key is.
    Of values at one instant any may be taken.
    """
    names = df.columns
    told = df.select(*keys, F.col(order).alias("__t"), F.col(value).alias("__v"), F.lit(0).alias("__asks"), F.lit(None).cast(df.select(F.struct(*names)).schema[0].dataType).alias("__row"))
    asks = df.select(*keys, (F.col(order) + ahead).alias("__t"), F.lit(None).cast(df.schema[value].dataType).alias("__v"), F.lit(1).alias("__asks"), F.struct(*names).alias("__row"))
    w = Window.partitionBy(*keys).orderBy(F.desc("__t"), "__asks").rowsBetween(Window.unboundedPreceding, 0)
    both = told.unionByName(asks).withColumn(out, F.last("__v", ignorenulls=True).over(w))
    return both.where("__asks = 1").select("__row.*", out)


def sequence_state(df: DataFrame, keys: Sequence[str], order: Sequence[str], seq: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``sequence_state`` in order of arrival: FIRST, NEXT, GAP (jumps ahead), DUPLICATE or OUT_OF_ORDER (not beyond the highest so far), and ``missing``.

    A channel with more than ``bucket_rows`` rows is cut along its arrival, and the highest number is carried over.
    """
    d = max_before(df, keys, order[0], seq, "__top", bucket_bounds(df, keys, order[0], bucket_rows), order[1:])
    s, top = F.col(seq), F.col("__top")
    state = F.when(top.isNull(), "FIRST").when(s == top + 1, "NEXT").when(s > top + 1, "GAP").when(s == top, "DUPLICATE").otherwise("OUT_OF_ORDER")
    return d.withColumn("sequence_state", state).withColumn("missing", F.when(s > top + 1, s - top - 1).otherwise(0)).drop("__top")


def missing_ranges(df: DataFrame, keys: Sequence[str], seq: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The ranges of numbers between a channel's least and greatest that never came: keys, first_missing, last_missing."""
    n = next_in_order(df.select(*keys, seq), keys, seq, "__next", bucket_bounds(df.select(*keys, seq), keys, seq, bucket_rows))
    return n.where(F.col("__next") > F.col(seq) + 1).select(*keys, (F.col(seq) + 1).alias("first_missing"), (F.col("__next") - 1).alias("last_missing"))
