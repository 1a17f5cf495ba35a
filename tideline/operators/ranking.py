"""Order-based numbering that splits hot keys.

``row_number() over (partition by key order by t)`` sorts a whole key in one
task. Here a key with more rows than a task should take is cut at quantiles of its
own order, each bucket is numbered on its own, and the buckets' totals, a small table,
give each bucket its offset. The result equals the plain window's. Quantiles are
drawn per key, so neither a stray value far off nor a dense stretch fills one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import durable

#: Rows that a bucket of a hot key holds about; and the most buckets of all keys together, which bounds what is broadcast.
BUCKET_ROWS = 200_000
BUCKETS = 100_000
#: Sampled rows per bucket, from which its bounds are taken.
SAMPLED = 64
_COARSE = 256


def _same(keys: Sequence[str], prefix: str) -> Column:
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"{prefix}{i}"))
    return cond


def bucket_bounds(df: DataFrame, keys: Sequence[str], order: str, target: int = BUCKET_ROWS) -> DataFrame | None:
    """For each key with more than ``target`` rows the values of ``order`` at which it is cut; None where there is no such key.

    One small aggregate; two numbers reach the driver. The cuts come from a sample
    by a hash of the row, so they are the same however often they are worked out. They
    are at most ``BUCKETS`` numbers: of N rows in all, a bucket is let to hold
    N / ``BUCKETS`` rows if that is more than ``target``. Rows that are equal in
    ``order`` can't be parted.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total, most = counts.agg(F.sum("__n"), F.max("__n")).first()
    if most is None or most <= target:
        return None
    target = max(target, -(-total // BUCKETS))
    hot = counts.where(F.col("__n") > target).select(*(F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)))
    step = max(1, target // SAMPLED)
    drawn = df.where(F.pmod(F.xxhash64(*df.columns), F.lit(step)) == 0).join(F.broadcast(hot), _same(keys, "__h"), "left_semi")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    #: Every so many sampled rows a cut; of a key's cuts there are its rows by ``target``.
    cuts = drawn.select(*keys, F.col(order).alias("__o"), place.alias("__p")).where(F.col("__p") % max(1, target // step) == 0)
    out = cuts.groupBy(*(F.col(k).alias(f"__h{i}") for i, k in enumerate(keys))).agg(F.array_sort(F.collect_set("__o")).alias("__bounds"))
    return durable(out, "bounds")


def with_bucket(df: DataFrame, keys: Sequence[str], order: str, bounds: DataFrame | None, name: str = "__b") -> DataFrame:
    """The rows with their key's bucket in ``order``: how many of the key's cuts are not above the row's value; 0 for keys that aren't cut."""
    if bounds is None:
        return df.withColumn(name, F.lit(0))
    coarse = F.transform(F.sequence(F.lit(0), F.expr(f"(size(__bounds) - 1) div {_COARSE}").cast("int")), lambda i: F.element_at("__bounds", i * _COARSE + 1))
    small = F.broadcast(bounds.withColumn("__coarse", coarse))
    j = df.join(small, _same(keys, "__h"), "left")
    x = F.col(order)
    c = F.size(F.filter("__coarse", lambda b: b <= x))
    fine = F.size(F.filter(F.slice("__bounds", (F.greatest(c, F.lit(1)) - 1) * _COARSE + 1, _COARSE), lambda b: b <= x))
    found = F.when(F.col("__bounds").isNull() | (c == 0), 0).otherwise((c - 1) * _COARSE + fine)
    return j.select(*df.columns, found.alias(name))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    out: str,
    bounds: DataFrame | None,
    weight: Column | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sum of ``weight`` (default 1: the row's rank) per key in the order of ``order``, ``ties``.

    ``order`` must be a non-null integer column. Null keys form one key each.
    Rows equal in all of ``order`` and ``ties`` get some order among themselves.
    Without ``bounds`` (no key is hot) it is the plain window.
    """
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    names = [c for c in df.columns if c != out]
    if bounds is None:
        spec = Window.partitionBy(*keys).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*names, F.sum(w).over(spec).alias(out))
    b = with_bucket(df.withColumn("__w", w), keys, order, bounds)
    spec = Window.partitionBy(*keys, "__b").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    inner = b.withColumn("__in", F.sum("__w").over(spec))
    totals = b.groupBy(*keys, "__b").agg(F.sum("__w").alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    #: Only buckets after a key's first one have something before them: at most ``BUCKETS`` rows.
    offsets = totals.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__b").alias("__bb"), F.sum("__t").over(before).alias("__off")).where("__bb > 0")
    joined = inner.join(F.broadcast(offsets), _same(keys, "__k") & (F.col("__b") == F.col("__bb")), "left")
    return joined.select(*names, (F.col("__in") + F.coalesce("__off", F.lit(0))).alias(out))


def max_before(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, bounds: DataFrame | None, ties: Sequence[str] = ()) -> DataFrame:
    """The greatest ``value`` of the key's rows before this one in the order of ``order``, ``ties``; null for the first. Hot keys are split by ``bounds``."""
    names = [c for c in df.columns if c != out]
    prior = lambda *k: Window.partitionBy(*k).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    if bounds is None:
        return df.select(*names, F.max(value).over(prior(*keys)).alias(out))
    b = with_bucket(df, keys, order, bounds)
    inner = b.withColumn("__in", F.max(value).over(prior(*keys, "__b")))
    tops = b.groupBy(*keys, "__b").agg(F.max(value).alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    small = tops.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__b").alias("__bb"), F.max("__t").over(before).alias("__off")).where("__bb > 0")
    joined = inner.join(F.broadcast(small), _same(keys, "__k") & (F.col("__b") == F.col("__bb")), "left")
    return joined.select(*names, F.greatest("__in", "__off").alias(out))


def next_in_order(df: DataFrame, keys: Sequence[str], order: str, out: str, bounds: DataFrame | None) -> DataFrame:
    """The key's next value of ``order`` after this row's in sorted order (equal for a tie); null for the last. Hot keys are split by ``bounds``."""
    names = [c for c in df.columns if c != out]
    if bounds is None:
        return df.select(*names, F.lead(order).over(Window.partitionBy(*keys).orderBy(order)).alias(out))
    b = with_bucket(df, keys, order, bounds)
    inner = b.withColumn("__in", F.lead(order).over(Window.partitionBy(*keys, "__b").orderBy(order)))
    firsts = b.groupBy(*keys, "__b").agg(F.min(order).alias("__f"))
    small = firsts.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__b").alias("__bb"), F.lead("__f").over(Window.partitionBy(*keys).orderBy("__b")).alias("__next")).where("__next is not null")
    joined = inner.join(F.broadcast(small), _same(keys, "__k") & (F.col("__b") == F.col("__bb")), "left")
    return joined.select(*names, F.coalesce("__in", "__next").alias(out))
