"""Merging of half-open intervals into periods and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.ranking import BUCKET_ROWS, bucket_bounds, running_total
from tideline.session import durable


def coverage_spans(
    df: DataFrame, keys: Sequence[str], start: str = "start_time_ns", end: str = "end_time_ns", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Continuous periods (``covered``) and the gaps between them, per key.

    Starts and ends are ranked independently; a gap lies between the i-th end and
    the (i+1)-th start where that start is the greater. What remains are the
    boundaries of the periods: the k-th remaining start pairs with the k-th
    remaining end. Ranks come from ``running_total``, so no key is sorted in one
    task, and start and end meet by a hash of (key, rank).

    Rows with a null key, start or end, or with end not after start, are ignored.
    Touching intervals merge. Repeated rows count once. An empty input gives no
    rows. Other columns, whatever their names, are dropped.

    Returns: keys, span_type, start, end.
    """
    k = [f"k{i}" for i in range(len(keys))]
    valid = (
        df.select(*(F.col(c).alias(a) for c, a in zip(keys, k)), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
        .where(F.col("e") > F.col("s"))
        .dropna()
        .distinct()
    )
    points = valid.select(*k, F.inline(F.array(F.struct(F.lit(True).alias("is_start"), F.col("s").alias("t")), F.struct(F.lit(False).alias("is_start"), F.col("e").alias("t")))))
    side = [*k, "is_start"]
    bounds = bucket_bounds(points, side, "t", bucket_rows)
    ranked = running_total(points, side, "t", "r", bounds)
    pairs = ranked.groupBy(*k, F.when(F.col("is_start"), F.col("r") - 1).otherwise(F.col("r")).alias("i")).agg(
        F.max(F.when(F.col("is_start"), F.col("t"))).alias("next_start"), F.max(F.when(~F.col("is_start"), F.col("t"))).alias("prev_end")
    )
    #: i = 0 has no end before it, i = n no start after it: the outer boundaries.
    edges = durable(pairs.where(F.col("prev_end").isNull() | F.col("next_start").isNull() | (F.col("next_start") > F.col("prev_end"))), "edges")
    gaps = edges.where(F.col("prev_end").isNotNull() & F.col("next_start").isNotNull()).select(
        *k, F.lit("gap").alias("span_type"), F.col("prev_end").alias("a"), F.col("next_start").alias("b")
    )
    ends = edges.select(
        *k, F.inline(F.array(F.struct(F.lit(True).alias("is_start"), F.col("next_start").alias("t")), F.struct(F.lit(False).alias("is_start"), F.col("prev_end").alias("t"))))
    ).where(F.col("t").isNotNull())
    periods = (
        running_total(ends, side, "t", "r", bounds)
        .groupBy(*k, "r")
        .agg(F.max(F.when(F.col("is_start"), F.col("t"))).alias("a"), F.max(F.when(~F.col("is_start"), F.col("t"))).alias("b"))
        .select(*k, F.lit("covered").alias("span_type"), "a", "b")
    )
    return periods.unionByName(gaps).select(*(F.col(a).alias(c) for c, a in zip(keys, k)), "span_type", F.col("a").alias(start), F.col("b").alias(end))
