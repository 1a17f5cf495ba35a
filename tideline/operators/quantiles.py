"""Exact ranks and quantiles without sorting a group in one task or collecting it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.ranking import BUCKET_ROWS, bucket_bounds, running_total
from tideline.session import durable


def lower_rank(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, int | tuple[int, int]], per: int = 1000, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per key the value of rank ``((n - 1) * k) div per`` for each named k, from zero; a pair (k, c) stands for ``((n - 1) * k + c) div per``.

    Equal values are counted once and weighted, so a value that fills a third of a
    group is one row; ranks come from bucketed running totals. Nulls are passed over.
    """
    c = durable(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__w")), "counts")
    r = running_total(c, keys, value, "__to", bucket_bounds(c, list(keys), value, bucket_rows), weight=F.col("__w"))
    n = c.groupBy(*keys).agg(F.sum("__w").alias("__n"))
    j = r.join(n, list(keys))
    at = lambda k: F.expr("((__n - 1) * {} + {}) div {}".format(*(k if isinstance(k, tuple) else (k, 0)), per))
    hit = lambda k: (F.col("__to") - F.col("__w") <= at(k)) & (at(k) < F.col("__to"))
    return j.groupBy(*keys).agg(F.max("__n").alias("n"), *(F.max(F.when(hit(k), F.col(value))).alias(name) for name, k in shares.items()))


def cume_share(df: DataFrame, keys: Sequence[str], value: str, out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Distinct values of a key with the share of rows not above them, in ppm, floored."""
    c = durable(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__w")), "counts")
    r = running_total(c, keys, value, "__to", bucket_bounds(c, list(keys), value, bucket_rows), weight=F.col("__w"))
    n = c.groupBy(*keys).agg(F.sum("__w").alias("__n"))
    return r.join(n, list(keys)).select(*keys, value, F.expr("__to * 1000000 div __n").alias(out))
