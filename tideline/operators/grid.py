"""Irregular readings onto a regular grid of buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.times import MINUTE, floor_to, instant_ns


def clean_symbol(c: Column | str) -> Column:
    """Upper case, no white space around."""
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))


#: Buckets that one array holds at most.
BLOCK = 10_000


def regular_grid(readings: DataFrame, sessions: DataFrame, step_ns: int = MINUTE, max_gap: int = 5) -> DataFrame:
    """One row for each bucket of each subscribed session.

    The sequence of buckets of a session is generated from its open and close;
    readings, aggregated per symbol and bucket beforehand, are joined to it. The
    last observation is carried forward over at most ``max_gap`` buckets
    (``filled``); what is left is ``missing``. Carrying stays inside a session,
    whose length in buckets bounds the window's group.

    Buckets count from the session's open and are half-open. Readings with a null
    symbol, time or value or a value not above zero don't count; neither do those
    outside a session. Repeated readings count as one observation each in ``n``
    and don't change the value, which is that of the latest time, then the
    greatest reading_id. Sessions repeated with the same bounds count once;
    sessions with a null bound or close not after open give no rows.

    Returns: symbol, session_id, minute_start_ns, n, open_ticks, filled_ticks, state.
    """
    spans = (
        sessions.select(
            clean_symbol("source_ticker").alias("symbol"),
            "session_id",
            F.col("session_open_exchange_time_ns").alias("a"),
            F.col("session_close_exchange_time_ns").alias("b"),
        )
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("b") > F.col("a")) & F.col("symbol").isNotNull())
        .distinct()
    )
    #: In two steps, so that even a session with an absurd close makes no array of more than ``BLOCK`` buckets, or blocks.
    blocks = spans.withColumn("c", F.explode(F.sequence("a", F.col("b") - 1, F.lit(step_ns * BLOCK))))
    upto = F.least(F.col("b") - 1, F.col("c") + F.lit(step_ns * (BLOCK - 1)))
    grid = blocks.select("symbol", "session_id", "a", F.explode(F.sequence("c", upto, F.lit(step_ns))).alias("minute_start_ns")).withColumn(
        "phase", F.pmod("a", F.lit(step_ns))
    )
    read = readings.select(clean_symbol("symbol").alias("symbol"), instant_ns("event_time_ns").alias("t"), "open_ticks", "reading_id").where(
        (F.col("open_ticks") > 0) & F.col("t").isNotNull() & F.col("symbol").isNotNull()
    )
    #: Phases are as many as distinct opens modulo the step: one where sessions open on full minutes.
    phases = spans.select("symbol", F.pmod("a", F.lit(step_ns)).alias("phase")).distinct()
    observed = (
        read.join(phases, "symbol")
        .groupBy("symbol", "phase", (floor_to(F.col("t") - F.col("phase"), step_ns) + F.col("phase")).alias("minute_start_ns"))
        .agg(F.count(F.lit(1)).alias("n"), F.max_by("open_ticks", F.struct("t", "reading_id")).alias("open_ticks"))
    )
    rows = grid.join(observed, ["symbol", "phase", "minute_start_ns"], "left")
    w = Window.partitionBy("symbol", "session_id", "a").orderBy("minute_start_ns").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col("open_ticks").isNotNull(), F.struct("minute_start_ns", "open_ticks"))
    last = F.last(seen, ignorenulls=True).over(w)
    carried = rows.withColumn("last", last)
    near = (F.col("minute_start_ns") - F.col("last.minute_start_ns")) <= max_gap * step_ns
    return carried.select(
        "symbol",
        "session_id",
        "minute_start_ns",
        F.coalesce("n", F.lit(0)).alias("n"),
        "open_ticks",
        F.when(near, F.col("last.open_ticks")).alias("filled_ticks"),
        F.when(F.col("open_ticks").isNotNull(), "observed").when(near, "filled").otherwise("missing").alias("state"),
    )
