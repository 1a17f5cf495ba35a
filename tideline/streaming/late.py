"""Per-period aggregates by event time, corrected by late rows up to a cut-off.

Batch form: ``late_events``. Stream form: ``late_events_stream``. Both feed the
same ``PeriodTree``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.functions.times import HOUR, floor_to
from tideline.operators.ranking import bucket_bounds, with_bucket
from tideline.session import durable
from tideline.streaming.fiba import FingerTree

CUTOFF = 6 * HOUR
GROUP_ROWS = 50_000
ON_TIME, CORRECTS, DROPPED = "on_time", "corrects", "dropped"
OUT = "stream string, what string, row_key string, period_start_ns long, verdict string, n long, n_corrects long, total decimal(38,0), low long, high long"


def _merge(a: tuple, b: tuple) -> tuple:
    """(rows, correcting rows, sum, least, greatest); sums are Python integers and can't overflow."""
    low = b[3] if a[3] is None else a[3] if b[3] is None else min(a[3], b[3])
    high = b[4] if a[4] is None else a[4] if b[4] is None else max(a[4], b[4])
    return a[0] + b[0], a[1] + b[1], a[2] + b[2], low, high


class PeriodTree:
    """Partial aggregates of periods; arrivals move the cut-off, which evicts closed periods in bulk."""

    def __init__(self, period: int = HOUR, cutoff: int = CUTOFF):
        self.period, self.cutoff, self.tree = period, cutoff, FingerTree(_merge)

    def advance(self, arrival: int) -> list[tuple[int, tuple]]:
        """Periods that no row arriving from now on can correct."""
        bound = arrival - self.cutoff - self.period
        return self.tree.evict(bound - bound % self.period + self.period)

    def add(self, start: int, partial: tuple) -> bool:
        return self.tree.insert(start, partial)

    def rest(self) -> list[tuple[int, tuple]]:
        return list(self.tree.items())


def fold(pdf: pd.DataFrame, state: PeriodTree) -> tuple[pd.DataFrame, list[tuple[int, tuple]]]:
    """Feed rows (row_key, event, arrival, value, absent) in order of arrival; the rows' verdicts and the periods that closed."""
    pdf = pdf.sort_values(["arrival", "row_key"], kind="stable", ignore_index=True)
    arrival, event = pdf["arrival"].to_numpy(np.int64), pdf["event"].to_numpy(np.int64)
    start = event - event % state.period
    #: Rows that arrive in the same period can't differ in what is evicted before them.
    slice_ = arrival // state.period
    order = np.lexsort((np.arange(len(pdf)), start, slice_))
    key = np.stack([slice_[order], start[order]], 1)
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(key) else np.zeros(0, int)
    last = np.r_[first[1:], len(key)]
    value, present = pdf["value"].to_numpy(np.int64)[order], ~pdf["absent"].to_numpy(bool)[order]
    verdict = np.empty(len(pdf), object)
    closed: list[tuple[int, tuple]] = []
    now = None
    for a, b in zip(first, last):
        s, p = (int(x) for x in key[a])
        if s != now:
            closed += state.advance(s * state.period)
            now = s
        late = s * state.period >= p + state.period
        said = value[a:b][present[a:b]].tolist()
        part = (int(b - a), int(b - a) if late else 0, sum(said), min(said, default=None), max(said, default=None))
        kept = state.add(p, part)
        verdict[order[a:b]] = (CORRECTS if late else ON_TIME) if kept else DROPPED
    return pdf.assign(period_start_ns=start, verdict=verdict), closed


def _rows(stream: str, told: pd.DataFrame | None, periods: Iterable[tuple[int, tuple]], what: str = "period") -> pd.DataFrame:
    late = told[told["verdict"] != ON_TIME] if told is not None else None
    n, periods = 0 if late is None else len(late), list(periods)
    part = [x for _, x in periods]
    none = [None] * n
    text = lambda x: pd.Series(x, dtype=object)
    number = lambda x: pd.Series(x, dtype="Int64")
    return pd.DataFrame(
        {
            "stream": text([stream] * (n + len(part))),
            "what": text(["late"] * n + [what] * len(part)),
            "row_key": text((late["row_key"].tolist() if n else []) + [None] * len(part)),
            "period_start_ns": number((late["period_start_ns"].tolist() if n else []) + [t for t, _ in periods]),
            "verdict": text((late["verdict"].tolist() if n else []) + [None] * len(part)),
            "n": number(none + [x[0] for x in part]),
            "n_corrects": number(none + [x[1] for x in part]),
            "total": text(none + [Decimal(x[2]) for x in part]),
            "low": number(none + [x[3] for x in part]),
            "high": number(none + [x[4] for x in part]),
        }
    )


def first_arrivals(df: DataFrame, key: Column, event: str, arrival: str, value: Column) -> DataFrame:
    """row_key, event, arrival, value of each key's earliest arrival; rows lacking a key or either time drop out."""
    return (
        df.select(key.alias("row_key"), F.col(event).cast("long").alias("event"), F.col(arrival).cast("long").alias("arrival"), value.cast("long").alias("value"))
        .where(F.col("row_key").isNotNull() & F.col("event").isNotNull() & F.col("arrival").isNotNull())
        .groupBy("row_key")
        .agg(F.min(F.struct("arrival", "event", F.col("value").isNull().alias("no"), "value")).alias("x"))
        .select("row_key", "x.event", "x.arrival", "x.value")
    )


def _typed(rows: DataFrame) -> DataFrame:
    """A null in a bigint column would reach Python as floats, so absence is a column of its own."""
    return rows.select("stream", "row_key", "event", "arrival", F.coalesce(F.col("value").cast("long"), F.lit(0)).alias("value"), F.col("value").isNull().alias("absent"))


def late_events(rows: DataFrame, period: int = HOUR, cutoff: int = CUTOFF, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Aggregates per stream and period, and every late row with what became of it.

    ``rows``: stream, row_key, event, arrival, value; keys already counted once
    (``first_arrivals``). A group is a stream's stretch of periods, so no period is
    split except by salt: a stretch with more than ``group_rows`` rows is salted
    by row_key, and the groups' partials of a period are combined afterwards. A row's
    verdict depends on its own arrival and period only, hence not on the split:
    ``corrects`` if it arrives at or after its period's end but less than
    ``cutoff`` after it, ``dropped`` if later still. ``cutoff`` must be a multiple of
    ``period``.

    A null value counts as a row and not in total, low and high. An empty input
    gives no rows. Extra columns are ignored.
    """
    if cutoff % period:
        raise ValueError("the cut-off must be a whole number of periods")
    rows = durable(_typed(rows), "arrivals").withColumn("start", floor_to("event", period))
    placed = with_bucket(rows, ["stream"], "start", bucket_bounds(rows.select("stream", "start", "row_key"), ["stream"], "start", group_rows), "stretch")
    most = placed.groupBy("stream", "stretch").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, -(-most // (2 * group_rows)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state = PeriodTree(period, cutoff)
        told, closed = fold(pdf, state)
        return _rows(key[0], told, closed + state.rest())

    return placed.drop("start").groupBy("stream", "stretch", F.pmod(F.xxhash64("row_key"), F.lit(salts)).alias("salt")).applyInPandas(run, OUT)


def late_rows(told: DataFrame) -> DataFrame:
    """stream, row_key, period_start_ns, verdict of the late rows."""
    return told.where("what = 'late'").select("stream", "row_key", "period_start_ns", "verdict")


def period_totals(told: DataFrame) -> DataFrame:
    """The corrected aggregates: stream, period_start_ns, n, n_corrects, total, low, high."""
    return (
        told.where("what = 'period'")
        .groupBy("stream", "period_start_ns")
        .agg(F.sum("n").alias("n"), F.sum("n_corrects").alias("n_corrects"), F.sum("total").cast("decimal(38,0)").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    )


def late_events_stream(rows: DataFrame, period: int = HOUR, cutoff: int = CUTOFF, parts: int = 16) -> DataFrame:
    """The stream form: emits late rows at once, and a period's partial when the cut-off passes it.

    ``rows`` is a streaming DataFrame of stream, row_key, event, arrival, value in
    roughly the order of arrival. State is one ``PeriodTree`` per (stream, part),
    pickled; it holds the open periods only, however long the stream. Partials of
    the parts add up in ``period_totals``. A row that a micro-batch brings after
    a later arrival has moved the cut-off past its period is ``dropped``.
    """

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        tree = pickle.loads(state.get[0]) if state.exists else PeriodTree(period, cutoff)
        pdf = pd.concat(list(batches), ignore_index=True)
        told, closed = fold(pdf, tree)
        state.update((pickle.dumps(tree),))
        yield _rows(key[0], told, closed)

    typed = _typed(rows).withColumn("part", F.pmod(F.xxhash64("row_key"), F.lit(parts)))
    return typed.groupBy("stream", "part").applyInPandasWithState(run, OUT, "tree binary", "append", GroupStateTimeout.NoTimeout)
