"""Batch scoring with a user's model, and ordered batches of a result."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.ranking import BUCKET_ROWS, bucket_bounds, running_total


class Model(Protocol):
    """Scores a batch: a frame of the model's input columns to one number per row."""

    def predict(self, rows: pd.DataFrame) -> pd.Series: ...


def score_batches(df: DataFrame, make: Callable[[], Model], inputs: Sequence[str], keep: Sequence[str], limit: int, deadline_s: float | None = None) -> DataFrame:
    """``keep``, ``score`` and ``status`` of each row; the model is made once per task.

    Status is OK, INVALID_INPUT (a null input; score null), OUT_OF_RANGE (beyond
    +-``limit``; score null), FAILED (the model raised on the batch) or LATE (the
    batch took longer than ``deadline_s``; score null). After a failed or late batch
    the task's model counts as unhealthy, and its further batches are UNAVAILABLE.
    An empty table gives no rows. Input columns must be numeric.
    """
    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Any = make()
        healthy = True
        for batch in batches:
            ok = batch[list(inputs)].notna().all(axis=1)
            score = pd.Series(pd.NA, index=batch.index, dtype="Int64")
            status = pd.Series("INVALID_INPUT", index=batch.index)
            if not healthy:
                status[ok] = "UNAVAILABLE"
            elif ok.any():
                began = time.monotonic()
                try:
                    told = pd.Series(model.predict(batch.loc[ok, list(inputs)]), index=batch.index[ok])
                    failed = None
                except Exception:  # noqa: BLE001  a user's model may raise anything
                    failed = "FAILED"
                if failed is None and deadline_s is not None and time.monotonic() - began > deadline_s:
                    failed = "LATE"
                if failed:
                    healthy = False
                    status[ok] = failed
                else:
                    within = told.abs() <= limit
                    status[ok] = within.map({True: "OK", False: "OUT_OF_RANGE"})
                    score[told.index[within]] = told[within].astype("int64")
            yield batch[list(keep)].assign(score=score, status=status)

    columns = [*dict.fromkeys([*keep, *inputs])]
    return df.select(*columns).mapInPandas(run, f"{fields}, score long, status string")


def ordered_batches(df: DataFrame, order: str, size: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows with ``batch``, so that batch 0, 1, ... hold ``size`` rows each in the order of a unique bigint column.

    What a cursor's fetchmany gives, without a driver that walks through the result:
    numbers come from bucketed running totals. Rows with a null in ``order`` drop out.
    """
    rows = df.where(F.col(order).isNotNull()).withColumn("__all", F.lit(0))
    n = running_total(rows, ["__all"], order, "__n", bucket_bounds(rows, ["__all"], order, bucket_rows))
    return n.withColumn("batch", F.expr(f"(__n - 1) div {size}")).drop("__n", "__all")
