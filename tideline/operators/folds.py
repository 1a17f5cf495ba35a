"""Order-dependent folds: what a window frame can't say.

Rows of a key are brought together by one shuffle, sorted, and streamed through a
step function that carries the key's state from batch to batch. A key of any size
needs the memory of one Arrow batch and its state. Keys run side by side; one
key's rows are sequential by nature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

#: Arrow types of the outputs' columns.
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, tuple | None]], columns: Sequence[str], out: str) -> DataFrame:
    """``step(state, row of columns)`` gives the next state and an output row (or None); ``out`` is the schema of the outputs after the keys.

    Rows with equal keys and order come in some order; make the order unique.
    Null keys form one key. An empty table gives no rows.
    """
    fields = [tuple(f.split()) for f in out.split(", ")]
    key_schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    n, m = len(keys), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        state = None
        for batch in batches:
            rows = []
            #: Python values by column: a null stays None and a bigint keeps all its digits.
            for values in zip(*(c.to_pylist() for c in batch.columns[: n + m])):
                key = values[:n]
                if key != current:
                    current, state = key, start()
                state, told = step(state, values[n:])
                if told is not None:
                    rows.append((*key, *told))
            columns_out = list(zip(*rows)) if rows else [()] * (n + len(fields))
            types = [*batch.schema.types[:n], *(ARROW[t] for _, t in fields)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns_out, types)], names=[*keys, *(f for f, _ in fields)])

    return df.select(*keys, *columns, *(c for c in order if c not in columns and c not in keys)).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{key_schema}, {out}")


def ema_step(numerator: int, denominator: int) -> Callable[[Any, tuple], tuple[Any, tuple]]:
    """Exponential mean and variance in integers, each step truncated toward zero. Row: (id, value)."""

    def div(a: int, b: int) -> int:
        return abs(a) // b * (1 if a >= 0 else -1)

    def step(state: Any, row: tuple) -> tuple[Any, tuple]:
        i, x = int(row[0]), int(row[1])
        if state is None:
            state = (x, 0)
        else:
            mean, var = state
            d = x - mean
            mean += div(d * numerator, denominator)
            var = div((denominator - numerator) * (var + div(d * d * numerator, denominator)), denominator)
            state = (mean, var)
        return state, (i, *state)

    return step


def admit_step(limit: int, span: int) -> Callable[[Any, tuple], tuple[Any, tuple]]:
    """Sliding limiter: admits if fewer than ``limit`` admitted rows lie less than ``span`` back. Row: (id, time)."""
    from collections import deque

    def step(state: Any, row: tuple) -> tuple[Any, tuple]:
        state = deque() if state is None else state
        i, t = int(row[0]), int(row[1])
        while state and t - state[0] >= span:
            state.popleft()
        ok = len(state) < limit
        if ok:
            state.append(t)
        return state, (i, ok)

    return step


def average_cost_step(state: Any, row: tuple) -> tuple[Any, tuple]:
    """Signed position with average cost. Row: (id, signed quantity, notional, fee), state (quantity, cost, realised)."""
    i, q, notional, fee = (int(x) for x in row)
    pos, cost, real = state or (0, 0, 0)
    real -= fee
    if pos == 0 or (pos > 0) == (q > 0):
        pos, cost = pos + q, cost + (notional if q > 0 else -notional)
    else:
        closing = min(abs(q), abs(pos))
        allocated = abs(cost) * closing // abs(pos)
        proceeds = notional * closing // abs(q)
        real += proceeds - allocated if pos > 0 else allocated - proceeds
        long = pos > 0
        cost = cost - allocated if long else cost + allocated
        rest = abs(q) - closing
        pos += q
        if rest:
            cost = (notional - proceeds) if q > 0 else -(notional - proceeds)
        elif pos == 0:
            cost = 0
    state = (pos, cost, real)
    return state, (i, pos, cost, real)


def hysteresis_step(up: int, down: int, dwell: int) -> Callable[[Any, tuple], tuple[Any, tuple]]:
    """Two-state machine that turns HIGH above ``up`` and LOW below ``down``, not before ``dwell`` after the last change. Row: (id, time, value)."""

    def step(state: Any, row: tuple) -> tuple[Any, tuple]:
        i, t, x = (int(v) for v in row)
        now, since = state or ("LOW", None)
        want = "HIGH" if x > up else "LOW" if x < down else now
        if want != now and (since is None or t - since >= dwell):
            now, since = want, t
        return (now, since), (i, now)

    return step


class MeanReversion:
    """A strategy for ``strategy_step``: sells above and buys below the mean of the last four prices, one unit at a time."""

    def __init__(self) -> None:
        self.last: list[int] = []

    def act(self, price: int, quantity: int, position: int) -> int:
        mean = sum(self.last) // len(self.last) if self.last else price
        self.last = [*self.last, price][-4:]
        return 1 if price < mean and position < 3 else -1 if price > mean and position > -3 else 0


def strategy_step(make: Callable[[], Any]) -> Callable[[Any, tuple], tuple[Any, tuple]]:
    """Calls a strategy's ``act(price, quantity, position)`` per event; its units fill at the event's price. Row: (id, price, quantity); gives (id, units, position, equity)."""

    def step(state: Any, row: tuple) -> tuple[Any, tuple]:
        i, price, quantity = (int(x) for x in row)
        strategy, position, cash = state or (make(), 0, 0)
        units = int(strategy.act(price, quantity, position))
        position, cash = position + units, cash - units * price
        return (strategy, position, cash), (i, units, position, cash + position * price)

    return step
