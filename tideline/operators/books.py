"""An order book as the state of a fold: orders with price-time priority, levels, control updates, snapshots."""

from __future__ import annotations

import copy
from bisect import bisect_left, insort
from typing import Any

#: Operations on orders, on levels and on the market's state.
ORDER_OPS = ("ADD", "CANCEL", "PARTIAL_CANCEL", "EXECUTE", "PARTIAL_EXECUTE", "REPLACE", "DELETE")
LEVEL_OPS = ("SET_LEVEL", "DELETE_LEVEL", "CLEAR_SIDE", "CLEAR_BOOK")
CONTROL_OPS = ("TRADE", "STATUS", "AUCTION", "QUOTE")
STATE_OPS = ("SNAPSHOT", "RESTORE")


class OrderBook:
    """Sides B and A; a level is [quantity, orders in priority (id to quantity)]; prices are kept sorted, so the best is an end of a list.

    An operation that can't be carried out leaves the book as it is and makes it
    invalid; an invalid book takes only CLEAR_BOOK and RESTORE (to the latest
    SNAPSHOT, or empty). REPLACE loses priority. A crossing ADD, REPLACE or SET_LEVEL is refused.
    """

    def __init__(self) -> None:
        self.levels: dict[str, dict[int, list]] = {"B": {}, "A": {}}
        self.prices: dict[str, list[int]] = {"B": [], "A": []}
        self.orders: dict[int, tuple[str, int]] = {}
        self.status, self.valid = "OPEN", True
        self.trade: tuple[int, int] | None = None
        self.auction: int | None = None
        self.saved: dict[str, Any] | None = None

    def best(self, side: str) -> int | None:
        p = self.prices[side]
        return (p[-1] if side == "B" else p[0]) if p else None

    def _crosses(self, side: str, price: int) -> bool:
        other = self.best("A" if side == "B" else "B")
        return other is not None and (price >= other if side == "B" else price <= other)

    def _level(self, side: str, price: int) -> list:
        if price not in self.levels[side]:
            self.levels[side][price] = [0, {}]
            insort(self.prices[side], price)
        return self.levels[side][price]

    def _drop_level(self, side: str, price: int) -> None:
        del self.levels[side][price]
        del self.prices[side][bisect_left(self.prices[side], price)]

    def _remove(self, order: int, quantity: int | None = None) -> None:
        side, price = self.orders[order]
        level = self.levels[side][price]
        quantity = level[1][order] if quantity is None else quantity
        level[0] -= quantity
        level[1][order] -= quantity
        if not level[1][order]:
            del level[1][order], self.orders[order]
        if not level[0]:
            self._drop_level(side, price)

    def _add(self, order: int, side: str, price: int, quantity: int) -> None:
        level = self._level(side, price)
        level[0] += quantity
        level[1][order] = quantity
        self.orders[order] = (side, price)

    def _clear(self, side: str) -> None:
        for level in self.levels[side].values():
            for order in level[1]:
                del self.orders[order]
        self.levels[side], self.prices[side] = {}, []

    def _try(self, op: str, order: int, side: str, price: int, quantity: int) -> str | None:
        """The error, or None."""
        if op in ("ADD", "REPLACE", "SET_LEVEL") and (price <= 0 or quantity <= 0):
            return "INVALID_SHAPE"
        if op == "ADD":
            if order in self.orders:
                return "DUPLICATE_ORDER"
            if self._crosses(side, price):
                return "CROSSED"
            self._add(order, side, price, quantity)
        elif op in ORDER_OPS:
            if order not in self.orders:
                return "ORDER_NOT_FOUND"
            own, at = self.orders[order]
            has = self.levels[own][at][1][order]
            if op.startswith("PARTIAL_"):
                if not 0 < quantity < has:
                    return "QUANTITY_MISMATCH"
                self._remove(order, quantity)
            elif op == "REPLACE":
                self._remove(order)
                if self._crosses(side, price):
                    self._add(order, own, at, has)
                    return "CROSSED"
                self._add(order, side, price, quantity)
            else:
                self._remove(order)
        elif op == "SET_LEVEL":
            if self._crosses(side, price):
                return "CROSSED"
            level = self._level(side, price)
            for o in level[1]:
                del self.orders[o]
            level[0], level[1] = quantity, {}
        elif op == "DELETE_LEVEL":
            if price not in self.levels[side]:
                return "LEVEL_NOT_FOUND"
            for o in self.levels[side][price][1]:
                del self.orders[o]
            self._drop_level(side, price)
        elif op == "CLEAR_SIDE":
            self._clear(side)
        elif op == "TRADE":
            self.trade = (price, quantity)
        elif op == "STATUS":
            self.status = ("OPEN", "HALTED", "AUCTION")[quantity % 3]
            if self.status != "AUCTION":
                self.auction = None
        elif op == "AUCTION":
            self.auction = quantity
        elif op == "SNAPSHOT":
            self.saved = {k: copy.deepcopy(v) for k, v in vars(self).items() if k != "saved"}
        elif op != "QUOTE":
            return "INVALID_OPERATION"
        return None

    def apply(self, op: str, order: int, side: str, price: int, quantity: int) -> str | None:
        if op == "CLEAR_BOOK":
            self._clear("B")
            self._clear("A")
            self.valid = True
            return None
        if op == "RESTORE":
            saved = self.saved
            self.__init__()
            vars(self).update(copy.deepcopy(saved or {}))
            self.saved = saved
            return None
        if not self.valid:
            return "BOOK_INVALID"
        error = self._try(op, order, side, price, quantity)
        self.valid = error is None
        return error


BOOK_OUT = "event_id long, error string, best_bid long, bid_quantity long, best_ask long, ask_quantity long, front_order long, n_orders int, n_levels int, status string, last_trade long, auction_quantity long, valid boolean"


def book_step(state: Any, row: tuple) -> tuple[Any, tuple]:
    """Row: (id, operation, order, side, price, quantity); gives ``BOOK_OUT``."""
    book = state or OrderBook()
    i, op, order, side, price, quantity = row
    error = book.apply(op, int(order), side, int(price), int(quantity))
    bid, ask = book.best("B"), book.best("A")
    first = lambda s, p: None if p is None else book.levels[s][p]
    b, a = first("B", bid), first("A", ask)
    front = next(iter(b[1]), None) if b else None
    n = len(book.prices["B"]) + len(book.prices["A"])
    return book, (int(i), error, bid, b and b[0], ask, a and a[0], front, len(book.orders), n, book.status, book.trade and book.trade[0], book.auction, book.valid)
