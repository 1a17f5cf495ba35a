"""A finger B-tree of partial aggregates keyed by event time.

Every node keeps the aggregate of its subtree. Inserts start at the right finger,
the newest leaf, climb no further than they must and then descend; afterwards the
aggregates on the path to the root are renewed, so an insert that arrives d
entries late costs O(log d) to find and O(log n) to repair. ``evict`` cuts whole
subtrees below a bound at once and only repairs the boundary path.

The monoid is given by ``combine``; partials are immutable tuples.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

ORDER = 8  # most keys of a node


class _Node:
    __slots__ = ("agg", "keys", "kids", "parent", "vals")

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.vals: list[tuple] = []
        self.kids: list[_Node] = []
        self.agg: tuple | None = None
        self.parent: _Node | None = None


class FingerTree:
    def __init__(self, combine: Callable[[tuple, tuple], tuple]):
        self.combine = combine
        self.root = self.right = _Node()
        self.evicted_below: int | None = None

    def __len__(self) -> int:
        return sum(1 for _ in self.items())

    def items(self, node: _Node | None = None) -> Iterator[tuple[int, tuple]]:
        node = node or self.root
        for i, k in enumerate(node.keys):
            if node.kids:
                yield from self.items(node.kids[i])
            yield k, node.vals[i]
        if node.kids:
            yield from self.items(node.kids[-1])

    def _renew(self, node: _Node) -> None:
        agg = None
        for i in range(len(node.keys) + 1):
            for part in ((node.kids[i].agg if node.kids else None), (node.vals[i] if i < len(node.keys) else None)):
                if part is not None:
                    agg = part if agg is None else self.combine(agg, part)
        node.agg = agg

    def insert(self, time: int, partial: tuple) -> bool:
        """Combine a partial into its time's entry. False if the time lies below the cut-off: nothing is kept then."""
        if self.evicted_below is not None and time < self.evicted_below:
            return False
        node = self.right
        while node.parent is not None and (not node.keys or time < node.keys[0]):
            node = node.parent
        while True:
            i = bisect_left(node.keys, time)
            if i < len(node.keys) and node.keys[i] == time:
                node.vals[i] = self.combine(node.vals[i], partial)
                break
            if not node.kids:
                node.keys.insert(i, time)
                node.vals.insert(i, partial)
                break
            node = node.kids[i]
        while node is not None:
            if len(node.keys) > ORDER:
                node = self._split(node)
            else:
                self._renew(node)
                node = node.parent
        return True

    def _split(self, node: _Node) -> _Node:
        mid = len(node.keys) // 2
        other = _Node()
        other.keys, other.vals = node.keys[mid + 1 :], node.vals[mid + 1 :]
        key, val = node.keys[mid], node.vals[mid]
        node.keys, node.vals = node.keys[:mid], node.vals[:mid]
        if node.kids:
            other.kids, node.kids = node.kids[mid + 1 :], node.kids[: mid + 1]
            for kid in other.kids:
                kid.parent = other
        up = node.parent
        if up is None:
            up = self.root = _Node()
            up.kids = [node]
            node.parent = up
        at = up.kids.index(node)
        up.keys.insert(at, key)
        up.vals.insert(at, val)
        up.kids.insert(at + 1, other)
        other.parent = up
        if self.right is node:
            self.right = other
        self._renew(node)
        self._renew(other)
        return up

    def evict(self, bound: int) -> list[tuple[int, tuple]]:
        """Cut off all times below the bound and return their final entries in order."""
        if self.evicted_below is not None and bound <= self.evicted_below:
            return []
        self.evicted_below = bound
        out: list[tuple[int, tuple]] = []
        node, path = self.root, []
        while True:
            i = bisect_left(node.keys, bound)
            for j in range(i):
                if node.kids:
                    out.extend(self.items(node.kids[j]))
                out.append((node.keys[j], node.vals[j]))
            del node.keys[:i], node.vals[:i]
            if node.kids:
                del node.kids[:i]
            path.append(node)
            if not node.kids:
                break
            node = node.kids[0]
        #: Nodes on the boundary may be left with no key; a tree of them collapses below.
        for node in reversed(path):
            self._renew(node)
        while len(self.root.kids) == 1 and not self.root.keys:
            self.root = self.root.kids[0]
            self.root.parent = None
        node = self.root
        while node.kids:
            node = node.kids[-1]
        self.right = node
        return out

    def range(self, lo: int, hi: int, node: _Node | None = None) -> tuple | None:
        """Aggregate of the entries with lo <= time < hi."""
        node = node or self.root
        i, j = bisect_left(node.keys, lo), bisect_left(node.keys, hi)
        agg = None

        def add(part: tuple | None) -> None:
            nonlocal agg
            if part is not None:
                agg = part if agg is None else self.combine(agg, part)

        if not node.kids:
            for x in node.vals[i:j]:
                add(x)
            return agg
        if i == j:
            return self.range(lo, hi, node.kids[i])
        add(self.range(lo, hi, node.kids[i]))
        for k in range(i, j):
            add(node.vals[k])
            add(node.kids[k + 1].agg if k + 1 < j else self.range(lo, hi, node.kids[j]))
        return agg
