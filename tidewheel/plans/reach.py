"""How far back a node reads its input, and the windows that follow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reach:
    """``unit`` < ``elems(n)`` < ``over(ns)`` < ``unbounded``."""

    kind: str
    n: int = 0

    RANKS = ("unit", "elems", "over", "unbounded")

    @property
    def _key(self) -> tuple[int, int]:
        return self.RANKS.index(self.kind), self.n

    def serves(self, other: Reach) -> bool:
        """True if a retention of this reach holds what ``other`` reads."""
        return self._key >= other._key

    def join(self, other: Reach) -> Reach:
        return self if self.serves(other) else other

    def __str__(self) -> str:
        return self.kind if self.kind in ("unit", "unbounded") else f"{self.kind}({self.n})"


UNIT, UNBOUNDED = Reach("unit"), Reach("unbounded")


def elems(n: int) -> Reach:
    return Reach("elems", n)


def over(ns: int) -> Reach:
    return Reach("over", ns)


def by(order: str, part: str = "sym") -> WindowSpec:
    return Window.partitionBy(part).orderBy(order)


def lagged(column: str, n: int, order: str = "ts_close", part: str = "sym") -> Column:
    """The element n back."""
    return F.lag(column, n).over(by(order, part))


def fresh(step: str = "step_id", part: str = "sym") -> WindowSpec:
    """This step's elements."""
    return by(step, part).rangeBetween(0, 0)


def past(step: str = "step_id", part: str = "sym") -> WindowSpec:
    """All elements of the steps before."""
    return by(step, part).rangeBetween(Window.unboundedPreceding, -1)


def trailing(reach: Reach, ts: str = "ts_close", seq: str | None = None, part: str = "sym") -> tuple[WindowSpec, Column]:
    """The window that ends at each element, and whether it is complete.

    ``elems(n)``: the last n elements, complete once there are n. ``over(ns)``: elements with time in (t - ns, t],
    complete once the series reaches back to t - ns.
    """
    w = by(seq or ts, part)
    if reach.kind == "elems":
        frame = w.rowsBetween(-(reach.n - 1), 0)
        return frame, F.count(F.lit(1)).over(frame) == reach.n
    if reach.kind == "over":
        first = F.min(ts).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return by(ts, part).rangeBetween(-(reach.n - 1), 0), F.col(ts) - reach.n >= first
    if reach.kind == "unbounded":
        return w.rowsBetween(Window.unboundedPreceding, 0), F.lit(True)
    return w.rowsBetween(0, 0), F.lit(True)
