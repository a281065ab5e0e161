"""Times: nanoseconds of a clock named in the column, floors, cells, spans and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX, MIN = (1 << 63) - 1, -(1 << 63)
#: Clocks that a time may be of; the name of the actor is part of the column's name, as in ``ts_venue_exec``.
ACTORS = ("venue", "local", "vendor")


def actor(column: str) -> str:
    """Whose clock a column is of."""
    for a in ACTORS:
        if f"_{a}_" in f"_{column}_":
            return a
    raise ValueError(f"{column}: no clock in its name")


def between(later: str, earlier: str) -> Column:
    """The exact duration between two times of one clock; times of two clocks have none (see ``bounded``)."""
    if actor(later) != actor(earlier):
        raise ValueError(f"{later} and {earlier} are of different clocks")
    return F.col(later) - F.col(earlier)


def bounded(sent: Column, received: Column, back: Column, returned: Column) -> Column:
    """lo and hi of the offset between two clocks, from a round trip: out (sent, received) and back (back, returned)."""
    return F.struct((back - returned).alias("lo"), (received - sent).alias("hi"))


def floor(ts: Column, step: int) -> Column:
    """The multiple of ``step`` at or before ``ts``, also before the epoch."""
    return ts - F.pmod(ts, F.lit(step))


def cell_end(arrival: Column, step: int) -> Column:
    """The last arrival of an arrival's cell. ``step`` 0: itself. Saturates at both ends of the range."""
    if step < 0:
        raise ValueError("a read clock can't run backwards")
    if step == 0:
        return arrival
    rest = F.pmod(arrival, F.lit(step))
    start = F.when(arrival < F.lit(MIN) + rest, F.lit(MIN)).otherwise(F.try_subtract(arrival, rest))
    return F.coalesce(F.try_add(F.coalesce(start, F.lit(MIN)), F.lit(step - 1)), F.lit(MAX))


def span(ts: Column) -> tuple[Column, Column]:
    """Aggregates: the first and last of times."""
    return F.min(ts).alias("first"), F.max(ts).alias("last")
