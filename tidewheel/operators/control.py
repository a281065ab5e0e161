"""Gates, latches, change detection and declared clocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.plans.reach import by


def decides(condition: Column) -> Column:
    """A predicate's answer: false if anything in it is absent."""
    return F.coalesce(condition, F.lit(False))


def gated(rows: DataFrame, gate: Column) -> DataFrame:
    """A run behind a gate: no rows where it is shut. Put ahead of costly nodes, so that they see fewer rows."""
    return rows.where(decides(gate))


def moved(rows: DataFrame, value: str, order: str = "seq", block: Column | None = None) -> DataFrame:
    """``rows`` with ``moved``: whether the level changed since the tick before; absent equals absent.

    At a symbol's first tick a level has moved if it is present. ``block`` (which must not fall) cuts a symbol: only the
    last level of each block is carried to the next.
    """
    if block is not None:
        cut = rows.withColumn("tw_block", block)
        ends = cut.groupBy("sym", "tw_block").agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("tw_end"))
        carried = ends.select("sym", "tw_block", F.lag("tw_end").over(by("tw_block")).alias("tw_carry"))
        w = Window.partitionBy("sym", "tw_block").orderBy(order)
        was = F.when(F.row_number().over(w) == 1, F.col("tw_carry")["v"]).otherwise(F.lag(value).over(w))
        return cut.join(carried, ["sym", "tw_block"]).withColumn("moved", ~F.col(value).eqNullSafe(was)).drop("tw_block", "tw_carry")
    return rows.withColumn("moved", ~F.col(value).eqNullSafe(F.lag(value).over(by(order))))


def standing(rows: DataFrame, value: str, fired: str, order: str = "seq") -> DataFrame:
    """A level that holds its last evaluation, present or absent, over ticks where it didn't fire."""
    w = by(order).rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col(fired), F.struct(F.col(value).alias("v"))), ignorenulls=True).over(w)
    return rows.withColumn(value, held["v"])


def clocked(ticks: DataFrame, period: int, ts: str = "ts", order: str = "seq", gate: Column | None = None) -> DataFrame:
    """Ticks at which a node of declared clock runs: where ts / period, truncated, differs from the last open tick's.

    A shut gate consumes no period. Times need not rise: going back opens a period again.
    """
    rows = ticks if gate is None else gated(ticks, gate)
    p = F.expr(f"{ts} div {period}")
    return rows.withColumn("tw_p", p).withColumn("tw_before", F.lag("tw_p").over(by(order))).where(~F.col("tw_p").eqNullSafe(F.col("tw_before"))).drop("tw_p", "tw_before")


def terminal(rows: DataFrame, condition: Column, step: str = "step_id") -> DataFrame:
    """sym, step, ended: whether any element of each step's run is terminal."""
    return rows.groupBy("sym", step).agg(F.bool_or(decides(condition)).alias("ended"))


def episodic(ticks: DataFrame, body: Callable[[], Callable[[tuple], tuple[tuple | None, bool]]], reads: list[str], out: str) -> DataFrame:
    """Self-terminating episodes: sym, seq, armed, done and the columns ``out`` of each armed tick's element (null otherwise).

    ``body()`` makes a fresh state: a function from a tick's columns ``reads`` to its element and whether that is
    terminal. Per tick, in this order: a pending end disarms and drops the state; ``trigger`` arms; an armed episode takes
    a step; a terminal step pends. So the terminal tick is published and a trigger on it is lost, and every episode
    starts from scratch. State is one episode's: a symbol is streamed batch by batch, never held whole.
    """
    names = [f.split()[0] for f in out.split(", ")]
    cols = ["sym", "seq", "trigger", *reads]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sym = object()
        armed = pending = False
        step = None
        for part in batches:
            rows = []
            for s, seq, trigger, *rest in part[cols].itertuples(index=False):
                if s != sym or pending:
                    sym, armed, pending, step = s, False, False, None
                armed = armed or bool(trigger)
                value = None
                if armed:
                    step = step or body()
                    value, pending = step(tuple(rest))
                rows.append((s, seq, armed, pending, *(value if value is not None else (None,) * len(names))))
            yield pd.DataFrame(rows, columns=["sym", "seq", "armed", "done", *names])

    ordered = ticks.select(*cols).repartition("sym").sortWithinPartitions("sym", "seq")
    return ordered.mapInPandas(fold, f"sym int, seq long, armed boolean, done boolean, {out}")


def latch(ticks: DataFrame, length: int) -> DataFrame:
    """The simplest episode: sym, seq, armed, n, done; its ``length``-th step is terminal."""

    def counting():
        n = 0

        def step(_: tuple) -> tuple[tuple, bool]:
            nonlocal n
            n += 1
            return (n,), n >= length

        return step

    return episodic(ticks, counting, [], "n long").select("sym", "seq", "armed", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "done")
